"""Sharding by a hierarchical weighted hash tree (operator 8).

A document descends region, rack and shard levels; at each level the child with
the least weighted hash draw, -ln(u) / weight, wins (u: a hash of doc_id and the
child's label).  A child whose weight grows only takes documents, one whose
weight shrinks only gives them, so movement stays inside the subtrees whose
weights change.  Capacity added beyond the base tree forms a region of its own
(one rack per extra shard): its weight rises from 0, every other weight stays,
hence an added shard takes documents only into itself.

Only (doc_id, size, crc) leave the scan; texts are never shuffled.  Slots are
dense ranks over a range order, so no task holds a whole shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.llm.common import text_of, uniform
from linkweave.operators.ranking import dense_rank_table

BASE = (2, 3, 4)  # regions x racks x shards
N_SHARDS = 24
FIXED_BYTES = 8


@dataclass(frozen=True)
class Node:
    label: str
    weight: float
    kids: tuple[Node, ...] = ()
    shard: int = -1


def tree(n_shards: int, base: tuple[int, int, int] = BASE, weights: dict[int, float] | None = None) -> Node:
    """The tree of ``n_shards`` shards; a shard's weight is 1 unless ``weights`` says otherwise.

    Shards beyond the base tree's product hang below regions of their own.
    """
    weights = weights or {}
    regions, racks, leaves = base

    def leaf(i: int) -> Node:
        return Node(f"shard{i}", float(weights.get(i, 1.0)), (), i)

    def over(label: str, kids: list[Node]) -> Node:
        return Node(label, sum(k.weight for k in kids), tuple(kids))

    top = []
    for g in range(regions):
        rows = []
        for r in range(racks):
            first = (g * racks + r) * leaves
            ids = [i for i in range(first, first + leaves) if i < n_shards]
            if ids:
                rows.append(over(f"rack{g}.{r}", [leaf(i) for i in ids]))
        if rows:
            top.append(over(f"region{g}", rows))
    for i in range(regions * racks * leaves, n_shards):
        top.append(over(f"region+{i}", [over(f"rack+{i}", [leaf(i)])]))
    return over("root", top)


def shard_of(root: Node, key: Column) -> Column:
    """Leaf that ``key`` reaches; ties in a draw go to the smaller label."""

    def descend(node: Node) -> Column:
        if not node.kids:
            return F.lit(node.shard)
        if len(node.kids) == 1:
            return descend(node.kids[0])
        draws = [F.struct((-F.log(uniform(key, F.lit(k.label))) / F.lit(k.weight)).alias("draw"), F.lit(i).alias("kid")) for i, k in enumerate(node.kids) if k.weight > 0]
        won = F.array_min(F.array(*draws))["kid"]
        out = descend(node.kids[-1])
        for i, kid in reversed(list(enumerate(node.kids[:-1]))):
            out = F.when(won == i, descend(kid)).otherwise(out)
        return out

    return descend(root).cast("int")


def assign(docs: DataFrame, n_shards: int = N_SHARDS, base=BASE, weights=None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot, grown_shard.

    Null text: size 8, crc of the empty string.  Null ids share one place in the
    tree; rows that repeat a doc_id share a shard and get slots of their own.
    An empty table gives an empty result.
    """
    key = F.col("doc_id").cast("long")
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text_of()) + FIXED_BYTES).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).cast("long").alias("text_crc32"),
    ).select(
        "*",
        shard_of(tree(n_shards, base, weights), F.col("doc_id")).alias("shard"),
        shard_of(tree(n_shards + 1, base, weights), F.col("doc_id")).alias("grown_shard"),
    )
    return dense_rank_table(rows, ["doc_id", "text_crc32", "size"], ["shard"], "slot")


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS, base=BASE, weights=None) -> None:
    """Write ``docs`` as one folder per shard (``lw_shard=0/...``), every column kept."""
    placed = docs.withColumn("lw_shard", shard_of(tree(n_shards, base, weights), F.col("doc_id").cast("long")))
    placed.write.mode("errorifexists").partitionBy("lw_shard").parquet(path)
