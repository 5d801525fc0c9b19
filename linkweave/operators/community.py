"""K2: communities by modularity (Louvain), as synchronous moves and graph contraction.

A level starts with every node in a community of its own.  In a round all nodes
look at the communities of their neighbours at once; hashing splits the
communities into givers and takers, anew each round, and a node of a giver may
move to the taker with the largest gain.  Communities that take never lose
members in the same round, which keeps simultaneous moves from undoing each
other.  A level ends when rounds no longer raise the modularity; its best
labels (they are all measured) become the nodes of the next level.

Gains and modularity are exact integers (long while (2m)^2 is one, else
decimal(38)): weights are edge counts, 2m * w(i, c) - k(i) * tot(c) decides, ties
go to the smallest label.  The result
is therefore the same for every partitioning.

Scale: a round is one pass over the edges, kept partitioned with hubs salted
(:class:`KeyedEdges`), a combined sum per (node, community), and a join of the
rows that can decide a move with the community totals, whose plain shuffle the
adaptive skew join splits where a community is large.  Only the labels are kept,
a row per node; the sums of the level's best labels are made again once for the
contraction.  Only two sums per round reach the driver.  As soon as a level's
graph is small (``ONE_TASK_EDGES``, counted) one task takes that level and all
that follow, in the same rounds with the same integers: a round of jobs would
cost more than the rest of the work.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.operators.traverse import KeyedEdges, _ckpt, _ckpt_obs, encode_graph, symmetrize

MAX_ROUNDS = 12  # per level
PATIENCE = 2  # rounds without a gain before a level ends
ONE_TASK_EDGES = 2_000_000  # both directions; some 250 MB of a worker
_EXACT = "decimal(18,0)"
_LONG = 1 << 63


def _pairs(keyed: KeyedEdges, labels: DataFrame) -> DataFrame:
    """(node, c, w, k, own): weight between a node and each community it touches, its own always among them."""
    # The labels are unique per node: hashing them spares a sort of all edges.
    near = keyed.expand(labels.select("node", "c").hint("shuffle_hash")).select(F.col("dst").alias("node"), "c", "w", F.col("kd").alias("k"), F.lit(False).alias("own"))
    own = labels.select("node", "c", F.lit(0).cast("long").alias("w"), "k", F.lit(True).alias("own"))
    return near.unionByName(own).groupBy("node", "c").agg(F.sum("w").alias("w"), F.max("k").alias("k"), F.max("own").alias("own"))


def _exact(two_m: int) -> str:
    """Type in which products of two weights are exact: none is above (2m)^2."""
    return "long" if two_m**2 < _LONG else _EXACT


def _takes(turn: int):
    return F.pmod(F.xxhash64(F.col("c"), F.lit(turn)), F.lit(2)) == 1


def _moves(pairs: DataFrame, totals: DataFrame, two_m: int, turn: int) -> DataFrame:
    """(node, k, old, c, w, tot): the community of every node after the round; ``w`` and ``tot`` are its old one's."""
    exact = _exact(two_m)
    # A node stays or goes to a taker, so the other rows need no total.
    joined = pairs.where(F.col("own") | _takes(turn)).join(totals.hint("shuffle_hash"), "c")
    gain = F.lit(two_m).cast(exact) * F.col("w").cast(exact) - F.col("k").cast(exact) * (F.col("tot") - F.when(F.col("own"), F.col("k")).otherwise(0)).cast(exact)
    scored = joined.select("node", "c", "w", "k", "tot", "own", gain.alias("gain"), _takes(turn).alias("takes"))
    best = scored.groupBy("node").agg(
        F.max("k").alias("k"),
        F.max(F.when(F.col("own"), F.struct("gain", "c", "w", "tot", "takes"))).alias("now"),
        F.max(F.when(~F.col("own") & F.col("takes"), F.struct("gain", (-F.col("c")).alias("least")))).alias("there"),
    )
    leaves = ~F.col("now.takes") & (F.col("there.gain") > F.col("now.gain"))
    return best.select("node", "k", F.col("now.c").alias("old"), F.when(leaves, -F.col("there.least")).otherwise(F.col("now.c")).alias("c"), F.col("now.w").alias("w"), F.col("now.tot").alias("tot"))


def _one_level(edges: DataFrame, nodes: DataFrame, two_m: int, inside: int) -> tuple[DataFrame, KeyedEdges, Decimal]:
    """(labels (node, k, c), keyed edges, modularity times (2m)^2) of the level's best round.

    ``inside`` is the weight inside the nodes themselves, both directions.
    """
    degree = nodes.select("node", "k")
    with_k = edges.join(degree.select(F.col("node").alias("dst"), F.col("k").alias("kd")), "dst").select("src", "dst", "w", "kd")
    keyed = KeyedEdges(_ckpt(with_k), "src", ("w", "kd"), fixed=True)
    labels = degree.withColumn("c", F.col("node"))
    best, stale = None, 0
    # The squares of the totals, summed over communities, are k * tot summed over nodes.
    square = F.sum(F.col("k").cast(_exact(two_m)) * F.col("tot").cast(_exact(two_m)))
    for turn in range(MAX_ROUNDS + 1):
        totals = labels.groupBy("c").agg(F.sum("k").alias("tot"))
        moved, m = _ckpt_obs(_moves(_pairs(keyed, labels), totals, two_m, turn), own=F.sum("w"), squares=square)
        value = Decimal(two_m) * (inside + int(m["own"] or 0)) - (m["squares"] or 0)  # of the labels before this round's moves
        if best is None or value > best[2]:
            best, stale = (labels, keyed, value), 0
        else:
            stale += 1
        # Givers and takers are drawn anew: a round without a move is not the end by itself.
        if stale >= PATIENCE:
            break
        labels = moved.select("node", "k", "c")
    return best


def _level_in_memory(src: np.ndarray, dst: np.ndarray, w: np.ndarray, k: np.ndarray, turns: np.ndarray, two_m: int, inside: int) -> tuple[np.ndarray, int]:
    """(labels, modularity times (2m)^2) as :func:`_one_level` finds them; nodes are numbers in id order, ``turns`` has a bit per round."""
    n = len(k)
    own_rows = np.arange(n)
    labels, best, stale = own_rows, None, 0
    for turn in range(MAX_ROUNDS + 1):
        takes = (turns >> turn) & 1 == 1
        total = np.zeros(n, np.int64)
        np.add.at(total, labels, k)
        # (node, community) pairs, the node's own always among them.
        key = np.concatenate([dst * n + labels[src], own_rows * n + labels])
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        weight = np.add.reduceat(np.concatenate([w, np.zeros(n, np.int64)])[order], first)
        node, c = np.divmod(key[first], n)
        own = c == labels[node]
        gain = two_m * weight - k[node] * (total[c] - np.where(own, k[node], 0))
        now = np.flatnonzero(own)  # a row per node, in order
        value = two_m * (inside + int(weight[now].sum())) - int((k * total[labels]).sum())  # of the labels before this round's moves
        if best is None or value > best[1]:
            best, stale = (labels, value), 0
        else:
            stale += 1
        if stale >= PATIENCE:
            break
        there = np.flatnonzero(~own & takes[c])
        there = there[np.lexsort((c[there], -gain[there], node[there]))]
        there = there[np.concatenate([[True], node[there][1:] != node[there][:-1]])] if len(there) else there
        leaves = there[~takes[labels[node[there]]] & (gain[there] > gain[now[node[there]]])]
        labels = labels.copy()
        labels[node[leaves]] = c[leaves]
    return best


def _levels_in_memory(node, k, turns, src, dst, w, two_m: int, inside: int, value: int | None, levels: int) -> tuple[np.ndarray, int | None]:
    """(community of every node of ``node``, value) after the remaining levels; ``node`` is sorted."""
    member, at = np.arange(len(node)), np.arange(len(node))  # at: the level's nodes among all
    src, dst = np.searchsorted(node, src), np.searchsorted(node, dst)
    for _ in range(levels):
        labels, found = _level_in_memory(src, dst, w, k, turns[at], two_m, inside)
        if value is not None and found <= value:
            break
        value = found
        kept, number = np.unique(labels, return_inverse=True)
        member = number[member]
        total = np.zeros(len(kept), np.int64)
        np.add.at(total, number, k)
        # Contraction: communities are the next nodes, weights between them add up.
        pair, back = np.unique(number[src] * len(kept) + number[dst], return_inverse=True)
        merged = np.zeros(len(pair), np.int64)
        np.add.at(merged, back, w)
        src, dst = np.divmod(pair, len(kept))
        inside += int(merged[src == dst].sum())
        apart = (src != dst) & (merged > 0)
        src, dst, w, k, at = src[apart], dst[apart], merged[apart], total, at[kept]
        if not len(src):
            break
    return node[at[member]], value


def _in_one_task(flat: DataFrame, current: DataFrame, two_m: int, inside: int, value: Decimal | None, levels: int) -> tuple[DataFrame, Decimal]:
    """(labels (node, c), modularity times (2m)^2) of this level and all that follow."""
    turns = sum((F.when(_takes(t), F.lit(1 << t)).otherwise(F.lit(0)) for t in range(MAX_ROUNDS + 1)), F.lit(0)).cast("long")
    nodes = current.select(F.col("node").alias("c"), "k").select(F.lit(True).alias("is_node"), F.col("c").alias("a"), turns.alias("b"), F.col("k").alias("w"))
    rows = nodes.unionByName(flat.select(F.lit(False).alias("is_node"), F.col("src").alias("a"), F.col("dst").alias("b"), "w")).repartition(1)
    so_far = None if value is None else int(value)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(batches)
        if not got:
            return
        is_node, a, b, w = (np.concatenate([x[c].to_numpy() for x in got]) for c in ("is_node", "a", "b", "w"))
        del got
        order = np.flatnonzero(is_node)[np.argsort(a[is_node])]
        c, found = _levels_in_memory(a[order], w[order], b[order], a[~is_node], b[~is_node], w[~is_node], two_m, inside, so_far, levels)
        yield pd.DataFrame({"node": a[order], "c": c, "value": np.full(len(c), found, np.int64)})

    labels, m = _ckpt_obs(rows.mapInPandas(run, "node long, c long, value long"), value=F.max("value"))
    return labels.drop("value"), Decimal(m["value"])


def louvain(edges: DataFrame, nodes: DataFrame, max_levels: int = 20) -> tuple[DataFrame, float]:
    """(``(title, community, size)``, modularity): undirected communities of the page graph.

    ``community`` is the smallest title in it.  Directions, repeated edges and
    self-loops don't count; a page without links is a community of its own.
    Without edges the modularity is 0.
    """
    ids, enc = encode_graph(edges.select("src", "dst").distinct(), nodes)
    flat = _ckpt(symmetrize(enc).where(F.col("src") != F.col("dst")).withColumn("w", F.lit(1).cast("long")))
    two_m = flat.count()
    member = ids.select("id", F.col("id").alias("node"))
    value, inside = None, 0
    current = _ckpt(flat.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")))
    for level in range(max_levels if two_m else 0):
        if flat.count() <= ONE_TASK_EDGES and _exact(two_m) == "long":
            labels, value = _in_one_task(flat, current, two_m, inside, value, max_levels - level)
            member = _ckpt(member.join(labels, "node", "left").select("id", F.coalesce("c", "node").alias("node")))
            break
        labels, keyed, found = _one_level(flat, current, two_m, inside)
        if value is not None and found <= value:
            keyed.unpersist()
            break
        value = found
        pairs = _pairs(keyed, labels)
        labels = labels.select("node", "c")
        member = _ckpt(member.join(labels, "node", "left").select("id", F.coalesce("c", "node").alias("node")))
        # Contraction: communities are the next nodes, weights between them add up.
        merged = pairs.select("node", F.col("c").alias("src"), "w").join(labels.select("node", F.col("c").alias("dst")), "node")
        merged, m = _ckpt_obs(merged.groupBy("src", "dst").agg(F.sum("w").alias("w")), inside=F.sum(F.when(F.col("src") == F.col("dst"), F.col("w"))))
        keyed.unpersist()
        inside += int(m["inside"] or 0)
        flat = merged.where((F.col("src") != F.col("dst")) & (F.col("w") > 0))
        current = _ckpt(current.join(labels, "node").groupBy(F.col("c").alias("node")).agg(F.sum("k").alias("k")))
        if flat.isEmpty():
            break
    # The smallest id stands for the smallest title.
    least = member.groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"))
    named = member.join(least, "node").join(ids, "id").select("title", "least", "size")
    out = named.join(ids.select(F.col("id").alias("least"), F.col("title").alias("community")), "least").select("title", "community", "size")
    return out, float(value / Decimal(two_m) ** 2) if value is not None else 0.0


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (``modularity``): of ``labels (title, community)`` on the undirected simple graph of ``edges``."""
    flat = symmetrize(edges.select("src", "dst")).where(F.col("src") != F.col("dst"))
    a = flat.join(labels.select(F.col("title").alias("src"), F.col("community").alias("a")), "src")
    both = a.join(labels.select(F.col("title").alias("dst"), F.col("community").alias("b")), "dst")
    per = both.groupBy("a").agg(F.count(F.lit(1)).alias("deg"), F.count_if(F.col("a") == F.col("b")).alias("inside"))
    total = per.agg(F.sum("deg").cast("double").alias("m2"), F.sum("inside").alias("inside"), F.sum(F.col("deg").cast(_EXACT) * F.col("deg").cast(_EXACT)).cast("double").alias("sq"))
    return total.select(F.coalesce(F.col("inside") / F.col("m2") - F.col("sq") / (F.col("m2") * F.col("m2")), F.lit(0.0)).alias("modularity"))
