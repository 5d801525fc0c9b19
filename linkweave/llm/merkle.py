"""Merkle dataset manifest as a postorder append log (operator 12).

Every row is a leaf; the leaves of a source, in ascending doc_id, form a tree of
fan-out ``FAN``, and the sources' roots form the tree above them.  Nodes are
written in completion order: a node follows its last child.  In that order the
place of a node is a closed form of the subtree sizes (:func:`position`), so a
proof is a list of computed places and nothing has to be searched.

Builders are aligned: one takes the ``FAN ** LEVELS`` leaves of a subtree, or
the tops of as many such subtrees in the next round, so that no builder waits
for another and a source that holds a third of all rows has as many builders as
it has subtrees.  Only digests are shuffled; a builder holds one path of open
nodes, an extractor the nodes of one subtree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.llm.common import fixed, lower_ascii, shuffle_partitions
from linkweave.operators.ranking import dense_rank_table

FAN, FAN_BITS = 16, 4
LEVELS = 3  # levels that one builder completes: FAN ** LEVELS nodes go in
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_MOD = 5


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    h = 0
    while FAN**h < n:
        h += 1
    return h


def width(n: int, level: int) -> int:
    """Number of nodes on a level of a tree of n leaves."""
    return -(-n // FAN**level)


def position(n: int, level: int, index: int) -> int:
    """Postorder place of a node among all nodes of a tree of n leaves.

    Before the last leaf of the node stand the leaves to its left and the
    subtrees that end there; the node follows it, after one node per level.
    """
    last = min((index + 1) * FAN**level, n) - 1
    before, left = last, last // FAN
    while left:
        before, left = before + left, left // FAN
    return before + level


def digest_of(parts: list[bytes]) -> bytes:
    """H of digests: SHA-256 over their concatenated hexadecimal texts."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def leaf_digest(text: Column | None = None) -> Column:
    """H of a row's fields: ``-`` for null, else byte count, colon, value."""

    def field(c: Column) -> Column:
        value = c.cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    values = [F.col(c) if c != "text" or text is None else text for c in FIELDS]
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


def _height(n: Column) -> Column:
    return sum(((n > F.lit(FAN**k)).cast("int") for k in range(1, 15)), (n > F.lit(1)).cast("int"))


_LOG = "tree string, n long, level int, idx long, pos long, digest binary"
_LOG_ARROW = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("pos", pa.int64()), ("digest", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _build(base: int, levels: int):
    """Nodes of level ``base`` sorted by (tree, idx) -> the nodes above them, in completion order."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        out, now, pending, top = [], None, [], 0

        def push(level: int, index: int, value: bytes):
            tree, _, n = now
            if level > base or base == 0:
                out.append((tree, n, level, index, position(n, level, index), value))
            if level < top:
                pending[level - base].append(value)
                if len(pending[level - base]) == FAN:
                    close(level, index)

        def close(level: int, index: int):
            run, pending[level - base] = pending[level - base], []
            push(level + 1, index // FAN, digest_of(run))

        def finish():
            # Only the last run of a level can be short; it ends with the level's last node.
            for level in range(base, top):
                if pending[level - base]:
                    close(level, width(now[2], level) - 1)

        for batch in batches:
            for tree, n, index, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = (tree, index // FAN**levels, n)
                if key != now:
                    if now is not None:
                        finish()
                    now, top = key, min(base + levels, height(n))
                    pending = [[] for _ in range(levels)]
                push(base, index, value)
            if len(out) > 8192:
                yield _batch(out, _LOG_ARROW)
                out.clear()
        if now is not None:
            finish()
        if out:
            yield _batch(out, _LOG_ARROW)

    return run


def append_log(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The nodes (tree, n, level, idx, pos, digest) of all trees over leaves (tree, n, idx, digest).

    ``n`` is the number of leaves of the tree.  One round of builders per
    ``levels`` levels; a round reads the tops that the round before completed.
    """
    parts = shuffle_partitions(leaves.sparkSession)
    nodes, log, base = leaves.select("tree", "n", "idx", "digest"), None, 0
    while True:
        dealt = nodes.withColumn("block", F.shiftright("idx", FAN_BITS * levels)).repartition(parts, "tree", "block")
        built = dealt.sortWithinPartitions("tree", "idx").select("tree", "n", "idx", "digest").mapInArrow(_build(base, levels), _LOG)
        built = fixed(built)
        log, base = built if log is None else log.unionByName(built), base + levels
        nodes = built.where((F.col("level") == base) & (_height(F.col("n")) > base))
        if nodes.isEmpty():
            return log


def _chain(steps: list[tuple[int, list[bytes]]]) -> bytes:
    return b"".join(bytes([own, len(run)]) + b"".join(run) for own, run in steps)


def _steps(chain: bytes) -> list[tuple[int, list[bytes]]]:
    out, at = [], 0
    while at < len(chain):
        own, size = chain[at], chain[at + 1]
        out.append((own, [chain[at + 2 + 32 * k : at + 34 + 32 * k] for k in range(size)]))
        at += 2 + 32 * size
    return out


class _Segment:
    """The nodes of one aligned subtree by place, with the runs on the way from it to the root."""

    def __init__(self, n: int, base: int, levels: int):
        self.n, self.base, self.top = n, base, min(base + levels, height(n))
        self.nodes: dict[int, bytes] = {}
        self.tail: list[tuple[int, list[bytes]]] = []
        self.runs: dict[tuple[int, int], list[bytes]] = {}

    def run(self, level: int, k: int) -> list[bytes]:
        """The k-th run of a level, read by the closed form of its places."""
        if (level, k) not in self.runs:
            ends = min(FAN * (k + 1), width(self.n, level))
            self.runs[level, k] = [self.nodes[position(self.n, level, j)] for j in range(FAN * k, ends)]
        return self.runs[level, k]

    def steps(self, index: int) -> list[tuple[int, list[bytes]]]:
        """(own place, run) per level from a node of the base level up to the root of all."""
        out = []
        for level in range(self.base, self.top):
            out.append((index % FAN, self.run(level, index // FAN)))
            index //= FAN
        return out + self.tail


def proof_of(steps) -> bytes:
    """Siblings of a leaf, level by level, left to right, as hexadecimal text."""
    return "".join(run[k].hex() for own, run in steps for k in range(len(run)) if k != own).encode()


def fold(value: bytes, steps) -> bytes:
    """The root that a leaf digest gives with the siblings of its proof."""
    for own, run in steps:
        value = digest_of([value if k == own else d for k, d in enumerate(run)])
    return value


_PATHS = "tree string, n long, idx long, chain binary, subroot binary"
_PROOFS = "tree string, idx long, doc_id long, leaf binary, subroot binary, proof_sha256 string, folded_root binary"


def _extract(base: int, levels: int, prove: bool):
    """Rows (tree, block, kind, at, n, digest, doc_id, extra) sorted by the first four: tail, nodes, then questions.

    Returns the path to the root of every question, or, with ``prove``, the
    leaf's proof digest and the root folded from its (possibly forged) digest.
    """
    schema = pa.schema(
        [("tree", pa.string()), ("idx", pa.int64()), ("doc_id", pa.int64()), ("leaf", pa.binary()), ("subroot", pa.binary()), ("proof_sha256", pa.string()), ("folded_root", pa.binary())]
        if prove
        else [("tree", pa.string()), ("n", pa.int64()), ("idx", pa.int64()), ("chain", pa.binary()), ("subroot", pa.binary())]
    )

    def run(batches) -> Iterator[pa.RecordBatch]:
        out, now, seg, subroot = [], None, None, None
        for batch in batches:
            for tree, block, kind, at, n, value, doc_id, extra in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (tree, block) != now:
                    now, seg = (tree, block), _Segment(n, base, levels)
                if kind == 0:
                    seg.tail, subroot = _steps(value), extra
                elif kind == 1:
                    seg.nodes[at] = value
                elif prove:
                    steps = seg.steps(at)
                    out.append((tree, at, doc_id, value, subroot, hashlib.sha256(proof_of(steps)).hexdigest(), fold(extra or value, steps)))
                else:
                    out.append((tree, n, at, _chain(seg.steps(at)), subroot))
            if len(out) > 4096:
                yield _batch(out, schema)
                out.clear()
        if out:
            yield _batch(out, schema)

    return run


def _paths(log: DataFrame, tails: DataFrame, base: int, levels: int, asked: DataFrame | None = None) -> DataFrame:
    """Paths of the nodes of level ``base``, or proofs of the leaves ``asked`` (tree, n, idx, digest, doc_id, forged).

    ``tails`` (tree, n, idx, chain, subroot) has the path of every subtree's top, under the subtree's number.
    """
    parts = shuffle_partitions(log.sparkSession)
    none, no_id = F.lit(None).cast("binary"), F.lit(None).cast("long")
    block = F.shiftright("idx", FAN_BITS * levels)
    inside = log.where(F.col("level").between(base, base + levels) & (_height(F.col("n")) >= F.lit(base)))
    # A node's subtree number; the tops of the round serve as the next round's base and are not needed here.
    number = F.coalesce(*[F.when(F.col("level") == base + k, F.shiftright("idx", FAN_BITS * (levels - k))) for k in range(levels)])
    nodes = inside.where(F.col("level") < base + levels).select("tree", number.alias("block"), F.lit(1).alias("kind"), F.col("pos").alias("at"), "n", "digest", no_id.alias("doc_id"), none.alias("extra"))
    first = tails.select("tree", F.col("idx").alias("block"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), "n", F.col("chain").alias("digest"), no_id.alias("doc_id"), F.col("subroot").alias("extra"))
    if asked is None:
        question = log.where(F.col("level") == base).select("tree", block.alias("block"), F.lit(2).alias("kind"), F.col("idx").alias("at"), "n", "digest", no_id.alias("doc_id"), none.alias("extra"))
    else:
        question = asked.select("tree", block.alias("block"), F.lit(2).alias("kind"), F.col("idx").alias("at"), "n", "digest", "doc_id", F.col("forged").alias("extra"))
    # Only subtrees of this round have a tail.
    rows = first.unionByName(nodes).unionByName(question).repartition(parts, "tree", "block").sortWithinPartitions("tree", "block", "kind", "at")
    return rows.mapInArrow(_extract(base, levels, asked is not None), _PATHS if asked is None else _PROOFS)


def _all_paths(log: DataFrame, tops: DataFrame, levels: int, asked: DataFrame | None = None) -> DataFrame:
    """Paths of all leaves of the log's trees (or proofs of ``asked``), given the paths ``tops`` of the trees' roots."""
    most = log.agg(F.max("n")).first()[0] or 1
    last = max(1, -(-height(most) // levels)) - 1
    round_of = F.greatest(F.ceil(_height(F.col("n")) / levels).cast("int"), F.lit(1)) - 1
    above = None
    for r in range(last, -1, -1):
        tails = tops.where(round_of == r)
        if above is not None:
            tails = tails.unionByName(above)
        part = log.where(round_of >= r)
        if r == 0 and asked is not None:
            return _paths(part, tails, 0, levels, asked)
        above = fixed(_paths(part, tails, r * levels, levels))
    return above


def manifest(docs: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves, log of the sources' trees, log of the tree above them).

    Leaves: tree (the source), n, idx, digest, doc_id, forged (the digest of a
    tampered row, null if the row isn't tampered).
    """
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_MOD == 0
    rows = docs.select(
        F.col("source").cast("string").alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_digest().alias("digest"),
        F.when(tampered, leaf_digest(lower_ascii(F.col("text").cast("string")))).alias("forged"),
    )
    leaves = fixed(dense_rank_table(rows, ["doc_id", "digest"], within=["tree"], name="idx", size="n"))
    log = append_log(leaves, levels)
    roots = log.where(F.col("level") == _height(F.col("n"))).select("tree", "digest")
    # A null source is a tree of its own and sorts first; Spark compares strings by their UTF-8 bytes.
    ranked = fixed(dense_rank_table(roots, ["tree"], name="idx", size="n"))
    top = append_log(ranked.select(F.lit("").alias("tree"), "n", "idx", "digest"), levels)
    return leaves, log, top.join(ranked.select(F.col("tree").alias("source"), F.col("idx").alias("i")), (F.col("idx") == F.col("i")) & (F.col("level") == 0), "left").drop("i")


def prove(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row per document: doc_id, source, idx, position, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``idx`` numbers the source's leaves by doc_id (null first, repeated ids by
    digest), ``position`` is the leaf's place in the postorder log of its
    source.  Null fields hash as ``-``; a null source is a source, a null doc_id
    is never tampered with.  Equal rows are leaves of their own with equal
    digests.  An empty table has no tree and gives an empty result.
    """
    leaves, log, top = manifest(docs, levels)
    top = fixed(top)
    whole = top.where(F.col("level") == _height(F.col("n"))).first()
    root = bytes(whole["digest"]) if whole else b""
    start = top.where("level = 0 AND idx = 0").select("tree", "n", F.lit(0).cast("long").alias("idx"), F.lit(b"").alias("chain"), "digest").withColumnRenamed("digest", "subroot")
    upper = _all_paths(top.drop("source"), start, levels) if whole else start
    # Path and root of every source's tree.
    named = top.where("level = 0").select("source", F.col("idx").alias("i"), F.col("digest").alias("subroot"))
    tops = upper.select("idx", "chain").join(named, F.col("idx") == F.col("i")).select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("idx"), "chain", "subroot")
    sizes = log.where("level = 0 AND idx = 0").select(F.col("tree").alias("t"), "n")
    tops = fixed(tops.join(sizes, tops["tree"].eqNullSafe(sizes["t"])).select("tree", "n", "idx", "chain", "subroot"))
    found = _all_paths(log, tops, levels, leaves)
    n_before = sum((F.floor(F.col("idx") / F.lit(FAN**k)) for k in range(1, 15)), F.col("idx"))

    def hexed(c: str) -> Column:
        return F.lower(F.hex(F.col(c)))

    return found.select(
        "doc_id", F.col("tree").alias("source"), "idx", n_before.cast("long").alias("position"), hexed("leaf").alias("leaf"), hexed("subroot").alias("subroot"), F.lit(root.hex()).alias("root"),
        "proof_sha256", hexed("folded_root").alias("folded_root"), (F.col("folded_root") == F.lit(root)).alias("verified"),
    )
