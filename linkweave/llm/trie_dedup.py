"""Exact deduplication with Patricia-trie owners (operator 3).

Texts are equal when identical after lower-casing A-Z.  Each map task first
merges its own copies in a compressed radix trie over the full byte strings;
what is left is partitioned by (byte length, bucket of the content hash), and
the owner of a partition inserts all its byte strings into one trie, whose
terminal nodes store the chosen identifier and the number of copies; the trie's
terminals are the groups.

Bounded memory: a map trie above ``trie_bytes`` spills its largest root subtree
as partial rows to the next stage (Spark's shuffle files are the spill store).
An owner's rows come in byte order inside (length, bucket), so every subtree
left of the last key's path is complete: above ``trie_bytes`` these leave memory
as results.  A text that a third of all rows share reaches its owner as one row
per map task and spill, not as one row per document, and a length that a third
of all rows share is ``HASH_BUCKETS`` owners.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.common import bounded_batches, lower_ascii, shuffle_partitions, text_of

TRIE_BYTES = 32 << 20
HASH_BUCKETS = 1 << 12
_PARTIAL = "text string, text_sha256 string, n_bytes int, ident long, copies long"


class _Node:
    __slots__ = ("copies", "ident", "kids", "label", "terminal")

    def __init__(self, label: bytes):
        self.label, self.kids, self.terminal, self.ident, self.copies = label, {}, None, None, 0


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the longest common prefix of ``a`` and ``b[at:]``, by halving."""
    n = min(len(a), len(b) - at)
    if a[:n] == b[at : at + n]:
        return n
    low, high = 0, n  # a[:low] matches, a[:high] does not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid
    return low


class PatriciaTrie:
    """Compressed radix trie over byte strings; terminals keep the best identifier and a count."""

    def __init__(self, best):
        self.best, self.root, self.size = best, _Node(b""), 0

    def insert(self, key: bytes, payload, ident: int | None, copies: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                kid = _Node(key[at:])
                node.kids[key[at]] = kid
                self.size += len(kid.label) + 200
                node, at = kid, len(key)
                break
            n = _common(kid.label, key, at)
            if n < len(kid.label):  # split the edge
                mid = _Node(kid.label[:n])
                kid.label = kid.label[n:]
                mid.kids[kid.label[0]] = kid
                node.kids[key[at]] = mid
                self.size += 200
                kid = mid
            node, at = kid, at + n
        if node.terminal is None:
            node.terminal, node.ident, node.copies = payload, ident, copies
        else:
            node.copies += copies
            if ident is not None:
                node.ident = ident if node.ident is None else self.best(node.ident, ident)

    @staticmethod
    def walk(node: _Node, prefix: bytes) -> Iterator[tuple[bytes, object, int | None, int]]:
        stack = [(node, prefix)]
        while stack:
            x, head = stack.pop()
            key = head + x.label
            if x.terminal is not None:
                yield key, x.terminal, x.ident, x.copies
            stack.extend((k, key) for k in x.kids.values())

    def spill(self) -> Iterator[tuple[bytes, object, int | None, int]]:
        """Take the largest subtree below the root out of memory."""
        if not self.root.kids:
            return
        sizes = {k: sum(len(key) for key, *_ in self.walk(x, b"")) for k, x in self.root.kids.items()}
        first = max(sizes, key=sizes.get)
        node = self.root.kids.pop(first)
        yield from self.walk(node, b"")
        self.size = sum(len(x.label) + 200 for kid in self.root.kids.values() for x in _nodes(kid))

    def settle(self, last: bytes) -> Iterator[tuple[bytes, object, int | None, int]]:
        """With keys in byte order, take all but the last key out of memory: they cannot come again."""
        held = None
        for key, payload, ident, copies in self.walk(self.root, b""):
            if key == last:
                held = (key, payload, ident, copies)
            else:
                yield key, payload, ident, copies
        self.root, self.size = _Node(b""), 0
        if held is not None:
            self.insert(*held)

    def drain(self) -> Iterator[tuple[bytes, object, int | None, int]]:
        yield from self.walk(self.root, b"")
        self.root, self.size = _Node(b""), 0


def _nodes(node: _Node):
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(x.kids.values())


def _batches(rows: list) -> pa.RecordBatch:
    texts, shas, sizes, ids, counts = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(texts, pa.string()), pa.array(shas, pa.string()), pa.array(sizes, pa.int32()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64())],
        names=["text", "text_sha256", "n_bytes", "ident", "copies"],
    )


def _out(found, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for key, (sha,), ident, copies in found:
        rows.append((key.decode("utf-8", "surrogatepass"), sha, len(key), ident, copies))
        size += len(key) + 100
        if size > limit:
            yield _batches(rows)
            rows, size = [], 0
    if rows:
        yield _batches(rows)


def _rows(batch: pa.RecordBatch):
    cols = [batch.column(i) for i in range(5)]
    for i in range(batch.num_rows):
        yield cols[0][i].as_buffer().to_pybytes(), cols[1][i].as_py(), cols[2][i].as_py(), cols[3][i].as_py(), cols[4][i].as_py()


def _map_side(best, trie_bytes: int):
    def run(batches):
        trie = PatriciaTrie(best)
        for batch in batches:
            for key, sha, _, ident, copies in _rows(batch):
                trie.insert(key, (sha,), ident, copies)
                while trie.size > trie_bytes:
                    yield from _out(trie.spill())
        yield from _out(trie.drain())

    return run


def _owner_side(best, trie_bytes: int):
    def run(batches):
        trie, done, now = PatriciaTrie(best), [], None

        def take(found):
            # A terminal's string is its text; owners return the digest, not the text.
            done.extend(("", sha, len(key), ident, copies) for key, (sha,), ident, copies in found)

        for batch in batches:
            for key, sha, n, ident, copies in _rows(batch):
                part = (n, _bucket_of(sha))
                if part != now:  # rows come by (length, bucket): the trie before is complete
                    take(trie.drain())
                    now = part
                trie.insert(key, (sha,), ident, copies)
                if trie.size > trie_bytes:
                    take(trie.settle(key))
                if len(done) >= 4096:
                    yield _batches(done)
                    done.clear()
        take(trie.drain())
        if done:
            yield _batches(done)

    return run


def _bucket_of(sha: str) -> int:
    return int(sha[:8], 16) % HASH_BUCKETS


def _bucket_column():
    return (F.conv(F.substring("text_sha256", 1, 8), 16, 10).cast("long") % HASH_BUCKETS).cast("int")


def owners(docs: DataFrame, keep: str = "min", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct normalised text: text_sha256, n_bytes, keep_id, group_size.

    ``keep`` says which identifier a terminal stores: ``min`` or ``max`` doc_id.
    """
    best = {"min": min, "max": max}[keep]
    bounded_batches(docs.sparkSession)
    rows = docs.select(lower_ascii(text_of()).alias("text"), F.col("doc_id").cast("long").alias("ident")).select(
        "text", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.octet_length("text").cast("int").alias("n_bytes"), "ident", F.lit(1).cast("long").alias("copies")
    )
    partial = rows.mapInArrow(_map_side(best, trie_bytes), _PARTIAL)
    dealt = partial.withColumn("bucket", _bucket_column()).repartition(shuffle_partitions(docs.sparkSession), "n_bytes", "bucket")
    dealt = dealt.sortWithinPartitions("n_bytes", "bucket", "text").drop("bucket")
    own = dealt.mapInArrow(_owner_side(best, trie_bytes), _PARTIAL)
    return own.select("text_sha256", "n_bytes", F.col("ident").alias("keep_id"), F.col("copies").alias("group_size"))


def exact_dedup(docs: DataFrame, keep: str = "min", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty.  Null ids never win against an id; in a group
    without any id ``keep_id`` is null and one of its rows is kept.  Of rows
    that repeat the winning doc_id exactly one is kept.  An empty table gives
    an empty result.
    """
    own = owners(docs, keep, trie_bytes)
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(lower_ascii(text_of()).cast("binary"), 256).alias("sha"))
    counted = mine.groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("times"))
    joined = counted.join(own, F.col("sha") == F.col("text_sha256")).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
