"""Shared column rules and helpers of the training-data operators.

Null rules used throughout: a null text is read as the empty text, a null
``doc_id`` never takes part in learning.  Operators read only the columns they
name, so extra columns of any name cannot clash with their working columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.session import checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLDS = 5
BROADCAST_PAIRS = 400_000  # id and digest: some 100 bytes each as a hash table
ARROW_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, UPPER, LOWER)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 5 = 0; a null id counts as held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def uniform(*parts) -> Column:
    """Hash draw in (0, 1): 52 bits of xxhash64 over the parts, never 0 or 1."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 12)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def fixed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the session's shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``ARROW_BYTES`` for the session's Python stages: texts have any length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """Broadcast hint for a frame whose counted ``rows`` stay within ``max_rows``; else no hint."""
    return F.broadcast(df) if rows <= max_rows else df


def text_hash(col: str = "text") -> Column:
    """SHA-256 of a text with A-Z lower-cased; a null text counts as empty."""
    return F.sha2(lower_ascii(text_of(col)).cast("binary"), 256)


def one_row_per_text(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text hash) is in ``chosen`` (doc_id, text_sha256), one row for each.

    A null doc_id is an identity like any other here.  Of rows with one doc_id
    and equal texts up to A-Z case the least by text, then by the other columns,
    stays.  The decision is made on the pairs; the rows themselves only lose
    those of the pairs that go, so that whole texts are not shuffled while these
    are few (at most ``BROADCAST_PAIRS``, counted).
    """
    on = ["_lw_id", "_lw_sha"]

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({"_lw_id": F.col("doc_id").cast("long"), "_lw_sha": F.unhex(text_hash())})

    def same(a: DataFrame, b: DataFrame) -> Column:
        return a["_lw_id"].eqNullSafe(b["_id"]) & (a["_lw_sha"] == b["_sha"])

    pairs = chosen.select(F.col("doc_id").cast("long").alias("_id"), F.unhex("text_sha256").alias("_sha")).distinct()
    short = keyed(docs).select(*on).groupBy(*on).count()
    # Per pair that does not pass as it is: 0 if it goes, else how often it is there.
    judged = short.join(pairs, same(short, pairs), "left")
    left = F.when(F.col("_sha").isNull(), 0).otherwise(F.col("count"))
    judged = fixed(judged.select(F.col("_lw_id").alias("_id"), F.col("_lw_sha").alias("_sha"), left.alias("left")).where("left != 1"))
    n, repeats = judged.agg(F.count(F.lit(1)), F.count_if(F.col("left") > 1)).first()
    touched = small(judged.select("_id", "_sha"), n, BROADCAST_PAIRS)
    all_rows = keyed(docs)
    kept = all_rows.join(touched, same(all_rows, touched), "left_anti").select(*docs.columns)
    if not repeats:
        return kept
    repeated = judged.where("left > 1").select("_id", "_sha")
    all_rows = keyed(docs)
    # min over a struct keeps whole rows and is combined before the shuffle.
    cols = ["text", *[c for c in docs.columns if c != "text"]]
    one = all_rows.join(repeated, same(all_rows, repeated), "left_semi").groupBy(*on).agg(F.min(F.struct(*cols)).alias("row"))
    return kept.unionByName(one.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def blocks(items: Iterable, sizes: Iterable[int], limit: int) -> Iterator[list]:
    """Consecutive lists of items whose sizes sum to about ``limit`` (at least one item each)."""
    out, total = [], 0
    for item, size in zip(items, sizes, strict=True):
        if out and total + size > limit:
            yield out
            out, total = [], 0
        out.append(item)
        total += size
    if out:
        yield out


def _edge_digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component = least node) of the undirected edges (u, v), by alternating large and small stars.

    Each round rewires neighbours to the least node seen; rounds stop when the
    edge set no longer changes, in O(log^2 n) rounds.  Per-node minima are
    combined before the shuffle, so a hub costs one row per task; the join that
    spreads a minimum over a hub's edges can be split by the adaptive skew join.
    """
    e = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = fixed(e.distinct())
    digest = _edge_digest(e)
    while digest[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        pulled = large.join(least, F.col("u") == F.col("k")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = fixed(pulled.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
        digest, before = _edge_digest(e), digest
        if digest == before:
            break
    star = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
