"""Mixing sources to target weights (operator 5), DataFrame functions only.

Words are counted once per document and summed per source; the targets follow
by water-filling over the source table; each document is then emitted
floor(rate) times plus one more with probability equal to the fraction, where
rate = target / source size.  The extra copy is a Bernoulli draw on a hash of
the doc_id and a seed.  All candidate seeds of a source are summed in one
aggregate and the one that lands nearest its target is taken, so small sources
with a few long documents stay near their targets as well.

Scale: documents leave their tasks as partial sums per source only.  The source
table is broadcast while it is small (counted); beyond that it meets the
documents in a shuffled join, which Spark can split when one source is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.common import fixed, small, text_of
from linkweave.operators.ranking import dense_rank_table

WEIGHTS = (5, 2, 1)
CAP = 3
SEEDS = 64
BROADCAST_SOURCES = 200_000  # a name and six numbers each: some tens of MB
WORD = r"[^\x20\x09-\x0D]+"


def n_words():
    """Number of WORD matches in the text: runs are cut to one mark each, then counted."""
    marks = F.regexp_replace(text_of(), r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "\x01")
    return F.length(F.regexp_replace(marks, r"^[\x20\x09-\x0D]+", "")).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) by water-filling; ``sizes`` has (source, source_size).

    Sources in code-point order, null last, take the weights in turn.  Every
    round shares what capped sources leave over among the others by weight; it
    returns to the driver two sums only.  Rounds end when no further source
    reaches its cap.
    """
    ordered = sizes.select("source", "source_size", F.col("source").isNull().alias("last"))
    ranked = dense_rank_table(ordered, ["last", "source"], name="place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    src = fixed(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * cap).alias("most")))
    total = src.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, None
    while True:
        capped = (F.col("weight") * level >= F.col("most")) if full is not None else F.lit(False)
        used, free, n = src.agg(F.sum(F.when(capped, F.col("most"))), F.sum(F.when(~capped, F.col("weight"))), F.count_if(capped)).first()
        if n == full or not free:
            break
        full, level = n, (total - (used or 0)) / free
    target = F.when(F.col("weight") * level >= F.col("most"), F.col("most").cast("double")).otherwise(F.col("weight") * level)
    return src.select("source", "source_size", target.cast("double").alias("target"))


def _draw_key():
    """What a document's draw is made from: its doc_id, or a digest of the text where it has none."""
    return F.coalesce(F.col("doc_id").cast("string"), F.md5(text_of().cast("binary")))


def _draw(seed):
    """Hash draw in [0, 1) of the document: 52 bits of an md5, which other engines can repeat."""
    digest = F.md5(F.concat_ws(":", seed.cast("string"), F.col("key")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _with_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    return rows.join(table, rows["source"].eqNullSafe(table["s"]))


def source_rates(sized: DataFrame, weights=WEIGHTS, cap: int = CAP, seeds: int = SEEDS) -> DataFrame:
    """Per source (``s``): source_size, target, whole and part of the rate, and the seed whose draws land nearest the target.

    ``sized`` has (key, source, size).  The frame carries a broadcast hint while
    there are at most ``BROADCAST_SOURCES`` sources (counted).
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = fixed(source_targets(sizes, weights, cap))
    n = targets.count()
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    rates = targets.select(F.col("source").alias("s"), "source_size", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("part"))
    tries = [F.sum(F.when(_draw(F.lit(k)) < F.col("part"), F.col("size")).otherwise(0)).alias(f"s{k}") for k in range(seeds)]
    trial = _with_source(sized, small(rates, n, BROADCAST_SOURCES)).groupBy("s", "source_size", "target", "whole", "part").agg(*tries)
    miss = F.array(*[F.struct(F.abs(F.col("whole") * F.col("source_size") + F.col(f"s{k}") - F.col("target")).alias("miss"), F.lit(k).alias("seed")) for k in range(seeds)])
    chosen = fixed(trial.select("s", "source_size", "target", "whole", "part", F.array_min(miss)["seed"].alias("seed")))
    return small(chosen, n, BROADCAST_SOURCES)


def _copies():
    return (F.col("whole") + F.when(_draw(F.col("seed")) < F.col("part"), 1).otherwise(0)).cast("long")


def _sized(docs: DataFrame) -> DataFrame:
    return fixed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _draw_key().alias("key"), F.col("source").cast("string").alias("source"), n_words().alias("size")))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seeds: int = SEEDS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    Null text has size 0; a null source is a source of its own, last in order;
    a document without an id is drawn by its text; rows that repeat a doc_id (or
    an id-less text) share a draw.  Sources of size 0 get target 0.  An empty
    table gives an empty result.
    """
    sized = _sized(docs)
    out = _with_source(sized, source_rates(sized, weights, cap, seeds)).withColumn("copies", _copies())
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document row ``copies`` times, with the columns of ``docs``.

    A row's copies follow from its source's rate and its own draw, so texts stay
    where they are while the sources are few enough to broadcast.
    """
    rates = source_rates(_sized(docs), **options)
    names = {c: f"_lw_{i}" for i, c in enumerate(docs.columns)}
    keep = docs.select(*[F.col(c).alias(n) for c, n in names.items()], _draw_key().alias("key"), F.col("source").cast("string").alias("source"))
    drawn = _with_source(keep, rates).withColumn("copies", _copies()).where("copies > 0")
    repeated = drawn.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*[F.col(n).alias(c) for c, n in names.items()])


MIX_SQL = f"""WITH sized AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS key, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [{", ".join(f"{x}.0" for x in WEIGHTS)}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT]::DOUBLE AS weight FROM src),
-- Sources reach their cap in the order of cap / weight.
o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS pos FROM w),
c AS (SELECT *, coalesce(sum({CAP} * source_size) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
             sum(weight) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
             sum(source_size) OVER () AS total FROM o),
lv AS (SELECT (total - used)::DOUBLE / free AS level FROM c WHERE (total - used)::DOUBLE / free * weight < {CAP} * source_size ORDER BY pos LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN weight * level >= {CAP} * source_size THEN ({CAP} * source_size)::DOUBLE ELSE weight * level END AS target
      FROM w LEFT JOIN lv ON true),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, {CAP}.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM t),
d AS (SELECT s.doc_id, s.key, s.size, r.*, floor(rate) AS whole, rate - floor(rate) AS part FROM sized s JOIN r ON s.source IS NOT DISTINCT FROM r.source),
k AS (SELECT d.*, seed, ('0x' || substr(md5(seed::VARCHAR || ':' || key), 1, 13))::BIGINT::DOUBLE / {float(1 << 52)!r} < part AS extra
      FROM d, range({SEEDS}) q(seed)),
m AS (SELECT source, seed, abs(max(whole) * max(source_size) + sum(CASE WHEN extra THEN size ELSE 0 END) - max(target)) AS miss FROM k GROUP BY source, seed),
b AS (SELECT source, seed FROM m QUALIFY row_number() OVER (PARTITION BY source ORDER BY miss, seed) = 1)
SELECT k.doc_id, k.size, k.source_size, k.target, ((k.whole + CASE WHEN k.extra THEN 1 ELSE 0 END) * k.size)::BIGINT AS taken
FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source AND k.seed = b.seed"""
