"""SpotSigs document fingerprints (operator 9), DataFrame functions only.

A spot signature is a common-word anchor followed by a chain of the next
content words; a document's fingerprint is the set of its signatures (32-bit
hashes, sorted, written in hexadecimal).  Sets are partitioned by length, in
partitions of a ratio of ``1 / PRUNE``: sets of the same or neighbouring
partitions get their exact Jaccard value, two that lie further apart cannot be
alike beyond ``PRUNE`` and get likeness 0 without a comparison.

Each text meets the next document's by one shuffle of the texts: ranges of
doc_id (bounds from quantiles) are window partitions, and the first document of
every range is also sent to the range before, so that no window spans the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.llm.common import fixed, shuffle_partitions, text_of

#: Anchors, the common function words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be by for from has he in is it of on or that the this to was were which with "
    "au aux avec ce dans de des du elle en est et il je la le les ne par pas pour que qui se sur un une "
    "auf das dem den der die ein eine für ich ist mit nicht sich und von zu "
    "al como con del el es esta las lo los más no para por su una y"
).split()
CHAIN = 2
PRUNE = 0.1
RANGES_PER_PARTITION = 4


def with_signatures(df: DataFrame, text: str, out: str, anchors=ANCHORS) -> DataFrame:
    """``df`` plus ``out``: sorted distinct 32-bit signature hashes of the column ``text``.

    A signature joins an anchor and the ``CHAIN`` content words after it (a
    missing second word is empty).  A text with words but no spot has one
    signature, the hash of the whole text; an empty text has none.  The steps
    are separate columns, each used more than once by the next, so the optimizer
    keeps them apart and every array is built once per row; no lambda refers to
    a column outside it.
    """
    anchors = sorted(set(anchors))
    keep = df.columns
    words = df.withColumn("_words", F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
    pairs = F.arrays_zip(F.concat("_words", F.array(F.lit(""))).alias("word"), F.concat(F.array(F.lit("")), F.col("_words")).alias("prev"))
    content = words.select(*keep, F.filter(pairs, lambda p: (p["word"] != "") & ~p["word"].isin(anchors)).alias("_content"))
    # Each content word (after its predecessor in the text) beside the next content word.
    after = F.concat(F.transform(F.slice("_content", 2, F.greatest(F.size("_content") - 1, F.lit(0))), lambda p: p["word"]), F.array(F.lit("")))
    chains = F.filter(F.arrays_zip(F.col("_content").alias("here"), after.alias("after")), lambda z: z["here"]["prev"].isin(anchors))
    hashes = F.transform(chains, lambda z: F.xxhash64(z["here"]["prev"], z["here"]["word"], z["after"]).bitwiseAND(F.lit(0xFFFFFFFF)))
    found = content.select(*keep, F.array_sort(F.array_distinct(hashes)).alias("_found"))
    whole = F.array(F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)))
    sigs = F.when(F.col(text) == "", F.array().cast("array<long>")).when(F.size("_found") == 0, whole).otherwise(F.col("_found"))
    return found.select(*keep, sigs.alias(out))


def to_text(sigs: Column) -> Column:
    return F.concat_ws("", F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0")))


def length_class(sigs: Column) -> Column:
    """Partition of the set lengths: sets two or more classes apart have a length ratio below PRUNE."""
    return F.when(F.size(sigs) > 0, F.floor(F.log(F.size(sigs).cast("double")) / F.log(F.lit(1 / PRUNE)))).otherwise(F.lit(-9))


def likeness(a: Column, b: Column) -> Column:
    """Pruned Jaccard of two signature sets; two empty sets are equal (1)."""
    both = F.size(F.array_intersect(a, b))
    apart = F.abs(length_class(a) - length_class(b)) > 1
    empty = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(empty, F.lit(1.0)).when(apart, F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both)).cast("double")


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds <= key, found in two steps of about sqrt(len(bounds)) comparisons."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    nested = F.array(*[F.array(*[F.lit(x).cast("long") for x in g]) for g in groups])
    which = F.size(F.filter(heads, lambda h: h <= key))
    inside = F.size(F.filter(F.element_at(nested, F.greatest(which, F.lit(1))), lambda x: x <= key))
    return F.when(which == 0, F.lit(0)).otherwise((which - 1) * step + inside)


def fingerprints(docs: DataFrame, anchors=ANCHORS) -> DataFrame:
    """One row per document: doc_id, n_chars, set_length, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text replaces the last floor(n_chars / 4) code points by the
    first as many of the next document in ascending doc_id (ties by text, null
    ids first; after the last document comes the first).  Null text counts as
    empty.  A table of one row is its own next document; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    n = shuffle_partitions(spark) * RANGES_PER_PARTITION
    cuts = rows.select(F.col("at").cast("double").alias("at")).approxQuantile("at", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    bounds = sorted({int(c) for c in cuts if -(2**63) < c < 2**63})
    rows = rows.withColumn("range", _range_of(F.col("at"), bounds)).withColumn("extra", F.lit(0))

    # One row per non-empty range: its least key and the range before it (the last for the first).
    heads = rows.groupBy("range").agg(F.min("at").alias("least"))
    order = Window.orderBy("range")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = fixed(heads.select(F.col("range").alias("own"), "least", F.coalesce(F.lag("range").over(order), F.last("range").over(everything)).alias("before")))
    first = rows.join(F.broadcast(heads), (F.col("range") == F.col("own")) & (F.col("at") == F.col("least")))  # at most n rows
    first = first.groupBy("before").agg(F.min(F.struct("at", "text", "doc_id")).alias("r"))
    copies = first.select("r.doc_id", "r.text", "r.at", F.col("before").alias("range"), F.lit(1).alias("extra"))

    # Texts are shuffled, signatures made where they are compared.
    dealt = rows.unionByName(copies).select("doc_id", "text", "at", "range", "extra").repartition(shuffle_partitions(spark), "range")
    both = with_signatures(dealt, "text", "sigs", anchors)
    inside = Window.partitionBy("range").orderBy("extra", "at", "text")
    both = both.withColumn("next", F.lead(F.struct("text", "sigs")).over(inside)).where(F.col("extra") == 0)
    n_chars = F.length("text")
    cut = F.floor(n_chars / 4).cast("int")
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.substring(F.col("next.text"), F.lit(1), cut)))
    both = with_signatures(both, "edited", "edited_sigs", anchors)
    return both.select(
        "doc_id",
        n_chars.cast("long").alias("n_chars"),
        F.size("sigs").alias("set_length"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        to_text(F.col("sigs")).alias("fingerprint"),
        to_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next.sigs")).alias("near_next"),
    )
