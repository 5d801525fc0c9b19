"""N-gram Jaccard self-join by MinHash banding (operator 2).

Steps: (1) one pass over the texts gives every document the 128-bit key of its
word sequence and one hash per MinHash band; (2) documents with equal keys are
one class (copies are not expanded); (3) classes meet on band hashes, as a star
around the least class of each bucket; the stars' connected components hold
every candidate pair; (4) candidates are verified in blocks on the full n-gram
sets, with counts and a spanning forest as output, never all pairs;
(5) components of the verified links are the result classes.

A component of up to ``BLOCK`` classes is verified as one block.  A larger one,
which may hang together by chance collisions only, is verified as a whole or
bucket by bucket, whichever sends fewer texts; in the latter case a pair counts
in the first band that it shares, and a bucket with the members of an earlier
band's bucket is left out, so that every pair is still verified exactly once.

Band and row counts follow from the threshold and the target recall
(:func:`plan_bands`).  The shuffle is on band hashes, sixteen bytes a band; texts travel
only for documents that share a band with another text.

Skew: a bucket or component of any size is split into blocks of ``BLOCK``
classes, and each pair of blocks is a group of its own.  Bucket minima are
combined before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.common import blocks, bounded_batches, components, fixed, one_row_per_text, shuffle_partitions, small, text_hash, text_of
from linkweave.operators.ranking import dense_rank_table

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.99999
BLOCK = 256
BROADCAST_IDS = 1_000_000  # 8-byte ids plus overhead: some tens of MB at most

_P = np.uint64(0x100000001B3 | 1)  # odd multiplier of the rolling hash
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def plan_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = 160) -> tuple[int, int]:
    """(bands, rows): the most selective rows per band whose bands reach the recall at the threshold.

    A pair of similarity s shares a band with probability 1 - (1 - s^rows)^bands.
    """
    best = None
    for rows in range(1, 17):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no band count within max_hashes reaches the recall")
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least n of each (grown in place)."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 1 << 16)
        _POWERS = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _P)], dtype=np.uint64)
        _INVERSES = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _P_INV)], dtype=np.uint64)
    return _POWERS, _INVERSES


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets per text); words are runs of lower-case letters, digits and non-ASCII bytes."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    inside = _WORD_BYTE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.r_[0, edges]
    starts, ends = edges[0::2], edges[1::2]
    power, inverse = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=prefix[1:])
    words = _mix((prefix[ends] - prefix[starts]) * inverse[starts])
    begin = np.r_[0, np.cumsum([len(r) + 1 for r in raw])]
    return words, np.searchsorted(starts, begin)


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Hashes of all word n-grams of one text; a shorter text is one n-gram, an empty one none."""
    if len(words) == 0:
        return words
    width = min(n, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(out)]
    return _mix(out + np.uint64(width))


def _constants(bands: int, rows: int) -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 63, (bands * rows, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_hashes(grams: np.ndarray, bands: int, rows: int, mult: np.ndarray) -> np.ndarray:
    """One signed 64-bit hash per band; minima over multiplicative permutations of the n-gram hashes."""
    low = np.full(bands * rows, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(grams), 2048):  # bounded working set for long texts
        low = np.minimum(low, (grams[None, at : at + 2048] * mult).min(1))
    low = low.reshape(bands, rows)
    out = np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(rows):
        out = _mix(out + low[:, k] * np.uint64(2 * k + 3))
    return out.view(np.int64)


def sequence_key(words: np.ndarray) -> bytes:
    """128-bit key of the whole word sequence."""
    at = np.arange(len(words), dtype=np.uint64)
    a = np.bitwise_xor.reduce(_mix(words + at * np.uint64(0x9E3779B97F4A7C15))) if len(words) else np.uint64(0)
    b = np.add.reduce(_mix((words ^ np.uint64(0x5851F42D4C957F2D)) * (np.uint64(2) * at + np.uint64(1)))) if len(words) else np.uint64(0)
    return int(a).to_bytes(8, "little") + int(b).to_bytes(8, "little")


def _signatures(bands: int, rows: int, n: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        mult = _constants(bands, rows)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            for block in blocks(texts, map(len, texts), 1 << 20):
                words, offs = word_hashes(block)
                keys, sigs = [], []
                for i in range(len(block)):
                    w = words[offs[i] : offs[i + 1]]
                    keys.append(sequence_key(w))
                    sigs.append(band_hashes(shingles(w, n), bands, rows, mult) if len(w) else None)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(block)), pa.array(keys, pa.binary()), pa.array([int.from_bytes(k[:8], "little", signed=True) for k in keys], pa.int64()), pa.array(sigs, pa.list_(pa.int64()))],
                    names=["doc_id", "key", "k1", "sig"],
                )
                at += len(block)

    return run


def signatures(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = WORDS) -> DataFrame:
    """(doc_id, key, k1, sig) per row of ``docs``; sig is null for a text without words."""
    bands, rows = plan_bands(threshold, recall)
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        _signatures(bands, rows, n), "doc_id long, key binary, k1 long, sig array<long>"
    )


def _grams_of(texts: list[str], n: int) -> list[np.ndarray]:
    out = []
    for block in blocks(texts, map(len, texts), 1 << 20):
        words, offs = word_hashes(block)
        out += [np.unique(shingles(words[offs[i] : offs[i + 1]], n)) for i in range(len(block))]
    return out


def _links(sets_a, sets_b, same: bool, threshold: float, earlier=None):
    """Yield (i, positions of b linked with a[i]); exact Jaccard on full sets, sizes checked first.

    ``earlier`` holds both sides' hashes of the bands before the bucket's own;
    a pair that shares one of them is verified there.
    """
    size_b = np.array([len(s) for s in sets_b])
    names, flat = np.unique(np.concatenate([*sets_a, *sets_b]), return_inverse=True)
    cut = np.cumsum([0, *map(len, sets_a), *map(len, sets_b)])
    idx = [flat[cut[k] : cut[k + 1]] for k in range(len(sets_a) + len(sets_b))]
    flat_b, offs_b = flat[cut[len(sets_a)] :], cut[len(sets_a) : -1] - cut[len(sets_a)]
    mark = np.zeros(len(names), np.int32)
    for i, a in enumerate(sets_a):
        n = len(a)
        fits = (size_b >= threshold * n - 1e-9) & (n >= threshold * size_b - 1e-9)
        if same:
            fits[: i + 1] = False
        near = np.flatnonzero(fits)
        if earlier is not None and len(near):
            near = near[~(earlier[1][near] == earlier[0][i]).any(1)]
        if not len(near):
            continue
        mark[idx[i]] = 1
        if len(near) * 4 < len(sets_b):
            both = np.array([mark[idx[len(sets_a) + j]].sum() for j in near])
        else:
            both = np.add.reduceat(mark[flat_b], offs_b)[near]
        mark[idx[i]] = 0
        hit = near[both >= threshold * (n + size_b[near] - both) - 1e-9]
        if len(hit):
            yield i, hit


def _verify(threshold: float, n: int):
    """Rows sorted by (band, grp, i, j): count links and keep a spanning forest of each block pair."""

    def check(band, rows):
        by_key = {}
        for key, copies, text, side, sig in rows:
            before = by_key.setdefault((side, key), (copies, text, sig))
            if before[1] != text and sequence_key(word_hashes([text])[0]) == key:
                # A doc_id that repeats with several texts brings them all; the class is the one with this key.
                by_key[side, key] = (copies, text, sig)
        sides = {s: [(k[1], *v) for k, v in sorted(by_key.items()) if k[0] == s] for s in (0, 1)}
        same = not sides[1]
        left, right = sides[0], sides[0] if same else sides[1]
        if not left or not right or (same and len(left) < 2):
            return
        sets = _grams_of([t for _, _, t, _ in left], n)
        others = sets if same else _grams_of([t for _, _, t, _ in right], n)
        earlier = [np.array([sig[:band] for *_, sig in side]) for side in (left, right)] if band > 0 else None
        docs_l, docs_r = np.array([c for _, c, *_ in left]), np.array([c for _, c, *_ in right])
        n_docs, n_texts = np.zeros(len(left), int), np.zeros(len(left), int)
        m_docs, m_texts = (n_docs, n_texts) if same else (np.zeros(len(right), int), np.zeros(len(right), int))
        parent = list(range(len(left) + (0 if same else len(right))))

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, hit in _links(sets, others, same, threshold, earlier):
            n_docs[i] += docs_r[hit].sum()
            n_texts[i] += len(hit)
            m_docs[hit] += docs_l[i]
            m_texts[hit] += 1
            for j in hit:
                x, y = find(i), find(int(j) if same else len(left) + int(j))
                if x != y:
                    parent[x] = y
                    yield left[i][0], right[j][0], 0, 0
        for side, a, b in ((left, n_docs, n_texts), *(() if same else ((right, m_docs, m_texts),))):
            for (key, *_), x, y in zip(side, a, b, strict=True):
                if y:
                    yield key, None, int(x), int(y)

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def batch_of(found):
            a, b, x, y = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["key", "other", "docs", "texts"])

        for batch in batches:
            for band, grp, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (band, grp, i, j) != now:
                    out.extend(check(now[0], held) if now else ())
                    now, held = (band, grp, i, j), []
                    if len(out) > 20_000:
                        yield batch_of(out)
                        out = []
                held.append(row)
        out.extend(check(now[0], held) if now else ())
        if out:
            yield batch_of(out)

    return run


def _places(cand: DataFrame, named: DataFrame, block: int) -> DataFrame:
    """(key, rep, copies, sig, place array<struct<band, grp, n_blocks>>): where each candidate class is verified.

    A component as a whole has band -1 and its own name as ``grp``; a class of a
    component that is verified by buckets has one place per bucket it shares
    (at most the number of bands) and brings its signature.
    """
    sizes = fixed(cand.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).withColumn("n_blocks", F.ceil(F.col("n") / block).cast("int")))
    whole = cand.join(sizes, "comp").select(
        "key", "rep", "copies", F.lit(None).cast("array<long>").alias("sig"),
        F.array(F.struct(F.lit(-1).alias("band"), F.col("comp").alias("grp"), "n_blocks")).alias("place"), "comp",
    )
    large = sizes.where("n_blocks > 1")
    if large.isEmpty():
        return whole.drop("comp")
    # Signatures come from the rep's row alone, so that a class of many copies sends one.
    member = cand.join(large.select("comp"), "comp").join(named.select(F.col("doc_id").alias("rep"), "key", "sig"), ["rep", "key"]).dropDuplicates(["key"])
    member = fixed(member.select("key", "rep", "copies", "comp", "sig"))
    shared = member.select("comp", "key", F.posexplode("sig").alias("band", "grp"))
    buckets = shared.groupBy("comp", "band", "grp").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("key")).alias("members")).where("n > 1")
    buckets = buckets.groupBy("comp", "n", "members").agg(F.min(F.struct("band", "grp")).alias("b"))
    buckets = fixed(buckets.select("comp", "b.*", "n", F.ceil(F.col("n") / block).cast("int").alias("n_blocks")))
    cost = buckets.groupBy(F.col("comp").alias("c")).agg(F.sum(F.col("n") * F.col("n_blocks")).alias("rows"))
    split = fixed(large.join(cost, F.col("comp") == F.col("c")).where(F.col("rows") < F.col("n") * F.col("n_blocks")).select("comp"))
    where = shared.join(split, "comp", "left_semi").join(buckets.drop("n", "comp"), ["band", "grp"])
    where = where.groupBy("key").agg(F.collect_list(F.struct("band", "grp", "n_blocks")).alias("place"))  # at most one per band
    by_bucket = member.join(where, "key").select("key", "rep", "copies", "sig", "place")
    return whole.join(split, "comp", "left_anti").select(*by_bucket.columns).unionByName(by_bucket)


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = WORDS, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_text_links.

    Two documents are linked when the Jaccard similarity of their word n-gram
    sets is at least ``threshold``; ``class_id`` is the least doc_id of the
    connected class, ``n_links`` the number of other documents linked to the
    document (copies included), ``n_text_links`` the number of different word
    sequences linked to its own.

    Words ignore case and punctuation.  A text of fewer than ``n`` words is one
    n-gram; a text without words is linked to nothing.  Rows with a null doc_id
    get a null class and no links and link nothing.  A repeated doc_id with one
    text is one document more in ``n_links``.  An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    sigs = fixed(signatures(docs, threshold, recall, n))
    named = sigs.where(F.col("doc_id").isNotNull() & F.col("sig").isNotNull())
    classes = fixed(named.groupBy("key", "k1").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))

    # Candidate graph on 64-bit class hashes; a collision only adds work, verification tells texts apart.
    bands = named.dropDuplicates(["key"]).select("k1", F.explode("sig").alias("h"))
    buckets = bands.groupBy("h").agg(F.min("k1").alias("least"), F.max("k1").alias("most")).where(F.col("least") != F.col("most"))
    star = bands.join(buckets.select("h", "least"), "h").select(F.col("k1").alias("u"), F.col("least").alias("v"))
    comps = components(star)
    cand = fixed(classes.join(comps, F.col("k1") == F.col("node")).select("key", "rep", "copies", F.col("component").alias("comp")))

    # Texts of the candidates: one row per class, by its least doc_id.
    placed = fixed(_places(cand, named, block)).withColumnRenamed("rep", "rid")
    n_ids = placed.count()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    bounded = small(placed.drop("sig", "place"), n_ids, BROADCAST_IDS)
    texts = texts.join(bounded, F.col("doc_id") == F.col("rid")).select("key", "copies", "text")
    texts = texts.join(placed.select("key", "sig", "place"), "key")
    spread = texts.select("key", "copies", "text", "sig", F.explode("place").alias("at")).select("key", "copies", "text", "sig", "at.*")
    spread = spread.withColumn("mine", F.pmod(F.xxhash64("key"), F.col("n_blocks")).cast("int"))
    spread = spread.withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    dealt = (
        spread.select(
            "band", "grp", F.least("mine", "peer").alias("i"), F.greatest("mine", "peer").alias("j"), "key", "copies", "text",
            (F.col("mine") > F.col("peer")).cast("int").alias("side"), "sig",
        )
        .repartition(shuffle_partitions(spark), "band", "grp", "i", "j")
        .sortWithinPartitions("band", "grp", "i", "j")
    )
    found = fixed(dealt.mapInArrow(_verify(threshold, n), "key binary, other binary, docs long, texts long"))

    links = found.where(F.col("other").isNull()).groupBy("key").agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))
    linked = components(found.where(F.col("other").isNotNull()).select(F.col("key").alias("u"), F.col("other").alias("v")))
    least = linked.join(cand.select("key", "rep"), F.col("node") == F.col("key")).groupBy("component").agg(F.min("rep").alias("class_id"))
    member = linked.join(least, "component").select(F.col("node").alias("key"), "class_id")
    known = classes.join(member, "key", "left").join(links, "key", "left").select(
        "key", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links")
    )
    # Fixed, so that the last join has a plain shuffle on either side and a hot class can be split.
    result = named.select("doc_id", "key").join(fixed(known), "key").select("doc_id", "class_id", "n_links", "n_text_links")
    alone = sigs.where(F.col("doc_id").isNull() | F.col("sig").isNull())
    return result.unionByName(alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_text_links")))


def one_per_class(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` per class, that of the least doc_id (null last), then text hash; all columns kept.

    Texts are decided one by one: a doc_id with several texts, or a null one,
    is joined under a number per (doc_id, text hash).
    """
    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_sha256"))
    pairs = fixed(pairs.distinct().withColumn("nameless", F.col("doc_id").isNull()))
    if pairs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        pairs, numbered = pairs.withColumn("number", F.col("doc_id")), docs
    else:
        pairs = fixed(dense_rank_table(pairs, ["nameless", "doc_id", "text_sha256"], name="number"))
        rows = docs.select(F.col("doc_id").cast("long").alias("_id"), text_hash().alias("_sha"), text_of().alias("text"))
        numbered = rows.join(pairs, rows["_id"].eqNullSafe(pairs["doc_id"]) & (rows["_sha"] == pairs["text_sha256"])).select(F.col("number").alias("doc_id"), "text")
    found = ngram_join(numbered, **options)
    least = found.where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("number"))
    return one_row_per_text(docs, pairs.join(least, "number", "left_semi"))
