"""The pipeline's stages keep what they should, and the registered queries agree with their SQL."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from linkweave.llm import mixing, packing
from linkweave.llm.queries import ORACLES, QUERIES
from tools.compare import digest, duck

SMOKE = "/root/testdata/sf0.001"


def test_stages_on_awkward_rows(spark):
    rows = [(1, "The cat sat on the mat today", "s", 1), (1, "The cat sat on the mat today", "s", 1), (2, "the CAT sat on the mat today", None, 2), (3, None, "s", 3), (4, "", "s", 4), (5, "42 !!", "s", 5), (None, "nameless text here", "s", 6), (6, "x " * 9000, "t", 7)]
    docs = spark.createDataFrame([(i, t, "en", s, 0, k) for i, t, s, k in rows], "doc_id long, text string, lang string, source string, n_chars long, `count` int")
    stage = dict(P.STAGES)
    kept = stage["language_id"](spark, docs, SMOKE)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, None, 6}
    once = stage["exact_dedup"](spark, kept, SMOKE)
    assert once.columns == docs.columns and sorted(str(r.doc_id) for r in once.collect()) == ["2", "6", "None"]
    near = stage["ngram_jaccard_join"](spark, kept, SMOKE)
    assert near.columns == docs.columns and sorted(str(r.doc_id) for r in near.collect()) == ["1", "6", "None"]
    mixed = stage["mix_sources"](spark, near, SMOKE)
    assert mixed.columns == docs.columns
    assert stage["packing"](spark, mixed, SMOKE).count() > 0
    for name, f in P.STAGES[1:]:
        assert f(spark, docs.limit(0), SMOKE).count() == 0, name


def test_stages_decide_each_text_of_a_doc_id(spark):
    near = "the cat sat on the mat and looked at the dog while rain fell over every roof in town today and all night long"
    rows = [(7, "aaa"), (7, "bbb"), (9, "aaa"), (9, "AAA"), (None, "aaa"), (None, "ccc"), (None, "CCC"), (None, "ccc"), (None, None), (5, "!!"), (5, "??"), (5, "!!")]
    rows += [(None, near), (None, near + " again"), (20, near + " at last"), (20, "other words than those of the cat"), (21, "Other words than those of the cat!")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(P.STAGES)
    once = stage["exact_dedup"](spark, docs, SMOKE)
    got = sorted((str(r.doc_id), (r.text or "").lower()) for r in once.collect())
    alone = [("None", near), ("None", near + " again"), ("20", near + " at last"), ("20", "other words than those of the cat"), ("21", "other words than those of the cat!")]
    assert got == sorted([("7", "bbb"), ("9", "aaa"), ("None", "ccc"), ("None", ""), ("5", "!!"), ("5", "??"), *alone])
    for given in (docs, once):
        left = stage["ngram_jaccard_join"](spark, given, SMOKE)
        assert left.columns == docs.columns
        got = sorted((str(r.doc_id), (r.text or "").lower()) for r in left.collect())
        first = "7" if given is docs else "9"
        assert got == sorted([(first, "aaa"), ("7", "bbb"), ("None", "ccc"), ("None", ""), ("5", "!!"), ("5", "??"), ("20", near + " at last"), ("20", "other words than those of the cat")])


def test_run_agrees_with_its_stages(spark):
    out = P.run(spark, SMOKE).toPandas()
    whole = out.groupby(["doc_id", "sequence_id", "start"])["length"].sum()
    assert (whole > 0).all() and out.groupby("sequence_id")["length"].sum().max() <= 1024
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").toPandas()
    # Of equal texts (up to A-Z case) at most the largest doc_id is left.
    best = docs.assign(t=docs.text.str.lower()).groupby("t").doc_id.transform("max")
    assert set(out.doc_id) <= set(best)


def test_run_matches_brute_force(spark):
    from test_operators import brute_join, lower

    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text", "source").collect()
    rows = [(r.doc_id, r.text) for r in docs if re.search(r"[^\W\d_]", r.text or "")]
    best = {}
    for i, t in rows:
        best[lower(t)] = max(i, best.get(lower(t), i))
    rows = [(i, t) for i, t in rows if best[lower(t)] == i]
    kept = {i for i, c, _ in brute_join(rows) if i == c}
    left = spark.read.parquet(f"{SMOKE}/documents.parquet").where(F.col("doc_id").isin(sorted(kept)))
    copies = {r.doc_id: r.copies for r in mixing.mix(left).collect() if r.copies}
    bpe = packing.CachedBpe(packing.tokenizer_path())
    want = {i: copies[i] * (len(bpe.encode(t)) // 4 + 1) for i, t in rows if i in copies}
    out = P.run(spark, SMOKE).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in out} == want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, SMOKE)
    res = duck(SMOKE).execute(ORACLES[name])
    assert digest(df.columns, [tuple(r) for r in df.collect()]) == digest([d[0] for d in res.description], res.fetchall())
