"""The dealt methods carry the results: tries, signatures, networks, draws; and stages on odd corpora."""

import math
import re
import unicodedata

import numpy as np
import pytest
import xxhash

import corpus_pipeline as P
from linkweave.llm import langid, mixing, spotsigs, toxicity, trie_dedup

SMOKE = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_owner_tries_share_edges_and_settle_by_subtree(monkeypatch):
    rng = np.random.default_rng(2)
    keys = sorted(b"prefix-" + bytes(rng.choice(list(b"ab"), 12)) for _ in range(400))
    monkeypatch.setattr(trie_dedup, "_bucket_of", lambda sha: 0)
    monkeypatch.setattr(trie_dedup, "_rows", lambda rows: iter(rows))
    rows = [(k, k.hex(), len(k), i, 1) for i, k in enumerate(keys)]
    trie = trie_dedup.PatriciaTrie(max)
    for k, sha, _, i, n in rows:
        trie.insert(k, (sha,), i, n)
    labels = sum(len(x.label) for x in trie_dedup._nodes(trie.root))
    assert labels < 0.6 * sum(map(len, set(keys)))  # one trie holds them all and shares their edges
    want = {k.hex(): (max(i for i, x in enumerate(keys) if x == k), keys.count(k)) for k in keys}
    for limit in (1, 3000, 1 << 30):  # 1: after every key all but its path leaves memory
        out = [r for b in trie_dedup._owner_side(max, limit)([rows]) for r in b.to_pylist()]
        assert len(out) == len(want) and {r["text_sha256"]: (r["ident"], r["copies"]) for r in out} == want


def brute_signatures(text):
    anchors, words = set(spotsigs.ANCHORS), [w for w in re.split(r"[^\w]|_", text.lower()) if w]
    out = set()
    content = [i for i, w in enumerate(words) if w not in anchors]
    for n, i in enumerate(content):
        if i and words[i - 1] in anchors:
            after = words[content[n + 1]] if n + 1 < len(content) else ""
            h = 42
            for w in (words[i - 1], words[i], after):
                h = xxhash.xxh64_intdigest(w.encode(), h)
            out.add(h & 0xFFFFFFFF)
    if not out and text:
        out = {xxhash.xxh64_intdigest(text.encode(), 42) & 0xFFFFFFFF}
    return out


def test_fingerprints_match_independent_sets(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sets = {i: brute_signatures(t) for i, t in rows}
    near = 0
    for r in spotsigs.fingerprints(docs).collect():
        k = [i for i, _ in rows].index(r.doc_id)
        own, nxt = sets[r.doc_id], sets[rows[(k + 1) % len(rows)][0]]
        text = rows[k][1]
        edited = text[: len(text) - len(text) // 4] + rows[(k + 1) % len(rows)][1][: len(text) // 4]
        assert r.fingerprint == "".join(f"{x:08x}" for x in sorted(own))
        assert r.edited_fingerprint == "".join(f"{x:08x}" for x in sorted(brute_signatures(edited)))
        for got, other in ((r.near_next, nxt), (r.near_edited, brute_signatures(edited))):
            exact = len(own & other) / len(own | other) if own | other else 1.0
            part = [math.floor(math.log(len(s)) / math.log(1 / spotsigs.PRUNE)) if s else -9 for s in (own, other)]
            apart = abs(part[0] - part[1]) > 1
            assert got == pytest.approx(0.0 if apart else exact)
            assert not apart or exact <= spotsigs.PRUNE  # what a partition parts is not alike
            near += got > 0
    assert near > 100


def test_prediction_is_the_training_forward_pass():
    net = langid.ByteGRU(["a", "b", "c"], hidden=5)
    rng = np.random.default_rng(4)
    for v in net.p.values():
        v += rng.normal(0, 0.3, v.shape).astype(np.float32)
    x = rng.integers(1, 256, (17, 6)).astype(np.uint8)
    x[11:, 2] = 0
    states = {d: {t: new for t, *_, new in net._run(d, x, order)} for d, order in (("f", range(17)), ("b", range(16, -1, -1)))}
    total = np.zeros((3, 6))
    for t in range(17):
        logits = net.p["Wf"] @ states["f"][t] + net.p["Wb"] @ states["b"][t] + net.p["o"]
        q = np.exp(logits - logits.max(0))
        total += q / q.sum(0) * (x[t] != 0)
    assert net.position_sums(x) == pytest.approx(total, abs=1e-4)


def test_letters_are_unicode_letters(spark):
    texts = ["² ½", "Ⅳ", "①", "x", "é", "漢", "ª", "ʰ", "42 !!", "", None, "٣", "_"]
    want = [any(unicodedata.category(c).startswith("L") for c in t or "") for t in texts]
    model = langid.ByteGRU(["en", "fr"])
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.lang_pred != "und" for r in langid.identify(docs, model).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = {r[0] for r in docs.where(langid.has_letter(langid.text_of())).select("doc_id").collect()}
    assert [i in kept for i in range(len(texts))] == want


def test_rare_texts_of_a_copied_language_are_sampled(spark):
    rows = [(i, "le même texte partout", "fr", "s", 0) for i in range(1, 3000)] + [(10_000 + i, f"un autre texte numéro {i}", "fr", "s", 0) for i in range(40)]
    rows += [(20_000 + i, f"an english text number {i}", "en", "s", 0) for i in range(40)]
    model = langid.train(spark.createDataFrame(rows, SCHEMA), max_docs=100, steps=1)
    assert model.labels == ["en", "fr"]


def test_mix_without_ids_is_drawn_by_text(spark):
    rows = [(None, f"some text of words number {i} " * 5, "en", "a", 0) for i in range(400)] + [(i, "w " * 40, "en", "b", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    per = {}
    for r in mixing.mix(docs).collect():
        taken, target = per.get(r.source, (0, 0))
        per[r.source] = (taken + r.taken, r.target)
    assert all(abs(taken - target) <= 0.02 * target for taken, target in per.values())
    plan = {r.asDict()["doc_id"]: r.copies for r in mixing.mix(docs).collect() if r.doc_id is not None}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.where("doc_id IS NOT NULL").count() == sum(plan.values())
    clash = docs.withColumn("key", langid.F.lit(1)).withColumn("s", langid.F.lit(2)).withColumn("seed", langid.F.lit(3))
    assert mixing.mixed_documents(clash).columns == clash.columns and mixing.mixed_documents(clash).count() == out.count()


def test_every_stage_takes_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in P.STAGES:
        assert stage(spark, empty, SMOKE).count() == 0, name


def test_a_corpus_without_languages_keeps_its_documents(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").withColumn("lang", langid.F.lit(None).cast("string"))
    kept = dict(P.STAGES)["language_id"](spark, docs, SMOKE)
    lettered = {r.doc_id for r in docs.collect() if any(unicodedata.category(c).startswith("L") for c in r.text or "")}
    assert {r.doc_id for r in kept.collect()} == lettered and len(lettered) > 150


def test_toxicity_scores_are_recomputed_from_the_model(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    labels = spark.read.parquet(f"{SMOKE}/labels.parquet")
    model = toxicity.train(docs, labels)
    one_by_one = toxicity.toxicity(docs.repartition(5), labels, model).select("doc_id", "score", "predicted").collect()
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels, model).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score) and r.predicted == int(r.score >= 0.5) for r in one_by_one)
