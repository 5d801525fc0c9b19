"""Training-data operators against brute force on a small table with awkward rows."""

import hashlib
import itertools
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from linkweave.llm import langid, licenses, mixing, ngram_join, packing, queries, sharding, spotsigs, toxicity, trie_dedup, url_filter
from linkweave.llm.common import components

SMOKE = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, `rank` string"
_A = "the cat sat on the mat and looked at the dog while rain fell over every roof in town today"


def _rows():
    base = [
        (1, _A), (2, _A.upper()), (3, _A + " again"), (4, None), (5, ""), (6, None), (7, "one two"), (8, "one two"), (9, "!!! 123 ..."),
        (10, "Ünïcode ß text"), (10, "Ünïcode ß text"), (11, "word " * 6000), (None, _A), (None, "only me"), (12, "of the of the"), (13, "Licensed under the Apache License, Version 2.0."),
    ]
    return [(i, t, "en" if i and i % 2 else None, f"s{(i or 0) % 3}" if i != 9 else None, None, 1, "k", "r") for i, t in base]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_exact_dedup_matches_brute_force(docs, empty):
    groups = defaultdict(list)
    for i, t, *_ in _rows():
        groups[lower(t)].append(i)
    for keep, best in (("max", max), ("min", min)):
        want = Counter()
        for t, ids in groups.items():
            own = [i for i in ids if i is not None]
            k = best(own) if own else None
            done = False
            for i in ids:
                mine = i == k and not done
                done |= mine
                want[(i, k, len(ids), mine, hashlib.sha256(t.encode()).hexdigest())] += 1
        for limit in (1, 1 << 20):  # 1 byte: every insertion spills
            got = trie_dedup.exact_dedup(docs, keep, limit)
            assert Counter(tuple(r) for r in got.collect()) == want
    assert trie_dedup.exact_dedup(empty).count() == 0


def test_trie_splits_edges_and_counts():
    trie = trie_dedup.PatriciaTrie(max)
    keys = [b"", b"a", b"ab", b"abc", b"abd", b"b", b"ab"]
    for i, k in enumerate(keys):
        trie.insert(k, ("s",), i, 1)
    got = {k: (i, n) for k, _, i, n in trie.drain()}
    assert got == {b"": (0, 1), b"a": (1, 1), b"ab": (6, 2), b"abc": (3, 1), b"abd": (4, 1), b"b": (5, 1)}


def brute_join(rows, n=5, threshold=0.8):
    sets = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w and i is not None else frozenset())
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and both >= threshold * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        r = find(k)
        least[r] = i if least.get(r) is None else min(least[r], i) if i is not None else least[r]
    return Counter((rows[k][0], least[find(k)], links[k]) for k in range(len(rows)))


def test_ngram_join_matches_brute_force(spark, docs, empty):
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(docs).collect())
    assert got == brute_join(_rows())
    assert ngram_join.ngram_join(empty).count() == 0
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = list(rng.choice(words, 60))
        for _ in range(20):
            t = list(base)
            for k in rng.integers(0, 60, rng.integers(0, 5)):
                t[k] = f"x{rng.integers(50)}"
            rows.append((len(rows), " ".join(t)))
    many = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_join(rows)
    for block in (7, 256):  # 7: components are verified in many block pairs
        got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(many, block=block).collect())
        assert got == want
    kept = ngram_join.one_per_class(many).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c, _ in want})


def test_long_chains_are_verified_by_bucket(spark, monkeypatch):
    """One component of 600 overlapping texts: few pairs share a bucket, so no block pairs of the whole."""
    words = [f"w{i}" for i in range(1900)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 60])) for k in range(600)] + [(1000 + k, " ".join(words[3 * k : 3 * k + 60]).upper()) for k in range(0, 600, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    places = ngram_join._places

    def spy(*args):
        seen.append(places(*args))
        return seen[-1]

    monkeypatch.setattr(ngram_join, "_places", spy)
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(docs, block=7).collect())
    assert seen[0].where("place[0].band >= 0").count() > 500
    assert got == brute_join(rows)


def test_band_plan_reaches_the_recall():
    bands, rows = ngram_join.plan_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 160


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 130))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_gradients_match_finite_differences():
    net = langid.ByteGRU(["a", "b", "c"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (6, 4)).astype(np.uint8)
    y = np.broadcast_to(rng.integers(0, 3, 4), x.shape)[:, None, :]
    mask = (rng.random(x.shape) < 0.8).astype(float)
    _, grad = net.loss_and_gradients(x, y, mask)
    for name in net.p:
        at = (int(x[2, 1]), 1) if name.startswith("E") else (0, 0)
        keep, eps = net.p[name][at], 1e-3
        net.p[name][at] = keep + eps
        up, _ = net.loss_and_gradients(x, y, mask)
        net.p[name][at] = keep - eps
        down, _ = net.loss_and_gradients(x, y, mask)
        net.p[name][at] = keep
        assert grad[name][at] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=1e-4)


def test_language_id_on_held_out_rows_and_edges(spark, docs, empty):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(real)
    out = langid.identify(real, model).join(real.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)
    edge = {(r.doc_id, r.lang_pred == "und") for r in langid.identify(docs, model).collect()}
    assert {(4, True), (5, True), (9, True), (1, False), (11, False)} <= edge
    assert all(r.lang_pred == "und" for r in langid.identify(empty).collect())
    # Every byte counts: the windows of a text give the same sums as the text stepped in one go.
    text = "the cat sat " * 40
    names, scores = model.predict([text, "", text])
    assert names[0] == names[2] and scores[0] == pytest.approx(scores[2]) and names[1] == "und"


def test_mix_targets_and_draws(spark, docs, empty):
    rows = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert all((r["size"], r.taken) == (0, 0) for i, r in rows.items() if i in (4, 5, 6))
    assert rows[11]["size"] == 6000 and all(r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in rows.values())
    assert mixing.mix(empty).count() == 0
    real = spark.read.parquet(f"{SMOKE}/documents.parquet")
    out = mixing.mix(real).collect()
    per = defaultdict(lambda: [0, 0, 0.0, 0])
    for r in out:
        per[r.source][0] += r["size"]
        per[r.source][1] += r.taken
        per[r.source][2], per[r.source][3] = r.target, r.source_size
    assert sum(v[2] for v in per.values()) == pytest.approx(sum(v[0] for v in per.values()))
    for size, taken, target, source_size in per.values():
        assert size == source_size and target <= 3 * size + 1e-6 and abs(taken - target) <= 0.1 * target
    again = sorted((r.doc_id, r.taken) for r in mixing.mix(real.repartition(3)).collect())
    assert again == sorted((r.doc_id, r.taken) for r in out)
    assert mixing.mixed_documents(real).count() == sum(r.copies for r in out)


def test_packing_round_trip(docs, empty, tmp_path):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    bpe = packing.CachedBpe(packing.tokenizer_path())
    odd = ["", " ", "a  b", " a ", "x \n y\t", "don't <|endoftext|> ", "é\u00a0 ñ", "a\u2003 b", "word\n\nword"]
    for x in odd + [r[1] or "" for r in _rows()]:
        assert np.frombuffer(bpe.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    out = packing.pack(docs).toPandas()
    want = Counter()
    for i, x, *_ in _rows():
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        at = 0
        for n in packing.cut_lengths(len(ids)):
            want[(i, at, n, zlib.crc32(struct.pack(f"<{n}I", *ids[at : at + n])), len(ids))] += 1
            at += n
        assert at == len(ids)
    got = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out.itertuples())
    assert got == want
    for _, seq in out.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (seq["offset"] == seq["length"].cumsum() - seq["length"]).all() and seq["length"].sum() <= 1024
    assert packing.pack(empty).count() == 0


def test_licenses_match_brute_force(spark, docs, empty):
    rows = {r.doc_id: r for r in licenses.scan(docs).collect()}
    r = rows[13]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == (8, 1, 3, 3, "apache", "apache,apache-2.0")
    assert (rows[4].n_words, rows[4].n_base, rows[4].first_word, rows[4].labels, rows[4].score) == (0, 0, None, "", 0.0)
    assert licenses.scan(empty).count() == 0
    # Base counts on real rows, phrase by phrase over the word list.
    real = spark.read.parquet(f"{SMOKE}/documents.parquet")
    texts = {r.doc_id: r.text for r in real.collect()}
    got = licenses.scan(real).collect()
    assert len(got) == len(texts) and sum(r.n_base for r in got) > 0
    for r in got:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(texts[r.doc_id]))
        at = {label: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p, label in licenses.PHRASES.items()}
        spots = sorted(i for x in at.values() for i in x)
        base = sorted(label for label, x in at.items() if x)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(spots), min(spots, default=None), max(spots, default=None), ",".join(base))
        best = brute_passages(words)
        assert set(r.labels.split(",")) - {""} == {*base, *best}
        assert r.score == pytest.approx(1.0 if base else max(best.values(), default=0.0))


def brute_passages(words):
    """Label -> best containment over every run of words that a template allows."""
    best = {}
    for label, text, marks, siblings in licenses.TEMPLATES:
        tokens = set(text.split())
        slack = len(text.split()) - max(1, int(np.ceil(licenses.THRESHOLD * len(tokens) - 1e-9)))
        width = len(text.split()) + slack
        named = {p for i, w in enumerate(words) if w in siblings.split() for p in range(i - slack, i + slack + 1)}
        for i in (i for i, w in enumerate(words) if w in tokens):
            for j in range(i + 1, min(len(words), i + width) + 1):
                run = set(words[i:j])
                if j - 1 in named or i in named:
                    break
                both = len(run & tokens) / len(tokens)
                if both >= licenses.THRESHOLD - 1e-9 and set(marks.split()) <= run:
                    best[label] = max(both, best.get(label, 0))
    return best


def test_license_filters_lose_nothing():
    freq = {w: k * 5 % 11 for k, w in enumerate(sorted({w for _, t, *_ in licenses.TEMPLATES for w in t.split()}))}
    index, rng, skipped = licenses.TemplateIndex(licenses.TEMPLATES, freq), np.random.default_rng(6), 0
    extra = [*["other"] * 40, "nc", "lesser", "noncommercial"]
    for _ in range(150):
        words = []
        for _ in range(rng.integers(1, 6)):
            words += rng.choice([*sorted(freq), *extra], rng.integers(0, 50)).tolist()
            words += [w for w in licenses.TEMPLATES[rng.integers(len(licenses.TEMPLATES))][1].split() if rng.random() < 0.85]
        assert index.search(words)[0] == pytest.approx(brute_passages(words))
        # The positional filter alone turns blocks away: enough tokens, a shared prefix token, too few after it.
        block = sorted(set(words) & index.vocab, key=lambda w: (freq[w], w))[: rng.integers(1, 30)]
        for k, t in enumerate(index.templates):
            if len(block) >= t.need and set(t.prefix) & set(block) and k not in index.candidates(set(block)):
                skipped += 1
                assert len(set(block) & t.whole) < t.need
    assert skipped > 50


def test_license_blocks_do_not_follow_line_breaks(spark):
    gpl = "# This program is free software; you can redistribute it\n# and/or modify it under the terms of the\n# GNU General Public License"
    parts = ["released", "under", "the", "mit", "license"]
    long = " ".join(x for w in parts for x in ["word"] * 200 + [w])  # one line; the words of a notice, far apart
    wrapped = "Permission is hereby granted,\nfree of charge, to any person obtaining\na copy of this software"
    texts = [gpl, wrapped, long, long + " released under the MIT license " + long, "all rights reserved\n" * 2]
    rows = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (rows[0].base_labels, rows[0].labels, rows[0].n_blocks) == ("gpl", "gpl,gpl-redistribute", 1)
    assert (rows[1].labels, rows[1].score, rows[1].n_blocks) == ("mit-text", 1.0, 1)
    assert (rows[2].labels, rows[2].score, rows[2].n_blocks) == ("", 0.0, 0)
    assert (rows[3].base_labels, rows[3].labels, rows[3].n_blocks) == ("mit", "mit,mit-notice", 1)
    assert (rows[4].labels, rows[4].n_blocks) == ("all-rights-reserved", 2)


def test_license_siblings_and_scattered_words(spark):
    cases = {
        "Released under the Apache License, Version 2.0.": "apache,apache-2.0",
        "Licensed under CC BY 4.0": "cc-by",
        "Licensed under CC BY-NC 4.0": "cc-by-nc",
        "This work is licensed under a Creative Commons Attribution NonCommercial license": "",
        "This work is licensed under a Creative Commons Attribution license": "cc-by",
        "All users have equal rights in the park and some tables are reserved for groups": "",
        "All rights reserved.": "all-rights-reserved",
        "This work is licensed under the GNU Lesser General Public License version 3": "gpl",
        "This work is licensed under the GNU General Public License version 3": "gpl,gpl-notice",
        "It was released under the new license of the city": "",
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(docs).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())
    base = set(licenses.PHRASES.values())
    assert not base & {label for label, *_ in licenses.TEMPLATES}


def _draw(i, label):
    h = xxhash.xxh64_intdigest(struct.pack("<q", i), 42)
    return ((xxhash.xxh64_intdigest(label.encode(), h) >> 12) + 0.5) / (1 << 52)


def test_shards_match_brute_force_and_growth_is_confined(docs, empty):
    def walk(node, i):
        while node.kids:
            node = node.kids[0] if len(node.kids) == 1 else min(node.kids, key=lambda k: -np.log(_draw(i, k.label)) / k.weight)
        return node.shard

    rows = sharding.assign(docs).collect()
    for r in rows:
        if r.doc_id is not None:
            assert (r.shard, r.grown_shard) == (walk(sharding.tree(24), r.doc_id), walk(sharding.tree(25), r.doc_id))
        assert r.grown_shard in (r.shard, 24)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    crc = {i: zlib.crc32((t or "").encode()) for i, t, *_ in _rows() if i}
    assert all(r.text_crc32 == crc[r.doc_id] for r in rows if r.doc_id)
    assert sharding.assign(empty).count() == 0


def test_weight_changes_move_rows_only_in_their_subtree(spark):
    from pyspark.sql import functions as F

    ids = spark.range(3000).select(
        sharding.shard_of(sharding.tree(24), F.col("id")).alias("a"), sharding.shard_of(sharding.tree(24, weights={5: 0.0}), F.col("id")).alias("b")
    ).collect()
    assert all(r.b != 5 for r in ids) and sum(r.a == 5 for r in ids) > 60
    # Inside the untouched region nothing moves to another shard of that region.
    assert all(r.b == r.a for r in ids if r.a >= 12)


def test_spot_signatures_edges(spark, docs, empty):
    rows = spotsigs.fingerprints(docs).collect()
    ordered = sorted(((i is not None, i or 0, t or "") for i, t, *_ in _rows()))
    want = Counter()
    for k, (named, i, t) in enumerate(ordered):
        nxt, q = ordered[(k + 1) % len(ordered)][2], len(t) // 4
        want[(i if named else None, len(t), hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    by = {r.doc_id: r for r in rows}
    assert by[7].fingerprint == by[8].fingerprint != "" and by[4].fingerprint == "" and by[7].near_next == 1.0
    for r in rows:
        a, b = ({f[k : k + 8] for k in range(0, len(f), 8)} for f in (r.fingerprint, r.edited_fingerprint))
        exact = len(a & b) / len(a | b) if a | b else 1.0
        assert r.near_edited == pytest.approx(exact if exact >= spotsigs.PRUNE else r.near_edited) and r.near_edited in (0.0, pytest.approx(exact))
    assert spotsigs.fingerprints(empty).count() == 0
    # Real rows over many ranges: the next document is found across range bounds.
    real = spark.read.parquet(f"{SMOKE}/documents.parquet")
    t = {r.doc_id: r.text for r in real.collect()}
    ids = sorted(t)
    for r in spotsigs.fingerprints(real).collect():
        x, nxt = t[r.doc_id], t[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        q = len(x) // 4
        assert r.edited_sha256 == hashlib.sha256((x[: len(x) - q] + nxt[:q]).encode()).hexdigest()


def test_toxicity_machine_finds_all_entries_within_the_limit():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    entries = [("idiot", False, True), ("scum", False, True), ("worthless", False, True), ("moron", False, False), ("achl", True, True), ("clown", False, True)]
    machine, rng = toxicity.LexiconMachine(entries), np.random.default_rng(1)
    for _ in range(1500):
        w = list(entries[rng.integers(len(entries))][0])
        for _ in range(rng.integers(0, 4)):
            k = rng.integers(len(w) + 1)
            w[k : k + rng.integers(2)] = rng.choice(list("abcdelnorst"), rng.integers(0, 2)).tolist()
        word = "".join(w)
        want = set()
        for e, (x, stem, fuzzy) in enumerate(entries):
            d = 0 if stem and word.startswith(x) else 99 if stem else distance(word, x)
            if d <= (toxicity.edit_limit(x, stem) if fuzzy else 0):
                want.add((e, d))
        assert set(machine.match(word)) == want


def test_toxicity_held_out_and_quotation(spark, docs, empty):
    real = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(real, labels)
    out = toxicity.toxicity(real, labels, model).join(labels, "doc_id").where("held_out").collect()
    found = [r for r in out if r.toxic]
    assert sum(r.predicted for r in found) >= 0.85 * len(found)
    assert sum(r.predicted for r in out if not r.toxic) <= 0.01 * len(out)
    words = model.words()
    _, (hit,) = toxicity.find_hits("you are an idiot and you know it", words)
    _, (told,) = toxicity.find_hits('the report said "idiot" was the word', words)
    assert told.quoted and not hit.quoted and hit.window > told.window
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(docs, labels, model).collect())
    assert toxicity.toxicity(empty, labels.limit(0)).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}


URLS = [
    ("http://WWW.Example.com/en/1?q=/x", "www.example.com", "/en/1", "www.example.com/en/"), ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/"), ("http://x.net/es/1", "x.net", "/es/1", "net/es/"), ("http://x.net/de/1", "x.net", "/de/1", None),
    ("http://a.com", "a.com", "", None), ("http://a.com#f/en/", "a.com", "", None), ("no scheme", "", "", None), (None, "", "", None), ("", "", "", None), ("http://x.net/fr/", "x.net", "/fr/", "net/fr/"),
    ("ftp://h/p://q", "h", "/p://q", None),
]


def test_url_rules_and_model(spark):
    pages = spark.createDataFrame([(k, u, "h", "x") for k, (u, *_) in enumerate(URLS)] + [(0, URLS[0][0], None, None)], "page_id long, url string, html string, rule string")
    got = url_filter.judge(pages).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r.host, r.path, r.rule) == URLS[r.page_id][1:]
        assert r.verdict == {"com/": "allow", "www.example.com/en/": "allow"}.get(r.rule, "block" if r.rule else r.verdict)
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_ratio_matches_brute_force(spark):
    pages = spark.read.parquet(f"{SMOKE}/pages.parquet")
    got = url_filter.judge(pages).collect()
    strings = defaultdict(lambda: [0, 0])
    for r in got:
        s = "\x02" + re.sub("[0-9]", "0", r.host + r.path) + "\x03"
        if r.rule:
            strings[s][r.verdict == "block"] += 1
        else:
            strings[s]
    counts = [Counter(), Counter()]
    contexts = [Counter(), Counter()]
    letters = set()
    for s, n in strings.items():
        for i in range(1, len(s)):
            letters.add(s[i])
            for k in range(1, min(5, i + 1) + 1):
                for c in (0, 1):
                    counts[c][s[i - k + 1 : i + 1]] += n[c]
                    contexts[c][(k, s[i - k + 1 : i])] += n[c]

    def p(c, gram):
        v = 1 / len(letters)
        for k in range(1, len(gram) + 1):
            g = gram[-k:]
            v = (counts[c][g] + 2 * v) / (contexts[c][(k, g[:-1])] + 2)
        return v

    for r in got:
        s = "\x02" + re.sub("[0-9]", "0", r.host + r.path) + "\x03"
        grams = [s[max(0, i - 4) : i + 1] for i in range(1, len(s))]
        assert r.ratio == pytest.approx(np.mean([np.log(p(0, g)) - np.log(p(1, g)) for g in grams]), rel=1e-9)


def test_url_query_judges_the_whole_url(spark, tmp_path):
    urls = [u for u, *_ in URLS] + ["http://x.net/de/1?utm_source=feed", "http://x.net/de/1#top", "other words", "http://x.net/de/2"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in queries.QUERIES["op10_url_filter"](spark, str(tmp_path)).collect()}
    for k, (_, host, path, rule) in enumerate(URLS):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
    n = len(URLS)
    assert len({got[k].ratio for k in (4, n, n + 1)}) == 3 and got[7].ratio != got[n + 2].ratio  # x.net/de/1 and two texts without a scheme
    assert got[8].ratio == got[9].ratio and got[4].ratio == got[n + 3].ratio  # null is empty, digits are one class

    # Every ratio against two models counted over the whole URLs.
    strings = {k: "\x02" + re.sub("[0-9]", "0", u or "") + "\x03" for k, u in enumerate(urls)}
    counts, contexts = [Counter(), Counter()], [Counter(), Counter()]
    letters = {c for s in strings.values() for c in s[1:]}
    for k, s in strings.items():
        if got[k].rule:
            c = int(got[k].verdict == "block")
            for i in range(1, len(s)):
                for m in range(1, min(5, i + 1) + 1):
                    counts[c][s[i - m + 1 : i + 1]] += 1
                    contexts[c][m, s[i - m + 1 : i]] += 1

    def p(c, gram):
        v = 1 / len(letters)
        for m in range(1, len(gram) + 1):
            v = (counts[c][gram[-m:]] + 2 * v) / (contexts[c][m, gram[-m:-1]] + 2)
        return v

    for k, s in strings.items():
        grams = [s[max(0, i - 4) : i + 1] for i in range(1, len(s))]
        assert got[k].ratio == pytest.approx(np.mean([np.log(p(0, g)) - np.log(p(1, g)) for g in grams]), rel=1e-9)
