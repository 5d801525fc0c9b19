"""Operators 11 to 13 against brute force: language model, manifest, conversations."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from linkweave.llm import conversations, lm_scoring, merkle

SMOKE = "/root/testdata/sf0.001"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


# ---- operator 11
def brute_scores(rows, order, k):
    def tokens(t):
        return [*re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")), "\0end"]

    def learns(d):
        return d is not None and zlib.crc32(str(d).encode()) % 7 != 2

    counts = Counter()
    for d, t, *_ in rows:
        if learns(d):
            w = tokens(t)
            for n in range(1, order + 1):
                counts.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1)
    distinct = sum(len(g) == 1 for g in counts)

    def p(h, w):
        if not h:
            return (counts[(w,)] + 1) / (total + distinct + 1)
        return (counts[(*h, w)] + k * p(h[1:], w)) / (counts[h] + k)

    out = []
    for d, t, *_ in rows:
        w = tokens(t)
        base = sum(math.log10(p((), x)) for x in w)
        score = sum(math.log10(p(tuple(w[max(0, i - order + 1) : i]), x)) for i, x in enumerate(w))
        out.append((d, not learns(d), len(w), sum(counts[(x,)] > 0 for x in w), total, base, score))
    return out


def same_scores(got, want):
    got, want = (sorted(map(tuple, x), key=lambda r: (str(r[0]), r[2], round(r[5], 6))) for x in (got, want))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_scores_match_brute_force(spark):
    rows = [(r.doc_id, r.text, 1, "k") for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()][:80]
    rows += [(None, "the CAT the cat", 1, "k"), (9001, None, 1, "k"), (9001, None, 1, "k"), (9002, "", 1, "k"), (9003, "a\x0bb c Ü ü " * 700, 1, "k"), (9004, "x" * 5000, 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block int, kind string")
    # Small blocks and segments: texts are cut, and walks start from the tokens before.
    for order, block, segment in ((2, 1 << 20, 256), (3, 300, 7), (1, 1000, 9)):
        got = lm_scoring.score(docs.repartition(3), order=order, block_tokens=block, segment=segment, owner_entries=1000).collect()
        same_scores(got, brute_scores(rows, order, lm_scoring.PRIOR))
    assert lm_scoring.score(docs.limit(0)).count() == 0
    alone = spark.createDataFrame([(None, "no model"), (None, "")], "doc_id long, text string")
    assert {(r.train_tokens, r.base_score, r.score) for r in lm_scoring.score(alone).collect()} == {(0, 0.0, 0.0)}


def test_probabilities_of_a_context_sum_to_one():
    text = b"a b a c a b b a"
    tokens, _ = lm_scoring.token_hashes([text])
    vocab = np.unique(tokens)
    counts = {1: Counter(tokens.tolist()), 2: Counter(zip(tokens.tolist(), tokens.tolist()[1:], strict=False))}
    n, v, k = len(tokens), len(vocab), 3.0
    for h in vocab.tolist():
        own = sum(c for (a, _), c in counts[2].items() if a == h)
        total = sum((counts[2][h, w] + k * (counts[1][w] + 1) / (n + v + 1)) / (own + k) for w in vocab.tolist())
        assert total + k / (own + k) / (n + v + 1) == pytest.approx(1)  # one unknown word has the rest


def test_long_texts_are_hashed_in_parts():
    text = b" ".join(b"w%d" % (i % 97) for i in range(3000)) + b"  " + b"y" * 900 + b" tail "
    whole = lm_scoring.token_hashes([text])[0][:-1]
    parts = [lm_scoring.token_hashes([p])[0][:-1] for p in lm_scoring._cut(text, 256)]
    assert np.array_equal(np.concatenate(parts), whole) and len(parts) > 20
    assert b"".join(lm_scoring._cut(text, 256)) == text


# ---- operator 12
def _h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, _h("".join(map(_field, r))), r))

    def up(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append([_h("".join(out[-1][k : k + 16])) for k in range(0, len(out[-1]), 16)])
        return out

    def steps(tree, i):
        for level in tree[:-1]:
            yield i % 16, level[i // 16 * 16 : i // 16 * 16 + 16]
            i //= 16

    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: up([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    top = up([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (_, _, leaf, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            path = [*steps(trees[s], i), *steps(top, k)]
            proof = _h("".join(d for own, run in path for j, d in enumerate(run) if j != own))
            now = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                now = _h("".join(map(_field, (*r[:4], None if r[4] is None else lower(r[4])))))
            for own, run in path:
                now = _h("".join(now if j == own else d for j, d in enumerate(run)))
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return out


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest_matches_brute_force(spark, levels):
    schema = "doc_id long, source string, lang string, n_chars long, text string, level int, idx long"
    cases = [
        [(None, None, None, None, None), (5, None, "en", 3, "ABC"), (5, None, "en", 3, "ABC"), (5, "", "x", None, ""), (1, "é", None, 1, "Ü")],
        [(3, "s", "l", 1, "T")],
        [(i, "a" if i % 3 else f"s{i % 40}", "en", i, f"Text {i}") for i in range(1200)],
        [],
    ]
    for rows in cases:
        docs = spark.createDataFrame([(*r, 1, 2) for r in rows], schema)
        got = merkle.prove(docs, levels).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
        assert sorted(map(tuple, got), key=str) == sorted(brute_manifest(rows), key=str)


def test_positions_are_the_postorder():
    for n in (1, 2, 15, 16, 17, 256, 257, 300, 4097):
        order = []

        def visit(level, i, n=n, order=order):
            if level:
                for j in range(16 * i, min(16 * i + 16, merkle.width(n, level - 1))):
                    visit(level - 1, j)
            order.append((level, i))

        visit(merkle.height(n), 0)
        assert [merkle.position(n, *x) for x in order] == list(range(len(order)))


def test_log_is_one_gapless_postorder_per_tree(spark):
    docs = spark.createDataFrame([(i, "a" if i % 4 else "b", "en", i, f"t{i}") for i in range(1500)], "doc_id long, source string, lang string, n_chars long, text string")
    for levels in (1, 2, 3):
        _, log, _ = merkle.manifest(docs, levels)
        places = defaultdict(list)
        for r in log.collect():
            assert r.pos == merkle.position(r.n, r.level, r.idx)
            places[r.tree].append(r.pos)
        assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) == {"a", "b"}


# ---- operator 13
def _space(v):
    return " " if v is None else str(v)


def brute_repair(rows):
    by = defaultdict(list)
    for c, t, r, x, *_ in rows:
        by[c]
        r, x, d = _space(r), _space(x), zlib.crc32(f"{_space(c)}:{_space(t)}".encode()) % 20
        if d != 0:
            x = "" if d == 1 else re.sub("[.!?]", "", x) if d == 2 else x
            by[c] += [(t, "user" if d == 4 else r, x)] * (2 if d == 3 else 1)
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    out = []
    for c, rs in by.items():
        rs.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1], z[2]))
        seen, faults = set(), []
        for _, r, x in rs:
            bare = re.sub(r"[\x20\x09-\x0d]+$", "", x)
            faults.append("b" if not bare else "d" if (r, x) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((r, x))

        @lru_cache(None)
        def best(i, q, inserted=0, rs=rs, faults=faults):
            options = [(0, "", ())] if i == len(rs) and q in (0, 3) else []

            def add(cost, letter, row, rest):
                options.append((cost + rest[0], letter + rest[1], row + rest[2]))

            for role in ("user", "assistant"):
                if inserted < 3 and (q, role[0]) in moves:
                    add(5, "I", (role + ":",), best(i, moves[q, role[0]], inserted + 1))
            if i < len(rs):
                _, r, x = rs[i]
                add(2, "D", (), best(i + 1, q))
                if faults[i] not in ("b", "d"):
                    extra = 5 * (faults[i] == "t")
                    if (q, r[:1]) in moves:
                        add(extra, "K", (f"{r}:{x}",), best(i + 1, moves[q, r[:1]]))
                    for role in ("user", "assistant"):
                        if (q, role[0]) in moves:
                            add(extra + 1, "R", (f"{role}:{x}",), best(i + 1, moves[q, role[0]]))
            return min(options) if options else (10**9, "", ())

        cost, audit, kept = best(0, 0)
        turns = [t for t, _, _ in rs if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:], strict=False))
        out.append((c, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def _awkward(n, conversations_, seed):
    rng = random.Random(seed)

    def text():
        return rng.choice(["Hi.", "ok", "Yes! ", "  ", "", None, "é?\n", "a\tb", "x" * 50 + "."]) if rng.random() < 0.6 else f"t{rng.random()}{rng.choice('.!ab')}"

    return [(rng.choice([None, *range(conversations_)]), rng.choice([None, *range(40)]), rng.choice(["user", "assistant", "system", "tool", None, "Ada", ""]), text(), 1, 2) for _ in range(n)]


def test_repair_matches_brute_force(spark):
    schema = "conv_id long, turn long, role string, text string, pos int, seg int"
    real = [(*r, 1, 2) for r in spark.read.parquet(f"{SMOKE}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    cases = [(real, (1024,)), (_awkward(300, 20, 3), (1024, 3)), (_awkward(250, 1, 4), (16,)), ([], (5,)), ([(i, i, "user", "x", 1, 2) for i in range(40)], (5,))]
    for rows, sizes in cases:
        want = sorted(brute_repair(rows), key=str)
        for size in sizes:  # small segments: the matrices of a conversation's segments are multiplied up
            got = conversations.repair(spark.createDataFrame(rows, schema), size).collect()
            assert sorted(map(tuple, got), key=str) == want


def test_checkpointed_walk_is_the_full_table_walk():
    rng = random.Random(7)
    for _ in range(60):
        codes = "".join(rng.choice("suaxSUAXbd") for _ in range(rng.randrange(1, 40)))
        plan, state = conversations.SegmentPlan(codes, conversations.ENDS), 0
        vectors = [list(conversations.ENDS)]
        for code in reversed(codes):
            vectors.append(conversations._row_costs(code, vectors[-1]))
        vectors.reverse()
        assert plan.before == vectors[0] and len(plan.checkpoints) <= len(codes) ** 0.5 + 2
        for i, (_, after) in enumerate(plan.walk(0)):
            state = after
            assert vectors[i + 1][state] < conversations._FAR
        matrix = conversations.segment_matrix(codes)
        assert [min(matrix[4 * q + j] + conversations.ENDS[j] for j in range(4)) for q in range(4)] == vectors[0]
