"""Searches of whole blocks on a sent graph, against a plain search and the distributed one."""

import random

import numpy as np
import pytest
from conftest import edges_df, queries_df

from linkweave.operators import bitsearch as BS
from linkweave.operators import traverse as TR


def _plain(pairs, starts, to, depth):
    """(path, nodes visited after the starts), level by level with whole paths."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    level, seen, n = {s: [s] for s in starts}, set(starts), 0
    while depth < 0 or depth > 0:
        step = {}
        for a, path in level.items():
            for b in near.get(a, ()):
                if b == to or b not in seen:
                    step[b] = min(step.get(b, [*path, b]), [*path, b])
        if to in step:
            return step[to], n
        depth -= 1
        if not step or depth == 0:
            return None, n
        seen |= step.keys()
        n += len(step)
        level = step
    return None, n


def _graph(kind, n=60):
    r = random.Random(kind)
    if kind == "chain":
        return [(i, i + 1) for i in range(n - 1)] + [(i + 2, i) for i in range(0, n - 2, 7)]
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(3 * n)]
    return pairs + [(i, 5) for i in range(n)] + [(5, i) for i in range(0, n, 3)] if kind == "hub" else pairs + pairs[:20]


@pytest.mark.parametrize("kind", ["loose", "hub", "chain"])
@pytest.mark.parametrize("small", [False, True])
def test_block_search_is_the_plain_search(kind, small, monkeypatch):
    if small:  # hubs beyond the diagonals, in-edges in many lots, a block that has to be halved
        for name, value in (("DIAGONALS", 2), ("_STEP", 3), ("_CHUNK", 7), ("HELD_BYTES", 700)):
            monkeypatch.setattr(BS, name, value)
    n, r = 60, random.Random(1)
    pairs = _graph(kind, n)
    asked = [([r.randrange(n) for _ in range(1 + i % 2)], r.randrange(n), r.choice([-1, 1, 2, 3, 6])) for i in range(150)]
    src, dst = (np.array(c, np.int32) for c in zip(*pairs, strict=True))
    g = BS.InEdges.of(src, dst, n)
    got = BS.search(g, [np.array(s) for s, _, _ in asked], np.array([t for _, t, _ in asked]), np.array([d for _, _, d in asked]))
    want = [_plain(pairs, *q) for q in asked]
    assert got == want and {p is None for p, _ in want} == {True, False}


def test_column_counts():
    bits = np.random.default_rng(3).integers(0, 1 << 63, (5000, 3), np.uint64) << np.uint64(1)
    want = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").sum(axis=0)
    assert (BS.column_counts(bits) == want).all() and not BS.column_counts(bits[:0]).any()


@pytest.mark.parametrize("undirected", [False, True])
def test_many_questions_take_no_job_per_level(spark, monkeypatch, undirected):
    """The same rows by blocks on a sent graph as by joins, without a checkpoint per level (12 levels and more)."""
    r = random.Random(5)
    names = [f"n{i:03}" for i in range(90)]
    pairs = [(r.choice(names[:60]), r.choice(names[:60])) for _ in range(110)] + [(names[i], names[i + 1]) for i in range(60, 80)] + [(names[3], names[60])]
    pairs += pairs[:9]
    rows = [(i, r.choice(names), r.choice(names), r.choice([-1, -1, 0, 2, 5, None])) for i in range(300)]
    rows += [(7, "n001", "n002", -1), (8, rows[8][1], rows[8][2], rows[8][3]), (None, "n001", "n002", -1), (301, "n003", "n079", -1), (302, None, "n001", 3)]
    edges, asked = edges_df(spark, pairs).repartition(3), queries_df(spark, rows)
    find = TR.shortest_paths_undirected if undirected else TR.shortest_paths
    made = []
    plain = TR._ckpt_obs
    monkeypatch.setattr(TR, "_ckpt_obs", lambda df, **m: made.append(m) or plain(df, **m))
    got = sorted(map(repr, find(edges, asked).collect()))
    assert len(made) <= 2
    monkeypatch.setattr(TR, "_SENT_EDGES", 0)
    want = sorted(map(repr, find(edges, asked).collect()))
    assert got == want and len(got) >= len(rows) and len(made) > 15
