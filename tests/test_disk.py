"""What a query keeps on disk beside its result."""

import datetime as dt
import random

from linkweave.operators import traverse as TR
from linkweave.sources import tables as TB


def _tables(spark, at):
    """Five customers with orders on two days, some of them in turn, and the lines of three orders."""
    day = lambda i: dt.datetime(1995, 1, 1 + i)
    orders = [(i, c, day(i // 8), "1-URGENT", "O") for i, c in enumerate([0, 1, 2, 2, 3, 0, 1, None, 4, 0, 4, 0])]
    lines = [(1, n, p, 1) for n, p in enumerate([7, 8, 8, 9])] + [(2, n, p, 1) for n, p in enumerate([7, 8, None, 9])] + [(3, 1, 5, 1)]
    spark.createDataFrame([(i, f"C{i}", "HOUSEHOLD") for i in range(5)], "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{at}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string, o_orderstatus string").write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{at}/lineitem.parquet")
    return str(at)


def test_derived_edges_are_made_once(spark, tmp_path):
    at = _tables(spark, tmp_path)
    want = {
        TB.fx_sparse_edges: {("C0", "C1"), ("C1", "C2"), ("C2", "C3"), ("C3", "C0"), ("C4", "C0"), ("C0", "C4")},
        TB.fx_parts_edges: {("Part#7", "Part#8"), ("Part#8", "Part#9")},
    }
    for edges, rows in want.items():
        df = edges(spark, at)
        assert sorted(map(tuple, df.collect())) == sorted(rows)
        # Each of the uses of a traversal sorted the whole table before.
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_neighbourhoods_grow_in_slices_of_compact_lists(spark, monkeypatch):
    made = []
    for name in ("_ckpt", "_ckpt_obs"):
        plain = getattr(TR, name)
        monkeypatch.setattr(TR, name, lambda df, plain=plain, **m: (out := plain(df, **m), made.append(out[0] if m else out))[0])
    r = random.Random(2)
    pairs = [(f"a{r.randrange(40):02}", f"a{r.randrange(40):02}") for _ in range(200)] + [("a01", None), ("a01", None), ("a02", None)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    rows = [(i if i < 40 else None, f"a{i:02}" if i < 40 else "a07", 1 + i % 3, 3 + i) for i in range(41)] + [(5, "a30", 1, 2), (99, "none", 1, 5)]
    centres = spark.createDataFrame(rows, "query_id long, title string, depth int, max_nodes int")
    want = set()
    for q in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == q and r[1] != "none"]
        depth, cap = max((r[2] for r in own), default=0), max((r[3] for r in own), default=0)
        level = {r[1] for r in own}
        kept, hops = [(0, t) for t in sorted(level)][:cap], 0
        while hops < depth and len(kept) < cap and level:
            hops += 1
            step = {b for a in level for b in near.get(a, ())} - {t for _, t in kept if t is not None}
            kept += [(hops, t) for t in sorted(step, key=lambda t: (t is not None, t or ""))][: cap - len(kept)]
            level = {t for h, t in kept if h == hops and t is not None}
        want |= {(q, t, h) for h, t in kept}
    edges = spark.createDataFrame(pairs, "src string, dst string")
    for numbers in (TR._SLICE_NUMBERS, 60):
        monkeypatch.setattr(TR, "_SLICE_NUMBERS", numbers)
        made.clear()
        nodes, sub = TR.neighborhood(edges, centres, 2, 10)
        held = [df for df in made if "query_id" in df.columns]
        # A row per question, its nodes as 4-byte numbers; a row per (question, node) and pairs of 32 bytes before.
        assert held and all(df.count() <= 41 and dict(df.dtypes)["kept"] == "array<int>" for df in held)
        assert sorted(map(repr, map(tuple, nodes.collect()))) == sorted(map(repr, want))
    assert len(held) > 6 and max(df.count() for df in held[1:]) < 40
    inner = {(q, t) for q, t, h in want if t is not None and h < max((r[2] for r in rows if r[0] == q), default=0)}
    ends = {(q, t) for q, t, _ in want}
    wanted = [(q, a, b) for a, b in pairs if b is not None for q in {r[0] for r in rows} if q is not None and (q, a) in inner and (q, b) in ends]
    assert sorted(map(tuple, sub.collect())) == sorted(wanted)


def test_bidirectional_search_goes_in_slices(spark, monkeypatch):
    made = []
    for name in ("_ckpt", "_ckpt_obs"):
        plain = getattr(TR, name)
        monkeypatch.setattr(TR, name, lambda df, plain=plain, **m: (out := plain(df, **m), made.append(out[0] if m else out))[0])
    r = random.Random(4)
    pairs = [(f"a{r.randrange(50):02}", f"a{r.randrange(50):02}") for _ in range(90)] + [("a01", "hub")] + [("hub", f"a{i:02}") for i in range(0, 50, 2)]
    rows = [(i, f"a{r.randrange(50):02}", f"a{r.randrange(50):02}", r.choice([2, 4])) for i in range(200)] + [(3, "a01", "a02", 4), (None, "a01", "a02", 4)]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    asked = spark.createDataFrame(rows, "query_id long, `from` string, `to` string, max_depth int")

    def starts():
        return max(df.count() for df in made if df.columns == ["slot", "node", "lvl"])

    want = sorted(map(repr, TR.shortest_paths_bidirectional(edges, asked).collect()))
    all_at_once = starts()
    made.clear()
    monkeypatch.setattr(TR, "_SLICE_QUESTIONS", 101)
    assert sorted(map(repr, TR.shortest_paths_bidirectional(edges, asked).collect())) == want
    assert starts() < all_at_once  # the levels of all questions were there together before
    assert sum("path=[" in w for w in want) > 30
