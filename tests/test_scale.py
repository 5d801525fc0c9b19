"""Steps whose cost must grow no faster than their input."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from linkweave.operators import community as CM
from linkweave.operators import similarity as SIM
from linkweave.operators import traverse as TR
from linkweave.streaming import refresh as R


def test_staged_files_grow_with_rows_not_with_tasks(spark, monkeypatch):
    schema = R.UPDATE_SCHEMA
    rows = [(i, f"P{i % 5}", i % 5, "success", "h", None, dt.datetime(2024, 1, 1 + i % 3)) for i in range(240)]
    updates = spark.createDataFrame(rows, schema).repartition(8)
    few = R.stage_updates(updates, f"{R.scratch(spark, 'staged')}/few")
    assert len(spark.read.parquet(few).inputFiles()) == 3  # a file a day; 8 tasks times 3 days before
    assert spark.read.parquet(few).select(updates.columns).exceptAll(updates).isEmpty() and spark.read.parquet(few).count() == 240
    monkeypatch.setattr(R, "STAGED_ROWS", 20)  # a large day is more than one file
    more = R.stage_updates(updates, f"{R.scratch(spark, 'staged')}/more")
    assert 6 <= len(spark.read.parquet(more).inputFiles()) <= 3 + 12 and spark.read.parquet(more).count() == 240


def test_newest_row_in_one_pass():
    def frame(*rows):
        return pd.DataFrame([(e, "A", 1, s, pd.Timestamp(t) if t else pd.NaT) for e, s, t in rows], columns=["event_id", "title", "page_id", "fetch_status", "updated_at"])

    def newest(after, *chunks):
        got = R._newest(iter(frame(*c) for c in chunks), after)
        return got and (got.event_id, got.fetch_status)

    a, b = "2024-01-01", "2024-01-02"
    assert newest(None, [(2, "x", b), (1, "y", b), (9, "z", a)]) == (2, "x")
    assert newest(None, [(2, "x", b)], [(3, "y", a), (2, "z", b)], [(4, "w", b)]) == (4, "w")
    assert newest((pd.Timestamp(b), 2), [(2, "x", b), (9, "y", a), (1, "z", b)]) is None
    assert newest((pd.Timestamp(a), 2), [(9, "n", None), (3, "x", a)]) == (3, "x")
    assert newest(None, [(9, "n", None), (3, "x", b)], [(4, "y", b)]) == (9, "n")  # without a time: last of the first chunk


def test_vectors_travel_once_per_large_block(spark, monkeypatch):
    """The way by block pairs does not cut blocks as small as the limit of the other way."""
    seen = []
    pairs = SIM._block_pairs
    monkeypatch.setattr(SIM, "_block_pairs", lambda q, c, k, own, nb, *a, **b: seen.append(nb) or pairs(q, c, k, own, nb, *a, **b))
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(300)] + [(300, None), (301, [0.0, 0.0, 0.0]), (302, [1.0]), (303, [float("nan"), 1.0, 1.0])]
    vec = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(2)
    q = vec.select(F.col("vec_id").alias("query_id"), "embedding")
    plan = SIM.similar_topk(q, vec, 5, exclude_self=True, broadcast_max=3)
    assert len(seen) == 1 and seen[0] <= 2 + (2 * spark.sparkContext.defaultParallelism) ** 0.5  # 102 before
    got = {tuple(r) for r in plan.collect()}
    assert got == {tuple(r) for r in SIM.similar_topk(q, vec, 5, exclude_self=True).collect()}
    assert got == {tuple(r) for r in SIM.similar_topk(q, vec, 5, exclude_self=True, broadcast_max=3, blocks=9).collect()}
    assert {(r[1], r[2]) for r in got if r[0] == 0} == {(i, 1.0) for i in (35, 70, 105, 140, 175)}  # ties: the lesser ids


def test_partial_lists_of_a_query_travel_once(spark):
    vec = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "vec_id long, embedding array<float>")
    plan = SIM.similar_approx(vec, 3)._jdf.queryExecution().executedPlan().toString()
    assert "_salt" not in plan
    assert dict(SIM.list_index(vec)[0].dtypes)["embedding"] == "array<float>"  # not made twice as wide before it travels


def test_long_paths_from_cells_without_paths(spark):
    """More levels than are kept apart, ties, a cycle, a question without an end and one with a limit."""
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(11)] + [("n03", "n01"), ("n04", "m05"), ("m05", "n06")]
    edges = spark.createDataFrame(chain, "src string, dst string")
    rows = [(1, "n00", "n11", -1), (2, "n05", "n09", -1), (3, "n09", "n00", -1), (4, "n00", "n11", 10)]
    asked = spark.createDataFrame(rows, "query_id long, `from` string, `to` string, max_depth int")
    long = ["n00", "n01", "n02", "n03", "n04", "m05", *[f"n{i:02}" for i in range(6, 12)]]
    for search in (TR.shortest_paths, TR.shortest_paths_bidirectional):
        got = {r.query_id: (r.found, r.path, r.hops) for r in search(edges, asked).collect()}
        assert got == {1: (True, long, 11), 2: (True, [f"n{i:02}" for i in range(5, 10)], 4), 3: (False, None, None), 4: (False, None, None)}


def test_a_level_is_cells_of_64_questions(spark, monkeypatch):
    seen = []
    counts = TR._bit_counts
    monkeypatch.setattr(TR, "_bit_counts", lambda cells, slots: seen.extend(cells) or counts(cells, slots))
    hub = [(f"s{i:03}", "hub") for i in range(100)] + [("hub", "x"), ("x", "y"), ("y", "z")]
    asked = spark.createDataFrame([(i, f"s{i:03}", "z", -1) for i in range(100)], "query_id long, `from` string, `to` string, max_depth int")
    out = TR.shortest_paths(spark.createDataFrame(hub, "src string, dst string"), asked).collect()
    assert all(r.path == [r["from"], "hub", "x", "y", "z"] and r.explored == 4 for r in out) and len(out) == 100
    words = -(-100 // 64) + spark.sparkContext.defaultParallelism + 8  # words are filled per range of questions
    assert seen and all(c.count() <= words and "path" not in c.columns for c in seen)  # 100 rows with paths before


def test_capped_neighbourhood_holds_bounded_lists(spark, monkeypatch):
    most = []
    top = TR.top_k_per_group
    monkeypatch.setattr(TR, "top_k_per_group", lambda df, group, order, k, **kw: most.append((group, k)) or top(df, group, order, k, **kw))
    pairs = [("a", f"b{i:02}") for i in range(30)] + [(f"b{i:02}", f"c{j:02}") for i in range(3) for j in range(30)] + [("d", "a"), ("d", None), ("d", "d")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    centres = spark.createDataFrame([(1, "a"), (2, "b01"), (3, "d"), (4, "none"), (1, "a")], "query_id long, title string")
    nodes, _ = TR.neighborhood(edges, centres, 2, 5)
    got = {}
    for r in sorted(map(tuple, nodes.collect()), key=lambda r: (r[0], r[2], r[1] or "")):
        got.setdefault(r[0], []).append(r[1:])
    assert got[1] == [("a", 0), *[(f"b{i:02}", 1) for i in range(4)]] and got[2] == [("b01", 0), *[(f"c{i:02}", 1) for i in range(4)]]
    assert got[3] == [("d", 0), (None, 1), ("a", 1), ("b00", 2), ("b01", 2)] and 4 not in got
    assert most == [(["at"], 5)]  # of a node's out-edges no more than the cap; the rows of all pairs were ranked before


def test_last_level_of_both_sides_is_not_made(spark, monkeypatch):
    made = []
    for name in ("_ckpt", "_ckpt_obs"):
        plain = getattr(TR, name)
        monkeypatch.setattr(TR, name, lambda df, plain=plain, **m: (out := plain(df, **m), made.append(out[0] if m else out))[0])
    pairs = [("a", "h"), ("b", "h")] + [(x, f"l{i:03}") for x in ("h", "k") for i in range(200)] + [(f"l{i:03}", "z") for i in (7, 5)] + [("z", "y"), ("z", "y")]
    rows = [(1, "a", "l150", -1), (2, "b", "z", -1), (2, "b", "z", -1), (3, "a", "y", 3), (4, "z", "a", -1), (None, "a", "h", -1), (5, "b", "y", -1)]
    asked = spark.createDataFrame(rows, "query_id long, `from` string, `to` string, max_depth int")
    edges = spark.createDataFrame(pairs, "src string, dst string")
    got = {r.query_id: (r.path, r.hops, r.explored) for r in TR.shortest_paths_bidirectional(edges, asked).collect()}
    assert got[1] == (["a", "h", "l150"], 2, 2) and got[3] == (None, None, 3) and got[4] == (None, None, 2)
    assert got[5][0] == ["b", "h", "l005", "z", "y"]
    assert got[2][1:] == (3, 10)  # twice there: counts as often
    made.clear()
    TR.shortest_paths_bidirectional(edges, asked.where("query_id IN (1, 4)")).count()
    held = [df for df in made if "node" in df.columns and {"slot", "query_id"} & {*df.columns}]
    assert held and max(df.count() for df in held) <= 4  # the leaves of h, with their paths, before


def test_louvain_keeps_a_row_per_node_and_round(spark, monkeypatch):
    made = []
    for name in ("_ckpt", "_ckpt_obs"):
        plain = getattr(CM, name)
        monkeypatch.setattr(CM, name, lambda df, plain=plain, **m: (out := plain(df, **m), made.append(out[0] if m else out))[0])
    # Four cliques of eight in a ring: 32 nodes, 116 edges.
    pairs = [(f"{g}{i}", f"{g}{j}") for g in "abcd" for i in range(8) for j in range(i)] + [("a0", "b1"), ("b0", "c1"), ("c0", "d1"), ("d0", "a1")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    nodes = edges.selectExpr("src AS title").union(edges.selectExpr("dst")).distinct()
    out, value = CM.louvain(edges, nodes)
    sizes = [df.count() for df in made if {"node", "c"} <= {*df.columns}]
    assert sizes and max(sizes) <= 32  # the sums per node and community, too, before
    monkeypatch.setattr(CM, "_LONG", 0)  # decimals, where a product could be too large
    again, same = CM.louvain(edges, nodes)
    assert same == value and {tuple(r) for r in again.collect()} == {tuple(r) for r in out.collect()}
    assert {(r.title[0], r.community, r.size) for r in out.collect()} == {(g, f"{g}0", 8) for g in "abcd"}
