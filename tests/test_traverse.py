"""Path and neighbourhood cases of the reference, restated as DataFrames."""

from conftest import edges_df, queries_df

from linkweave.operators import traverse as TR

CHAIN = [("A", "B"), ("B", "C"), ("C", "D"), ("D", "E")]


def _by_id(df):
    return {r["query_id"]: r for r in df.collect()}


def test_directed_cases(spark):
    e = edges_df(spark, [("A", "B"), ("B", "C"), ("A", "C2"), ("C2", "X"), ("P", "Q"), ("R", "S")])
    q = queries_df(
        spark,
        [
            (1, "A", "B", -1),
            (2, "A", "C", -1),
            (3, "A", "A", -1),
            (4, "P", "S", -1),  # no path
            (5, "A", "Z", -1),  # unknown node
        ],
    )
    r = _by_id(TR.shortest_paths(e, q))
    assert r[1]["found"] and r[1]["path"] == ["A", "B"] and r[1]["hops"] == 1
    assert r[2]["path"] == ["A", "B", "C"] and r[2]["hops"] == 2
    assert r[3]["found"] and r[3]["path"] == ["A"] and r[3]["hops"] == 0 and r[3]["explored"] == 1
    assert not r[4]["found"] and r[4]["path"] is None
    assert not r[5]["found"] and r[5]["explored"] == 0


def test_shortest_of_several(spark):
    e = edges_df(spark, [("A", "B"), ("B", "C"), ("A", "C")])
    r = _by_id(TR.shortest_paths(e, queries_df(spark, [(1, "A", "C", -1)])))
    assert r[1]["path"] == ["A", "C"] and r[1]["hops"] == 1


def test_depth_limits(spark):
    e = edges_df(spark, CHAIN)
    q = queries_df(spark, [(1, "A", "E", 4), (2, "A", "E", 3), (3, "A", "A", 0), (4, "A", "B", 0)])
    r = _by_id(TR.shortest_paths(e, q))
    assert r[1]["found"] and r[1]["hops"] == 4
    assert not r[2]["found"]
    assert r[3]["found"]
    assert not r[4]["found"]


def test_tie_break_lexicographic(spark):
    e = edges_df(spark, [("A", "C"), ("A", "B"), ("B", "D"), ("C", "D")])
    r = _by_id(TR.shortest_paths(e, queries_df(spark, [(1, "A", "D", -1)])))
    assert r[1]["path"] == ["A", "B", "D"]


def test_bidirectional_matches_bfs(spark):
    edges = [("A", "B"), ("B", "C"), ("C", "D"), ("D", "E"), ("E", "F"), ("A", "X"), ("X", "F"), ("F", "A")]
    e = edges_df(spark, edges)
    rows = [(i, s, t, -1) for i, (s, t) in enumerate([("A", "F"), ("B", "F"), ("C", "A"), ("E", "B"), ("A", "A")])]
    q = queries_df(spark, rows)
    a = _by_id(TR.shortest_paths(e, q))
    b = _by_id(TR.shortest_paths_bidirectional(e, q))
    for k in a:
        assert (a[k]["found"], a[k]["hops"], a[k]["path"]) == (b[k]["found"], b[k]["hops"], b[k]["path"])
    # consecutive path nodes are edges
    es = set(edges)
    for r in a.values():
        if r["path"]:
            assert all((x, y) in es for x, y in zip(r["path"], r["path"][1:]))


def test_explored_whole_levels(spark):
    pairs = [("A", c) for c in "BCDEFGHIJK"] + [("K", "Z")]
    r = _by_id(TR.shortest_paths(edges_df(spark, pairs), queries_df(spark, [(1, "A", "Z", -1)])))
    assert r[1]["found"] and r[1]["hops"] == 2 and r[1]["explored"] == 11


def test_neighborhood_cap_and_edges(spark):
    e = edges_df(spark, [("A", "B"), ("A", "C"), ("B", "C"), ("C", "D"), ("D", "A")])
    centres = spark.createDataFrame([(1, "A")], "query_id long, title string")
    nodes, sub = TR.neighborhood(e, centres, depth=2, max_nodes=3)
    got = sorted((r["title"], r["hops"]) for r in nodes.collect())
    assert got == [("A", 0), ("B", 1), ("C", 1)]
    assert sorted((r["source"], r["target"]) for r in sub.collect()) == [("A", "B"), ("A", "C"), ("B", "C")]


def test_connections_undirected_excludes_start(spark):
    e = edges_df(spark, [("A", "B"), ("B", "A"), ("C", "A")])
    centres = spark.createDataFrame([(1, "A")], "query_id long, title string")
    got = sorted(r["title"] for r in TR.connections_undirected(e, centres, 2, 100).collect())
    assert got == ["B", "C"]


def test_hot_hub_is_salted_and_results_unchanged(spark):
    # H holds ~2/3 of all edges: it must be detected as hot (salted over tasks).
    pairs = [("A", "H")] + [("H", f"L{i:03d}") for i in range(200)] + [(f"L{i:03d}", "Z") for i in range(0, 200, 2)]
    e = edges_df(spark, pairs)
    keyed = TR.KeyedEdges(e, "src")
    assert [r["_hot"] for r in keyed.hot.collect()] == ["H"]
    assert keyed.df.where("src = 'H'").select("_es").distinct().count() > 1
    keyed.unpersist()
    r = _by_id(TR.shortest_paths(e, queries_df(spark, [(1, "A", "Z", -1), (2, "H", "L150", 3)])))
    assert r[1]["path"] == ["A", "H", "L000", "Z"] and r[1]["hops"] == 3
    assert r[2]["path"] == ["H", "L150"]
    b = _by_id(TR.shortest_paths_bidirectional(e, queries_df(spark, [(1, "A", "Z", -1)])))
    assert b[1]["path"] == ["A", "H", "L000", "Z"]
    centres = spark.createDataFrame([(1, "A")], "query_id long, title string")
    nodes, _ = TR.neighborhood(e, centres, depth=2, max_nodes=1000)
    assert nodes.count() == 202
