"""Communities and redirect ends against brute force and DuckDB."""

import random
from collections import Counter, defaultdict

import duckdb
import pytest

from linkweave.operators import community as CM
from linkweave.operators import graph as G
from linkweave.operators import rank as RK
from linkweave.plans.catalog import fx_graph

FIXTURE = "/root/testdata/sf0.001"


def _duck_modularity(pairs, labels):
    con = duckdb.connect()
    con.execute("CREATE TABLE e(src VARCHAR, dst VARCHAR)")
    con.execute("CREATE TABLE l(title VARCHAR, community VARCHAR)")
    con.executemany("INSERT INTO e VALUES (?, ?)", [list(p) for p in pairs])
    con.executemany("INSERT INTO l VALUES (?, ?)", [list(p) for p in labels.items()])
    return con.execute(
        """WITH u AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst),
        m AS (SELECT count(*)::DOUBLE AS m2 FROM u),
        c AS (SELECT a.community AS c, count(*) AS deg, count(*) FILTER (a.community = b.community) AS inside
              FROM u JOIN l a ON a.title = src JOIN l b ON b.title = dst GROUP BY 1)
        SELECT coalesce(sum(inside / m2 - (deg / m2) * (deg / m2)), 0) FROM c, m"""
    ).fetchone()[0]


def _label_propagation(pairs):
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    label, order = {u: u for u in near}, random.Random(1)
    for _ in range(40):
        nodes, changed = sorted(near), False
        order.shuffle(nodes)
        for u in nodes:
            seen = Counter(label[v] for v in near[u])
            top = max(seen.values())
            if seen[label[u]] < top:
                label[u], changed = min(c for c in seen if seen[c] == top), True
        if not changed:
            break
    return label


def test_louvain_on_the_page_graph(spark):
    nodes, edges = fx_graph(spark, FIXTURE)
    out, value = CM.louvain(edges, nodes)
    rows = out.collect()
    pairs = {tuple(r) for r in edges.collect()}
    labels = {r.title: r.community for r in rows}
    assert set(labels) == {r.title for r in nodes.collect()} and len(rows) == len(labels)
    assert value == pytest.approx(_duck_modularity(pairs, labels), abs=1e-12)
    assert CM.modularity(edges, out).first()[0] == pytest.approx(value, abs=1e-12)
    assert value >= _duck_modularity(pairs, _label_propagation(pairs))
    size = Counter(labels.values())
    assert all(r.size == size[r.community] and r.community <= r.title for r in rows)
    assert all(labels[c] == c for c in size)


def test_louvain_does_not_depend_on_partitions(spark):
    cliques = [(f"{g}{i}", f"{g}{j}") for g in "abc" for i in range(5) for j in range(i)] + [("a0", "b0"), ("b1", "c1"), ("c2", "c2")]
    edges = spark.createDataFrame(cliques, "src string, dst string")
    nodes = G.graph_nodes(edges).unionByName(spark.createDataFrame([("alone",)], "title string"))
    want = {f"{g}{i}": f"{g}0" for g in "abc" for i in range(5)} | {"alone": "alone"}
    held = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "5"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            out, value = CM.louvain(edges.repartition(int(parts) + 1), nodes)
            assert {r.title: r.community for r in out.collect()} == want and value > 0.5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    none = edges.limit(0)
    out, value = CM.louvain(none, spark.createDataFrame([("x",), ("y",)], "title string"))
    assert value == 0.0 and sorted(tuple(r) for r in out.collect()) == [("x", "x", 1), ("y", "y", 1)]


def test_redirect_ends_tell_cycles_from_long_chains(spark):
    rows = [(f"c{i:02}", f"c{i + 1:02}") for i in range(14)] + [("x", "y"), ("y", "x"), ("z", "x"), ("self", "self"), ("open", None), ("c00", "c01")]
    pages = spark.createDataFrame([(t, "redirect", to) for t, to in rows] + [("c14", "success", None)], "title string, fetch_status string, redirect_to string")
    got = {r.title: (r.final_title, r.hops, r.cyclic) for r in RK.redirect_ends(pages).collect()}
    assert got["c00"] == ("c14", 14, False) and got["c13"] == ("c14", 1, False)
    assert got["open"] == (None, 1, False)
    assert {t for t, v in got.items() if v[2]} == {"x", "y", "z", "self"} and got["z"] == (None, None, True)
    bounded = {r.title: (r.final_title, r.depth, r.resolved) for r in RK.resolve_redirects(pages).collect()}
    assert bounded["c00"] == (None, 10, False) and bounded["c03"] == ("c14", 10, True) and bounded["x"] == (None, 10, False)
