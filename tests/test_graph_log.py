"""Versions of the graph log: deltas, tombstones, folding, retention, racing writers."""

import pytest

from linkweave.sources import export as EX
from linkweave.sources import graph_log as GL


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def _titles(spark, names):
    return spark.createDataFrame([(n,) for n in names], "title string")


def _state(spark, root, version=None):
    nodes, edges = GL.read(spark, root, version)
    return sorted(r[0] for r in nodes.collect()), sorted(tuple(r) for r in edges.collect())


def test_versions_deltas_and_folds(spark, tmp_path):
    root = str(tmp_path / "g")
    with pytest.raises(FileNotFoundError):
        GL.read(spark, root)
    with pytest.raises(FileNotFoundError):
        GL.write_delta(_titles(spark, ["A"]), _titles(spark, []), _edges(spark, []), root)
    GL.write_full(_titles(spark, ["A", "B", "alone"]), _edges(spark, [("A", "B"), ("B", "A")]), root)
    GL.write_delta(_titles(spark, ["A"]), _titles(spark, []), _edges(spark, [("A", "C"), ("A", "C")]), root)
    GL.write_delta(_titles(spark, ["B", "Z"]), _titles(spark, ["named"]), _edges(spark, []), root)
    GL.fold(spark, root)
    GL.write_delta(_titles(spark, ["A"]), _titles(spark, []), _edges(spark, [("A", "D")]), root)
    states = {
        1: (["A", "B", "alone"], [("A", "B"), ("B", "A")]),
        2: (["A", "B", "C", "alone"], [("A", "C"), ("B", "A")]),
        3: (["A", "B", "C", "alone", "named"], [("A", "C")]),
        4: (["A", "B", "C", "alone", "named"], [("A", "C")]),
        5: (["A", "B", "D", "alone", "named"], [("A", "D")]),  # C was there through an edge that is gone
    }
    for v, want in states.items():
        assert _state(spark, root, v) == want, v
    assert _state(spark, root) == states[5]
    with pytest.raises(FileNotFoundError):
        GL.read(spark, root, 6)
    # A repeated delta changes nothing.
    GL.write_delta(_titles(spark, ["A"]), _titles(spark, []), _edges(spark, [("A", "D")]), root)
    assert _state(spark, root) == states[5]
    entries = GL.versions(spark, root)
    assert [e["version"] for e in entries] == [1, 2, 3, 4, 5, 6] and [e["kind"] for e in entries][:4] == ["full", "delta", "delta", "full"]
    assert entries[1]["edge_rows"] == 2 and entries[2]["tombstones"] == 2  # what came, not the graph
    assert GL.retire(spark, root, keep_full=1) == 3
    with pytest.raises(FileNotFoundError):
        GL.read(spark, root, 2)
    assert _state(spark, root, 4) == states[4] and _state(spark, root) == states[5]


def test_racing_writers_are_both_kept(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "g")
    GL.write_full(_titles(spark, ["A"]), _edges(spark, [("A", "B")]), root)
    seen = GL.versions(spark, root)
    GL.write_delta(_titles(spark, []), _titles(spark, []), _edges(spark, [("X", "Y")]), root)
    real = GL.versions
    # The second writer has looked before the first one committed: it wants the same number.
    with monkeypatch.context() as m:
        m.setattr(GL, "versions", lambda *a: seen)
        entry = GL.write_delta(_titles(spark, []), _titles(spark, []), _edges(spark, [("P", "Q")]), root)
    assert entry["version"] == 3 and GL.versions is real
    assert _state(spark, root)[1] == [("A", "B"), ("P", "Q"), ("X", "Y")]


def test_data_without_a_commit_is_never_read(spark, tmp_path):
    root = str(tmp_path / "g")
    GL.write_full(_titles(spark, ["A"]), _edges(spark, [("A", "B")]), root)
    _edges(spark, [("half", "done")]).write.parquet(f"{root}/data/crashed/edges")
    (tmp_path / "g/log/_aside").write_text("{")
    assert _state(spark, root)[1] == [("A", "B")]


def test_repeated_exports_count_what_lands(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "success"), (2, "b", "success"), (3, "c", "error")], "id long, title string, fetch_status string")
    links = spark.createDataFrame([(1, "b"), (1, "c"), (2, "a")], "source_id long, target_title string")
    sink = str(tmp_path / "sink")
    first, second = (EX.full_export(pages, links, sink).first() for _ in range(2))
    assert (first.nodes_landed, first.edges_landed, first.nodes_submitted, first.edges_submitted) == (2, 2, 2, 3)
    assert (second.nodes_landed, second.edges_landed, second.nodes_submitted, second.edges_submitted) == (0, 0, 2, 3)
    more = links.unionByName(spark.createDataFrame([(2, "b")], "source_id long, target_title string"))
    assert EX.full_export(pages, more, sink).first().edges_landed == 1


def test_range_digests_find_every_difference(spark):
    rows = [(f"a{i % 50}", f"b{i}") for i in range(3000)] + [("twice", "x"), ("twice", "x")]
    want = _edges(spark, rows)
    assert tuple(EX.compare_rows(want, want.repartition(5), ["src", "dst"]).first()) == (3002, 3002, 0, 0)
    other = _edges(spark, rows[3:] + [("new", "y"), ("twice", "x"), (None, "z")])
    assert tuple(EX.compare_rows(want, other, ["src", "dst"]).first()) == (3002, 3002, 3, 3)
    none = want.limit(0)
    assert tuple(EX.compare_rows(want, none, ["src", "dst"]).first()) == (3002, 0, 3002, 0)
    assert tuple(EX.compare_rows(none, none, ["src", "dst"]).first()) == (0, 0, 0, 0)
