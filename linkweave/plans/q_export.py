"""Registered queries: snapshots and export."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from linkweave.plans import oracle as O
from linkweave.plans.catalog import fx_graph, register
from linkweave.plans.q_state import M9_CTES, m9_changes
from linkweave.session import checkpoint_dir
from linkweave.sources import export as EX
from linkweave.sources import graph_log as GL
from linkweave.sources import snapshot as SN
from linkweave.sources import tables as TB

DELTA_SINCE = "1995-01-01 00:00:00"

_SUCCESS = "(SELECT title FROM fx_pages WHERE fetch_status = 'success')"
_CLOSED = f"SELECT DISTINCT src, dst FROM fx_edges WHERE src IN {_SUCCESS} AND dst IN {_SUCCESS}"
_DELTA_NODES = f"""SELECT DISTINCT title FROM fx_pages
WHERE fetch_status = 'success' AND created_at > TIMESTAMP '{DELTA_SINCE}'"""
_DELTA_EDGES = f"""SELECT DISTINCT p.title AS src, l.target_title AS dst
FROM fx_links l JOIN fx_pages p ON p.id = l.source_id
WHERE p.fetch_status = 'success' AND l.created_at > TIMESTAMP '{DELTA_SINCE}' AND l.target_title IN {_SUCCESS}"""


def _snapshot_root(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/linkweave-snapshots/{uuid.uuid4().hex}"


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/linkweave-{name}/{uuid.uuid4().hex}"


def _snapshot(spark, sf_dir):
    nodes, edges = fx_graph(spark, sf_dir)
    root = _snapshot_root(spark)
    SN.write_graph_snapshot(nodes, edges, root)
    return SN.read_graph_snapshot(spark, root)


@register("a4_write_graph_snapshot", O.cte("fx_edges") + "SELECT src, dst FROM fx_edges")
def a4_write_graph_snapshot(spark, sf_dir):
    """Round trip: the edges read back from a freshly committed snapshot."""
    return _snapshot(spark, sf_dir)[1]


@register(
    "a5_read_graph_snapshot",
    O.cte("fx_nodes")
    + f"""SELECT {SN.FORMAT_VERSION} AS format_version, 1 AS version,
       (SELECT count(*) FROM fx_nodes) AS node_count, (SELECT count(*) FROM fx_edges) AS edge_count""",
)
def a5_read_graph_snapshot(spark, sf_dir):
    return _snapshot(spark, sf_dir)[2].select("format_version", "version", "node_count", "edge_count")


_UPDATED = O.cte("fx_nodes", "fx_updates", extra=M9_CTES)


def _log_versions(spark, sf_dir):
    """A log of three versions: the graph, a delta of the pages updated since, and both folded."""
    nodes, edges = fx_graph(spark, sf_dir)
    root = f"{_snapshot_root(spark)}/log"
    GL.write_full(nodes, edges, root)
    changed, fresh = m9_changes(spark, sf_dir)
    GL.write_delta(changed, nodes.limit(0), fresh, root)
    GL.fold(spark, root)
    return root


@register("a5_read_old_version", O.cte("fx_edges") + "SELECT DISTINCT src, dst FROM fx_edges")
def a5_read_old_version(spark, sf_dir):
    """The first version, read after a delta and a fold were committed on top."""
    return GL.read(spark, _log_versions(spark, sf_dir), 1)[1]


@register("a5_read_merged_version", _UPDATED + "SELECT DISTINCT src, dst FROM new_edges")
def a5_read_merged_version(spark, sf_dir):
    """The second version: the first one merged with a delta and its tombstones on read."""
    return GL.read(spark, _log_versions(spark, sf_dir), 2)[1]


@register("a5_read_folded_nodes", _UPDATED + "SELECT title FROM fx_nodes UNION SELECT src FROM fresh UNION SELECT dst FROM fresh")
def a5_read_folded_nodes(spark, sf_dir):
    """Nodes of the folded version."""
    return GL.read(spark, _log_versions(spark, sf_dir))[0]


@register("a7_export_nodes", O.cte("fx_pages") + "SELECT DISTINCT title FROM fx_pages WHERE fetch_status = 'success'")
def a7_export_nodes(spark, sf_dir):
    return EX.export_nodes(TB.fx_pages(spark, sf_dir))


@register("a8_export_edges", O.cte("fx_edges") + _CLOSED)
def a8_export_edges(spark, sf_dir):
    return EX.export_edges(TB.fx_pages(spark, sf_dir), TB.fx_links(spark, sf_dir))


@register(
    "a9_full_export",
    O.cte("fx_edges")
    + f"""SELECT (SELECT count(*) FROM fx_pages WHERE fetch_status = 'success') AS nodes_submitted,
       (SELECT count(*) FROM fx_edges) AS edges_submitted,
       (SELECT count(DISTINCT title) FROM fx_pages WHERE fetch_status = 'success') AS nodes_landed,
       (SELECT count(*) FROM ({_CLOSED}) c) AS edges_landed""",
)
def a9_full_export(spark, sf_dir):
    res = EX.full_export(TB.fx_pages(spark, sf_dir), TB.fx_links(spark, sf_dir), _scratch(spark, "export"))
    return res.select("nodes_submitted", "edges_submitted", "nodes_landed", "edges_landed")


@register(
    "a9_repeated_export",
    O.cte("fx_edges")
    + f"""SELECT 1 AS run, (SELECT count(DISTINCT title) FROM fx_pages WHERE fetch_status = 'success') AS nodes_landed,
       (SELECT count(*) FROM ({_CLOSED}) c) AS edges_landed UNION ALL SELECT 2, 0, 0""",
)
def a9_repeated_export(spark, sf_dir):
    """Two exports into one sink: the second lands nothing."""
    sink = _scratch(spark, "export")
    runs = [EX.full_export(TB.fx_pages(spark, sf_dir), TB.fx_links(spark, sf_dir), sink) for _ in range(2)]
    first, second = (r.select(F.lit(n).alias("run"), "nodes_landed", "edges_landed") for n, r in enumerate(runs, 1))
    return first.unionByName(second)


@register("g7_export_stats")
def g7_export_stats(spark, sf_dir):
    """Counts, duration and rates of a full export (timing: no SQL form)."""
    return EX.full_export(TB.fx_pages(spark, sf_dir), TB.fx_links(spark, sf_dir))


@register("a10_delta_export_nodes", O.cte("fx_pages") + _DELTA_NODES)
def a10_delta_export_nodes(spark, sf_dir):
    return EX.delta_export(TB.fx_pages(spark, sf_dir), TB.fx_links(spark, sf_dir), DELTA_SINCE)[0]


@register("a10_delta_export_edges", O.cte("fx_pages", "fx_links") + _DELTA_EDGES)
def a10_delta_export_edges(spark, sf_dir):
    return EX.delta_export(TB.fx_pages(spark, sf_dir), TB.fx_links(spark, sf_dir), DELTA_SINCE)[1]


@register(
    "g4_verify_export",
    O.cte(
        "fx_edges",
        extra=[
            ("exp_n", "SELECT DISTINCT title FROM fx_pages WHERE fetch_status = 'success'"),
            ("exp_e", _CLOSED),
            ("got_n", _DELTA_NODES),
            ("got_e", _DELTA_EDGES),
        ],
    )
    + """SELECT * FROM (VALUES
  ('literal_nodes', (SELECT count(*) FROM fx_pages WHERE fetch_status = 'success'), (SELECT count(*) FROM got_n)),
  ('literal_edges', (SELECT count(*) FROM fx_links), (SELECT count(*) FROM got_e)),
  ('strict_edges', (SELECT count(*) FROM exp_e), (SELECT count(*) FROM got_e)),
  ('strict_missing_nodes', 0, (SELECT count(*) FROM (SELECT * FROM exp_n EXCEPT ALL SELECT * FROM got_n) x)),
  ('strict_extra_nodes', 0, (SELECT count(*) FROM (SELECT * FROM got_n EXCEPT ALL SELECT * FROM exp_n) x)),
  ('strict_missing_edges', 0, (SELECT count(*) FROM (SELECT * FROM exp_e EXCEPT ALL SELECT * FROM got_e) x)),
  ('strict_extra_edges', 0, (SELECT count(*) FROM (SELECT * FROM got_e EXCEPT ALL SELECT * FROM exp_e) x))
) t("check", expected, actual)
""".replace("SELECT * FROM (VALUES", "SELECT \"check\", expected, actual, expected = actual AS ok FROM (VALUES"),
)
def g4_verify_export(spark, sf_dir):
    """Verify a delta export (since DELTA_SINCE) against the full expected export."""
    pages, links = TB.fx_pages(spark, sf_dir), TB.fx_links(spark, sf_dir)
    got_nodes, got_edges = EX.delta_export(pages, links, DELTA_SINCE)
    return EX.verify_export(pages, links, got_nodes, got_edges)
