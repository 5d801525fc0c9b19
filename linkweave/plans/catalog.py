"""Named queries over a data directory: ``name -> (spark, sf_dir) -> DataFrame``.

Each entry binds operator inputs to the driver tables (via
:mod:`linkweave.sources.tables`) and calls one operator.  ``ORACLES`` holds the
DuckDB SQL of the same query; keys match one to one except where a query has
no SQL form (noted in ``NO_ORACLE``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.operators import graph as G
from linkweave.operators import traverse as TR
from linkweave.plans import oracle as O
from linkweave.sources import schemas as S
from linkweave.sources import tables as TB

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Fixed parameters of the registered queries.
PATH_DEPTH = 6
NEIGHBOURHOOD_DEPTH = 2
NEIGHBOURHOOD_MAX_NODES = 1000
NEIGHBOURHOOD_SMALL_CAP = 25
CONNECTIONS_LIMIT = 100
AS_OF = "1993-01-01 00:00:00"


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def fx_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the page-link fixture (J1 + J3)."""
    return G.project(TB.fx_pages(spark, sf_dir), TB.fx_links(spark, sf_dir))


# ---------------------------------------------------------------- sources
@register("a1_scan_pages", O.cte("fx_pages") + "SELECT * FROM fx_pages")
def a1_scan_pages(spark, sf_dir):
    return TB.fx_pages(spark, sf_dir)


@register("a2_scan_links", O.cte("fx_links") + "SELECT * FROM fx_links")
def a2_scan_links(spark, sf_dir):
    return TB.fx_links(spark, sf_dir)


# ---------------------------------------------------------------- graph projection
@register("j1_graph_edges", O.cte("fx_edges") + "SELECT * FROM fx_edges")
def j1_graph_edges(spark, sf_dir):
    return G.graph_edges(TB.fx_pages(spark, sf_dir), TB.fx_links(spark, sf_dir))


@register(
    "j2_isolated_pages",
    O.cte("fx_pages", "fx_links")
    + """SELECT p.title FROM (SELECT id, title, fetch_status FROM fx_pages
  UNION ALL SELECT -s_suppkey, s_name, 'success' FROM supplier) p
WHERE p.fetch_status = 'success' AND NOT EXISTS (SELECT 1 FROM fx_links l WHERE l.source_id = p.id)""",
)
def j2_isolated_pages(spark, sf_dir):
    """Isolated pages among all pages and the suppliers, added as pages that link to nothing."""
    pages = TB.fx_pages(spark, sf_dir).select("id", "title", "fetch_status")
    lone = TB.read(spark, sf_dir, "supplier").select(
        (-F.col("s_suppkey")).cast("long").alias("id"), F.col("s_name").alias("title"), F.lit(S.STATUS_SUCCESS).alias("fetch_status")
    )
    return G.isolated_pages(pages.unionByName(lone), TB.fx_links(spark, sf_dir))


@register("j3_graph_nodes", O.cte("fx_nodes") + "SELECT * FROM fx_nodes")
def j3_graph_nodes(spark, sf_dir):
    return fx_graph(spark, sf_dir)[0]


@register(
    "j4_closed_edges",
    O.cte("fx_edges")
    + """SELECT e.src, e.dst FROM fx_edges e
  WHERE e.src IN (SELECT title FROM fx_pages WHERE fetch_status = 'success')
    AND e.dst IN (SELECT title FROM fx_pages WHERE fetch_status = 'success')""",
)
def j4_closed_edges(spark, sf_dir):
    pages = TB.fx_pages(spark, sf_dir)
    return G.closed_edges(G.graph_edges(pages, TB.fx_links(spark, sf_dir)), pages)


@register(
    "j5_page_with_links",
    O.cte("fx_nodes")
    + """SELECT r.title,
       coalesce((SELECT list_sort(list(dst)) FROM fx_edges e WHERE e.src = r.title), []) AS out_links,
       (SELECT count(*) FROM fx_edges e WHERE e.src = r.title) AS out_count,
       coalesce((SELECT list_sort(list(src)) FROM fx_edges e WHERE e.dst = r.title), []) AS in_links,
       (SELECT count(*) FROM fx_edges e WHERE e.dst = r.title) AS in_count
FROM (SELECT DISTINCT title FROM fx_pages) r WHERE r.title IN (SELECT title FROM fx_nodes)""",
)
def j5_page_with_links(spark, sf_dir):
    nodes, edges = fx_graph(spark, sf_dir)
    return G.page_with_links(TB.fx_pages(spark, sf_dir).select("title"), edges, nodes)


@register(
    "g2_graph_counts",
    O.cte("fx_nodes")
    + "SELECT (SELECT count(*) FROM fx_nodes) AS node_count, (SELECT count(*) FROM fx_edges) AS edge_count",
)
def g2_graph_counts(spark, sf_dir):
    nodes, edges = fx_graph(spark, sf_dir)
    return G.graph_counts(nodes, edges)


@register(
    "g3_degrees",
    O.cte("fx_nodes")
    + """SELECT n.title,
       (SELECT count(*) FROM fx_edges e WHERE e.src = n.title) AS out_degree,
       (SELECT count(*) FROM fx_edges e WHERE e.dst = n.title) AS in_degree
FROM fx_nodes n""",
)
def g3_degrees(spark, sf_dir):
    nodes, edges = fx_graph(spark, sf_dir)
    return G.degrees(edges, nodes)


# ---------------------------------------------------------------- traversals
def _path_queries(spark, sf_dir, depth):
    return TB.fx_path_queries(spark, sf_dir, depth)


@register(
    "p1_shortest_path",
    O.bfs_paths_sql(
        "fx_edges",
        "(SELECT query_id, \"from\", \"to\", -1 AS max_depth FROM fx_path_queries)",
        ("fx_edges", "fx_path_queries"),
    ),
)
def p1_shortest_path(spark, sf_dir):
    nodes, edges = fx_graph(spark, sf_dir)
    return TR.shortest_paths(edges, _path_queries(spark, sf_dir, -1), nodes=nodes)


@register(
    "p2_shortest_path_limited",
    O.bfs_paths_sql("fx_edges", "fx_path_queries", ("fx_edges", "fx_path_queries"), levels=PATH_DEPTH),
)
def p2_shortest_path_limited(spark, sf_dir):
    nodes, edges = fx_graph(spark, sf_dir)
    return TR.shortest_paths(edges, _path_queries(spark, sf_dir, PATH_DEPTH), nodes=nodes)


@register(
    "p3_shortest_path_bidirectional",
    O.bidi_sql("fx_edges", "fx_path_queries", ("fx_edges", "fx_path_queries"), PATH_DEPTH),
)
def p3_shortest_path_bidirectional(spark, sf_dir):
    nodes, edges = fx_graph(spark, sf_dir)
    return TR.shortest_paths_bidirectional(edges, _path_queries(spark, sf_dir, PATH_DEPTH), nodes=nodes)


_P5_SQL = O.bfs_paths_sql("fx_undirected", "fx_path_queries", ("fx_undirected", "fx_path_queries"), levels=PATH_DEPTH)
_P5_SQL = (
    "SELECT query_id, \"from\", \"to\", found AND \"from\" <> \"to\" AS found,\n"
    "       CASE WHEN \"from\" <> \"to\" THEN path END AS path,\n"
    "       CASE WHEN \"from\" <> \"to\" THEN hops END AS hops\n"
    f"FROM ({_P5_SQL}) r"
)


@register("p5_shortest_path_undirected", _P5_SQL)
def p5_shortest_path_undirected(spark, sf_dir):
    edges = fx_graph(spark, sf_dir)[1]
    return TR.shortest_paths_undirected(edges, _path_queries(spark, sf_dir, PATH_DEPTH))


def _nbhd_sql(cap: int, part: str, edges: str = "fx_edges") -> str:
    pre = O.cte(
        "fx_nodes",
        "fx_centres",
        *([edges] if edges != "fx_edges" else []),
        extra=[
            ("seeds", "SELECT query_id, title FROM fx_centres WHERE title IN (SELECT title FROM fx_nodes)"),
        ],
    )
    pre = pre.rstrip("\n") + ",\n" + O.reach_sql(edges, "seeds", NEIGHBOURHOOD_DEPTH) + "\n"
    pre += f""", kept AS (SELECT query_id, title, CAST(hops AS INTEGER) AS hops FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hops, title) AS rn FROM reach) z
  WHERE rn <= {cap})
, sub_edges AS (SELECT k.query_id, e.src AS source, e.dst AS target
  FROM kept k JOIN {edges} e ON e.src = k.title
  WHERE k.hops < {NEIGHBOURHOOD_DEPTH}
    AND EXISTS (SELECT 1 FROM kept k2 WHERE k2.query_id = k.query_id AND k2.title = e.dst))
"""
    if part == "nodes":
        return pre + "SELECT * FROM kept"
    if part == "edges":
        return pre + "SELECT * FROM sub_edges"
    return pre + """SELECT n.query_id, n.node_count, coalesce(e.edge_count, 0) AS edge_count
FROM (SELECT query_id, count(*) AS node_count FROM kept GROUP BY query_id) n
LEFT JOIN (SELECT query_id, count(*) AS edge_count FROM sub_edges GROUP BY query_id) e USING (query_id)"""


def _nbhd(spark, sf_dir, cap):
    nodes, edges = fx_graph(spark, sf_dir)
    return TR.neighborhood(edges, TB.fx_centres(spark, sf_dir), NEIGHBOURHOOD_DEPTH, cap, nodes=nodes)


@register("n1_neighborhood_nodes", _nbhd_sql(NEIGHBOURHOOD_MAX_NODES, "nodes"))
def n1_neighborhood_nodes(spark, sf_dir):
    return _nbhd(spark, sf_dir, NEIGHBOURHOOD_MAX_NODES)[0]


@register("n1_neighborhood_edges", _nbhd_sql(NEIGHBOURHOOD_MAX_NODES, "edges"))
def n1_neighborhood_edges(spark, sf_dir):
    return _nbhd(spark, sf_dir, NEIGHBOURHOOD_MAX_NODES)[1]


@register("n1_neighborhood_capped_nodes", _nbhd_sql(NEIGHBOURHOOD_SMALL_CAP, "nodes"))
def n1_neighborhood_capped_nodes(spark, sf_dir):
    return _nbhd(spark, sf_dir, NEIGHBOURHOOD_SMALL_CAP)[0]


@register("n1_neighborhood_capped_edges", _nbhd_sql(NEIGHBOURHOOD_SMALL_CAP, "edges"))
def n1_neighborhood_capped_edges(spark, sf_dir):
    return _nbhd(spark, sf_dir, NEIGHBOURHOOD_SMALL_CAP)[1]


@register("g8_subgraph_counts", _nbhd_sql(NEIGHBOURHOOD_SMALL_CAP, "counts"))
def g8_subgraph_counts(spark, sf_dir):
    sub_nodes, sub_edges = _nbhd(spark, sf_dir, NEIGHBOURHOOD_SMALL_CAP)
    return TR.subgraph_counts(sub_nodes, sub_edges)


_N2_SQL = O.cte("fx_undirected", "fx_centres").rstrip("\n") + ",\n" + O.reach_sql(
    "fx_undirected", "fx_centres", NEIGHBOURHOOD_DEPTH
) + f"""
SELECT query_id, title FROM (
  SELECT query_id, title, row_number() OVER (PARTITION BY query_id ORDER BY title) AS rn
  FROM reach WHERE hops > 0) z
WHERE rn <= {CONNECTIONS_LIMIT}"""


@register("n2_connections_undirected", _N2_SQL)
def n2_connections_undirected(spark, sf_dir):
    edges = fx_graph(spark, sf_dir)[1]
    return TR.connections_undirected(
        edges, TB.fx_centres(spark, sf_dir), NEIGHBOURHOOD_DEPTH, CONNECTIONS_LIMIT
    )


# Per-area registrations (imported last: they use ``register`` and ``fx_graph``).
from linkweave.plans import q_export, q_graph, q_ingest, q_shapes, q_similar, q_state, q_stream  # noqa: E402,F401
