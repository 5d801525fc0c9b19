"""Projection of the page/link tables to a directed graph and whole-graph transforms.

Graph = ``edges(src, dst)`` + ``nodes(title)``; never an adjacency object on
one machine.  Status filtering is on the *source* page only: a link to a
pending or missing page still yields a node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.sources import schemas as S


def success_pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("fetch_status") == S.STATUS_SUCCESS)


def graph_edges(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Links of success pages as (src title, dst title)."""
    src = success_pages(pages).select(F.col("id").alias("source_id"), F.col("title").alias("src"))
    return links.join(src, "source_id").select("src", F.col("target_title").alias("dst"))


def isolated_pages(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Success pages without any link row."""
    return (
        success_pages(pages)
        .join(links.select(F.col("source_id").alias("id")), "id", "left_anti")
        .select("title")
    )


def graph_nodes(edges: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    """Edge sources, edge targets and isolated pages, distinct."""
    parts = edges.select(F.col("src").alias("title")).unionByName(
        edges.select(F.col("dst").alias("title"))
    )
    if isolated is not None:
        parts = parts.unionByName(isolated.select("title"))
    return parts.distinct()


def project(pages: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J1 + J3: (nodes, edges) of the page graph."""
    edges = graph_edges(pages, links)
    return graph_nodes(edges, isolated_pages(pages, links)), edges


def closed_edges(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Keep edges whose two ends are success pages (export semantics)."""
    ok = success_pages(pages).select("title")
    return edges.join(
        ok.withColumnRenamed("title", "src"), "src", "left_semi"
    ).join(ok.withColumnRenamed("title", "dst"), "dst", "left_semi").select("src", "dst")


def page_with_links(titles: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per requested title that is a node: sorted out/in titles and counts."""
    req = titles.select("title").distinct().join(nodes, "title", "left_semi")
    out = (
        edges.join(req.withColumnRenamed("title", "src"), "src", "left_semi")
        .groupBy(F.col("src").alias("title"))
        .agg(F.sort_array(F.collect_list("dst")).alias("out_links"))
    )
    inn = (
        edges.join(req.withColumnRenamed("title", "dst"), "dst", "left_semi")
        .groupBy(F.col("dst").alias("title"))
        .agg(F.sort_array(F.collect_list("src")).alias("in_links"))
    )
    empty = F.array().cast("array<string>")
    return (
        req.join(out, "title", "left")
        .join(inn, "title", "left")
        .select(
            "title",
            F.coalesce("out_links", empty).alias("out_links"),
            F.coalesce(F.size("out_links"), F.lit(0)).cast("long").alias("out_count"),
            F.coalesce("in_links", empty).alias("in_links"),
            F.coalesce(F.size("in_links"), F.lit(0)).cast("long").alias("in_count"),
        )
    )


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Out- and in-degree of every node, zeros kept (partial aggregation before shuffle)."""
    out = edges.groupBy(F.col("src").alias("title")).agg(F.count(F.lit(1)).alias("out_degree"))
    inn = edges.groupBy(F.col("dst").alias("title")).agg(F.count(F.lit(1)).alias("in_degree"))
    return (
        nodes.join(out, "title", "left")
        .join(inn, "title", "left")
        .select(
            "title",
            F.coalesce("out_degree", F.lit(0)).alias("out_degree"),
            F.coalesce("in_degree", F.lit(0)).alias("in_degree"),
        )
    )


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row with node and edge counts."""
    n = nodes.agg(F.count(F.lit(1)).alias("node_count"))
    e = edges.agg(F.count(F.lit(1)).alias("edge_count"))
    return n.crossJoin(e)  # 1 x 1 rows


def add_edges(edges: DataFrame, new_edges: DataFrame, trusted: bool = False) -> DataFrame:
    """M7: idempotent edge insert (``trusted`` input skips the duplicate check)."""
    merged = edges.select("src", "dst").unionByName(new_edges.select("src", "dst"))
    return merged if trusted else merged.distinct()


def remove_out_edges(edges: DataFrame, titles: DataFrame) -> DataFrame:
    """M8: drop the out-edges of the given titles; nodes stay."""
    return edges.join(titles.select(F.col("title").alias("src")), "src", "left_anti")


def refresh_graph(
    nodes: DataFrame,
    edges: DataFrame,
    pages: DataFrame,
    links: DataFrame,
    since,
) -> tuple[DataFrame, DataFrame]:
    """M9: apply page changes newer than ``since`` to a projected graph.

    Pages with ``updated_at > since`` (all given pages when ``since`` is None)
    lose their out-edges; those now in ``success`` get their current links
    back.  Nodes are never removed.
    """
    changed = pages if since is None else pages.where(F.col("updated_at") > F.lit(since))
    kept = edges.join(changed.select(F.col("title").alias("src")), "src", "left_anti")
    fresh = graph_edges(changed, links)
    new_edges = kept.unionByName(fresh)
    new_nodes = graph_nodes(fresh).unionByName(nodes.select("title")).distinct()
    return new_nodes, new_edges
