"""Aggregates over page state and crawl outcomes.

Each is one scan with conditional aggregates; Spark runs them as a partial
(map-side) aggregate followed by a tiny final one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.sources import schemas as S


def page_stats(pages: DataFrame, links: DataFrame) -> DataFrame:
    """G1: page counts by status, fetched_at range (NULLs ignored) and link count."""
    st = F.col("fetch_status")
    p = pages.agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.count_if(st == S.STATUS_SUCCESS).alias("success_pages"),
        F.count_if(st == S.STATUS_PENDING).alias("pending_pages"),
        F.count_if(st == S.STATUS_REDIRECT).alias("redirect_pages"),
        F.count_if(st == S.STATUS_ERROR).alias("error_pages"),
        F.count_if(st == S.STATUS_NOT_FOUND).alias("not_found_pages"),
        F.min("fetched_at").alias("oldest_fetch"),
        F.max("fetched_at").alias("newest_fetch"),
    )
    n = links.agg(F.count(F.lit(1)).alias("total_links"))
    return p.crossJoin(n)  # 1 x 1 rows


def crawl_stats(outcomes: DataFrame) -> DataFrame:
    """Pages fetched / skipped, links found (of fetched pages), errors."""
    n_links = F.coalesce(F.size("links"), F.lit(0)) if "links" in outcomes.columns else F.col("n_links")
    return outcomes.agg(
        F.count_if(F.col("fetched")).alias("pages_fetched"),
        F.count_if(F.col("skipped")).alias("pages_skipped"),
        F.coalesce(F.sum(F.when(F.col("fetched"), n_links)), F.lit(0)).cast("long").alias("links_found"),
        F.count_if(F.col("outcome") == S.STATUS_ERROR).alias("errors"),
    )


def distinct_targets(links: DataFrame, col: str = "target_title") -> DataFrame:
    """The set of all link targets."""
    return links.select(F.col(col).alias("title")).distinct()
