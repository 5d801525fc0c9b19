"""Batch lookups and queues over the page/link tables.

Single-key lookups of the reference become joins against a *table* of keys;
Catalyst/AQE picks a broadcast hash join when the key table is small at run
time and a shuffle join otherwise, so no side is broadcast blindly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.operators.topk import top_k_per_group
from linkweave.sources import schemas as S


def pages_by_title(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """every requested title with its page row (page columns NULL if absent)."""
    req = titles.select("title").distinct()
    return req.join(pages, "title", "left")


def page_exists(titles: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(title, exists)`` per requested title against the graph's nodes."""
    req = titles.select("title").distinct()
    hit = nodes.select("title").distinct().withColumn("_hit", F.lit(True))
    return req.join(hit, "title", "left").select("title", F.coalesce("_hit", F.lit(False)).alias("exists"))


def pending_queue(pages: DataFrame, limit: int) -> DataFrame:
    """oldest pending pages first (``id`` breaks ties); TakeOrderedAndProject."""
    return pages.where(F.col("fetch_status") == S.STATUS_PENDING).orderBy("created_at", "id").limit(limit)


def stale_pages(pages: DataFrame, as_of, ttl_days: int, limit: int) -> DataFrame:
    """success pages fetched before ``as_of - ttl``, oldest first."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(ttl_days))
    return (
        pages.where((F.col("fetch_status") == S.STATUS_SUCCESS) & (F.col("fetched_at") < cutoff))
        .orderBy("fetched_at", "id")
        .limit(limit)
    )


def updated_pages(pages: DataFrame, since) -> DataFrame:
    """pages changed strictly after ``since``."""
    return pages.where(F.col("updated_at") > F.lit(since).cast("timestamp_ntz")).select(
        "id", "title", "fetch_status", "updated_at"
    )


def retry_queue(pages: DataFrame, limit: int) -> DataFrame:
    """F8: pages in ``error`` by ``updated_at`` (then id)."""
    return pages.where(F.col("fetch_status") == S.STATUS_ERROR).orderBy("updated_at", "id").limit(limit)


def out_links(edges: DataFrame, titles: DataFrame, limit: int | None = 100) -> DataFrame:
    """targets per requested title, first ``limit`` by target title."""
    hits = edges.join(titles.select(F.col("title").alias("src")).distinct(), "src").select(
        F.col("src").alias("title"), F.col("dst").alias("link")
    )
    if limit is None:
        return hits
    return top_k_per_group(hits, ["title"], [F.col("link")], limit, salt_cols=["link"])


def in_links(edges: DataFrame, titles: DataFrame, limit: int | None = 100) -> DataFrame:
    """sources per requested title, first ``limit`` by source title."""
    hits = edges.join(titles.select(F.col("title").alias("dst")).distinct(), "dst").select(
        F.col("dst").alias("title"), F.col("src").alias("link")
    )
    if limit is None:
        return hits
    return top_k_per_group(hits, ["title"], [F.col("link")], limit, salt_cols=["link"])


def backlinks_titled(links: DataFrame, pages: DataFrame, titles: DataFrame) -> DataFrame:
    """For each requested target, the titles of pages linking to it (any status)."""
    req = titles.select(F.col("title").alias("target_title")).distinct()
    src = pages.select(F.col("id").alias("source_id"), F.col("title").alias("source_title"))
    return links.join(req, "target_title").join(src, "source_id").select(
        F.col("target_title").alias("title"), "source_title"
    )


def unfetched_targets(links: DataFrame, pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct link targets without a page row (first ``limit`` by title)."""
    t = (
        links.select(F.col("target_title").alias("title"))
        .distinct()
        .join(pages.select("title"), "title", "left_anti")
    )
    return t if limit is None else t.orderBy("title").limit(limit)


def pages_without_embedding(pages: DataFrame, embeddings: DataFrame, key: str = "vec_id") -> DataFrame:
    """Pages that have no vector (page ``id`` = embedding ``key``)."""
    return pages.join(embeddings.select(F.col(key).alias("id")), "id", "left_anti").select("id", "title")


def changed_content(stored: DataFrame, fresh: DataFrame, key: str = "title") -> DataFrame:
    """``changed`` unless a stored hash exists and equals the new one."""
    s = stored.select(key, F.col("content_hash").alias("stored_hash"))
    return fresh.select(key, F.col("content_hash").alias("new_hash")).join(s, key, "left").select(
        key,
        "stored_hash",
        "new_hash",
        (~(F.col("stored_hash").isNotNull() & F.col("stored_hash").eqNullSafe(F.col("new_hash")))).alias(
            "changed"
        ),
    )
