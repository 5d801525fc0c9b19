"""Table maintenance as (old tables, change table) -> new table.

Plain Parquet has no MERGE, so every change produces the next version of a
table; :mod:`linkweave.sources.snapshot` commits versions atomically.  All
operators are anti/semi joins and unions keyed by ``title`` or ``source_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.operators.ranking import dense_rank_table
from linkweave.sources import schemas as S


def dense_ids(df: DataFrame, order: list[str], base: Column, name: str = "id") -> DataFrame:
    """Consecutive ids ``base + 1, base + 2, ...`` in ``order`` without a one-task window.

    The ranks come from :func:`linkweave.operators.ranking.dense_rank_table`,
    which fixes the sorted rows once before it counts them.
    """
    ranked = dense_rank_table(df, order, name="_rank")
    return ranked.select(*df.columns, (base + F.col("_rank") + 1).cast("long").alias(name))


def _max_id(pages: DataFrame) -> Column:
    return F.coalesce(F.col("_max_id"), F.lit(0))


def ensure_pages(pages: DataFrame, titles: DataFrame, now) -> DataFrame:
    """M1: add absent titles as ``pending`` pages; existing rows are untouched.

    New ids continue after the current maximum, in title order.
    """
    new = titles.select("title").where(F.col("title").isNotNull()).distinct().join(
        pages.select("title"), "title", "left_anti"
    )
    top = pages.agg(F.max("id").alias("_max_id"))
    numbered = dense_ids(new.crossJoin(F.broadcast(top)), ["title"], _max_id(pages))  # top: 1 row
    ts = F.lit(now).cast("timestamp_ntz")
    rows = numbered.select(
        "id",
        "title",
        F.lit(None).cast("string").alias("content_hash"),
        F.lit(S.STATUS_PENDING).alias("fetch_status"),
        F.lit(None).cast("string").alias("redirect_to"),
        F.lit(None).cast("timestamp_ntz").alias("fetched_at"),
        ts.alias("created_at"),
        ts.alias("updated_at"),
    )
    return pages.unionByName(rows)


def add_links(links: DataFrame, new_links: DataFrame, now) -> DataFrame:
    """M2: INSERT OR IGNORE -- duplicates and targets over 512 characters are dropped."""
    cand = (
        new_links.select("source_id", "target_title")
        .where(F.col("target_title").isNotNull() & (F.length("target_title") <= S.MAX_TARGET_LEN))
        .dropDuplicates(["source_id", "target_title"])
        .join(links.select("source_id", "target_title"), ["source_id", "target_title"], "left_anti")
        .withColumn("created_at", F.lit(now).cast("timestamp_ntz"))
    )
    return links.unionByName(cand)


def delete_links(links: DataFrame, sources: DataFrame) -> DataFrame:
    """M4: drop every link of the given source ids."""
    return links.join(sources.select(F.col("source_id")).distinct(), "source_id", "left_anti")


def replace_links(links: DataFrame, new_links: DataFrame, sources: DataFrame, now) -> DataFrame:
    """M3: per source, delete all links then insert the new list (empty list = delete)."""
    remaining = delete_links(links, sources)
    incoming = new_links.join(sources.select("source_id").distinct(), "source_id", "left_semi")
    return add_links(remaining, incoming, now)


def latest_per_title(updates: DataFrame, order: list[str]) -> DataFrame:
    """One update per title: the last by ``order`` (``max_by`` on a struct, no window)."""
    cols = [c for c in updates.columns if c != "title"]
    key = F.struct(*[F.col(c) for c in order])
    return updates.groupBy("title").agg(F.max_by(F.struct(*cols), key).alias("_u")).select("title", "_u.*")


def update_status(pages: DataFrame, updates: DataFrame, order: list[str] | None = None) -> DataFrame:
    """M5: apply ``(title, fetch_status, content_hash, redirect_to, updated_at)``.

    Sets status, hash and redirect (``''`` -> NULL) and stamps ``fetched_at``
    and ``updated_at`` with the update time, for every status.  Titles without
    a page are ignored; several updates of one title keep the last by ``order``.
    """
    order = order or ["updated_at"]
    u = latest_per_title(updates, order).select(
        "title",
        F.col("fetch_status").alias("_st"),
        F.nullif(F.col("content_hash"), F.lit("")).alias("_hash"),
        F.nullif(F.col("redirect_to"), F.lit("")).alias("_redir"),
        F.col("updated_at").alias("_ts"),
        F.lit(True).alias("_hit"),
    )
    j = pages.join(u, "title", "left")
    hit = F.col("_hit").isNotNull()
    return j.select(
        "id",
        "title",
        F.when(hit, F.col("_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(hit, F.col("_st")).otherwise(F.col("fetch_status")).alias("fetch_status"),
        F.when(hit, F.col("_redir")).otherwise(F.col("redirect_to")).alias("redirect_to"),
        F.when(hit, F.col("_ts")).otherwise(F.col("fetched_at")).alias("fetched_at"),
        "created_at",
        F.when(hit, F.col("_ts")).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def delete_pages(
    pages: DataFrame, links: DataFrame, titles: DataFrame, detach: bool = False
) -> tuple[DataFrame, DataFrame]:
    """M6: delete pages and cascade their out-links; ``detach`` also drops links *to* them."""
    gone = pages.join(titles.select("title").distinct(), "title", "left_semi")
    new_pages = pages.join(gone.select("title"), "title", "left_anti")
    new_links = links.join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti")
    if detach:
        new_links = new_links.join(gone.select(F.col("title").alias("target_title")), "target_title", "left_anti")
    return new_pages, new_links


def upsert_pages(pages: DataFrame, updates: DataFrame, now, order: list[str] | None = None) -> DataFrame:
    """Insert unknown titles (M1) then apply the updates (M5)."""
    return update_status(ensure_pages(pages, updates.select("title"), now), updates, order)


def purge_pages(
    pages: DataFrame, links: DataFrame, older_than=None, titles: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete pages fetched before ``older_than`` and/or listed in ``titles``.

    Returns (new pages, new links, one-row report of removed pages and links).
    """
    cond = F.lit(False)
    if older_than is not None:
        cond = cond | (F.col("fetched_at") < F.lit(older_than).cast("timestamp_ntz"))
    doomed = pages.where(cond).select("title")
    if titles is not None:
        doomed = doomed.unionByName(titles.select("title")).distinct()
    new_pages, new_links = delete_pages(pages, links, doomed)
    removed_pages = pages.join(doomed, "title", "left_semi").agg(F.count(F.lit(1)).alias("removed_pages"))
    gone_ids = pages.join(doomed, "title", "left_semi").select(F.col("id").alias("source_id"))
    removed_links = links.join(gone_ids, "source_id", "left_semi").agg(F.count(F.lit(1)).alias("removed_links"))
    return new_pages, new_links, removed_pages.crossJoin(removed_links)  # 1 x 1 rows
