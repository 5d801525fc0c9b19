"""Offline crawl-frontier expansion over an already-fetched corpus.

Network fetching is replaced by a corpus table of fetch outcomes
``(title, outcome, redirect_to, content_hash, links)``.  Each round takes the
pending pages (all of them, or the ``batch_size`` oldest), looks their outcome
up in the corpus (absent -> ``not_found``), records the outcome, and inserts the
links of success pages and the targets of redirects as new pending pages.  The
page state is checkpointed every round; only the pending count reaches the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.operators.traverse import _ckpt, union_all
from linkweave.sources import schemas as S


def crawl(
    corpus: DataFrame,
    seeds: DataFrame,
    max_rounds: int,
    batch_size: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Run up to ``max_rounds`` rounds from ``seeds(title)``.

    Returns (page state ``(title, fetch_status, depth, seq)``, outcome log
    ``(title, round, outcome, fetched, skipped, n_links)``).  ``depth`` is the
    round in which the page was discovered; ``seq`` orders pages FIFO.
    """
    state = _ckpt(
        seeds.select("title")
        .distinct()
        .select("title", F.lit(S.STATUS_PENDING).alias("fetch_status"), F.lit(0).alias("depth"),
                F.lit(0).cast("long").alias("seq"))
    )
    logs: list[DataFrame] = []
    corpus = corpus.select("title", "outcome", "redirect_to", "links")
    for rnd in range(1, max_rounds + 1):
        pending = state.where(F.col("fetch_status") == S.STATUS_PENDING)
        if batch_size is not None:
            pending = pending.orderBy("seq", "title").limit(batch_size)
        batch = _ckpt(
            pending.select("title").join(corpus, "title", "left").select(
                "title",
                F.coalesce("outcome", F.lit(S.STATUS_NOT_FOUND)).alias("outcome"),
                "redirect_to",
                "links",
            )
        )
        if batch.count() == 0:
            break
        logs.append(
            batch.select(
                "title",
                F.lit(rnd).alias("round"),
                "outcome",
                (F.col("outcome") == S.STATUS_SUCCESS).alias("fetched"),
                F.col("outcome").isin(S.STATUS_NOT_FOUND, S.STATUS_REDIRECT).alias("skipped"),
                F.when(F.col("outcome") == S.STATUS_SUCCESS, F.coalesce(F.size("links"), F.lit(0)))
                .otherwise(F.lit(0))
                .alias("n_links"),
            )
        )
        targets = (
            batch.where(F.col("outcome") == S.STATUS_SUCCESS)
            .select(F.explode("links").alias("title"))
            .unionByName(
                batch.where((F.col("outcome") == S.STATUS_REDIRECT) & F.col("redirect_to").isNotNull())
                .select(F.col("redirect_to").alias("title"))
            )
            .distinct()
        )
        new_pages = targets.join(state.select("title"), "title", "left_anti").select(
            "title", F.lit(S.STATUS_PENDING).alias("fetch_status"), F.lit(rnd).alias("depth"),
            F.lit(rnd).cast("long").alias("seq"),
        )
        updated = state.join(batch.select("title", "outcome"), "title", "left").select(
            "title", F.coalesce("outcome", "fetch_status").alias("fetch_status"), "depth", "seq"
        )
        state = _ckpt(updated.unionByName(new_pages))
    log = union_all(logs) if logs else state.sparkSession.createDataFrame(
        [], "title string, round int, outcome string, fetched boolean, skipped boolean, n_links int"
    )
    return state, log


def corpus_from_pages(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Replay corpus: one row per non-pending page with its outcome and sorted links."""
    per_src = links.groupBy("source_id").agg(F.sort_array(F.collect_list("target_title")).alias("_l"))
    return (
        pages.where(F.col("fetch_status") != S.STATUS_PENDING)
        .join(per_src, F.col("id") == F.col("source_id"), "left")
        .select(
            "title",
            F.col("fetch_status").alias("outcome"),
            "redirect_to",
            "content_hash",
            F.when(F.col("fetch_status") == S.STATUS_SUCCESS, F.coalesce("_l", F.array().cast("array<string>")))
            .alias("links"),
        )
    )


def nation_seeds(pages: DataFrame, customer: DataFrame) -> DataFrame:
    """Seeds: the smallest success title of every nation."""
    return (
        pages.where(F.col("fetch_status") == S.STATUS_SUCCESS)
        .join(customer.select(F.col("c_custkey").alias("id"), "c_nationkey"), "id")
        .groupBy("c_nationkey")
        .agg(F.min("title").alias("title"))
        .select("title")
    )
