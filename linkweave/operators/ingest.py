"""A3 link extraction and X7 fetch-outcome classification over whole tables.

Two extraction modes, one tokenizer (:mod:`linkweave.functions.markup`), run in
Arrow batches of pages:

* ``unscoped`` -- every ``<a href>`` of the page;
* ``scoped``   -- only anchors inside the element whose id is ``scope_id``
  (default ``mw-content-text``).

Both then apply the same column rules (X1-X5) and de-duplicate per page.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.functions import text as X
from linkweave.functions.markup import anchor_hrefs
from linkweave.sources import schemas as S

SCOPE_ID = "mw-content-text"


def _hrefs(scope_id: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, hrefs = [], []
            for page, text in zip(pdf["page_id"], pdf["html"], strict=True):
                found = list(anchor_hrefs(text, scope_id)) if text else []
                ids += [page] * len(found)
                hrefs += found
                if len(hrefs) > 100_000:
                    yield pd.DataFrame({"page_id": pd.Series(ids, dtype="Int64"), "href": pd.Series(hrefs, dtype="object")})
                    ids, hrefs = [], []
            yield pd.DataFrame({"page_id": pd.Series(ids, dtype="Int64"), "href": pd.Series(hrefs, dtype="object")})

    return run


def extract_links(
    pages: DataFrame,
    prefix: str = X.ARTICLE_PREFIX,
    scoped: bool = False,
    scope_id: str = SCOPE_ID,
    distinct: bool = True,
) -> DataFrame:
    """A3: ``pages(page_id, html)`` -> distinct ``(page_id, target_title)``.

    ``distinct=False`` keeps one row per anchor (for duplicate reports).
    """
    src = pages.select("page_id", "html")
    hrefs = src.mapInPandas(_hrefs(scope_id if scoped else None), "page_id long, href string")
    titles = hrefs.select("page_id", X.href_to_title("href", prefix).alias("target_title"))
    kept = titles.where(F.col("target_title").isNotNull() & X.is_article_title("target_title"))
    return kept.dropDuplicates(["page_id", "target_title"]) if distinct else kept


def classify_fetches(results: DataFrame, pages: DataFrame, prefix: str = X.ARTICLE_PREFIX,
                     base: str = X.SITE_BASE) -> DataFrame:
    """Fetch results ``(title, status_code, final_url, html, error)`` -> outcome rows.

    Ordered rules: error -> ``error``; 404 -> ``not_found`` (skipped); redirect
    -> ``redirect`` with its target queued (skipped); unchanged hash ->
    ``success`` (skipped); otherwise ``success`` with links replaced (fetched).
    """
    stored = pages.select("title", F.col("content_hash").alias("stored_hash"))
    r = results.join(stored, "title", "left")
    redirect = X.redirect_target(X.title_to_url("title", base, prefix), F.col("final_url"), prefix)
    new_hash = X.content_hash("html")
    unchanged = F.col("stored_hash").isNotNull() & (F.col("stored_hash") == new_hash)
    outcome = (
        F.when(F.col("error").isNotNull(), F.lit(S.STATUS_ERROR))
        .when(F.col("status_code") == 404, F.lit(S.STATUS_NOT_FOUND))
        .when(F.coalesce(redirect, F.lit("")) != "", F.lit(S.STATUS_REDIRECT))
        .otherwise(F.lit(S.STATUS_SUCCESS))
    )
    is_err = F.col("error").isNotNull()
    is_404 = ~is_err & (F.col("status_code") == 404)
    is_redir = ~is_err & ~is_404 & (F.coalesce(redirect, F.lit("")) != "")
    return r.select(
        "title",
        outcome.alias("outcome"),
        F.when(is_redir, redirect).alias("redirect_to"),
        F.when(~is_err & ~is_404 & ~is_redir, new_hash).alias("content_hash"),
        (~is_err & ~is_404 & ~is_redir & ~F.coalesce(unchanged, F.lit(False))).alias("fetched"),
        (is_404 | is_redir | (~is_err & ~is_404 & ~is_redir & F.coalesce(unchanged, F.lit(False)))).alias("skipped"),
        "html",
    )
