"""Registered queries: lookups, queues, validation, stats and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkweave.operators import graph as G
from linkweave.operators import ingest as IN
from linkweave.operators import lookup as L
from linkweave.operators import maintain as M
from linkweave.operators import stats as ST
from linkweave.operators import validate as V
from linkweave.plans import oracle as O
from linkweave.plans.catalog import fx_graph, register
from linkweave.plans.q_ingest import A3_CTE, HTML_PREFIX, html_links
from linkweave.sources import schemas as S
from linkweave.sources import tables as TB

# Fixed parameters of the registered queries.
NOW = "2024-02-01 00:00:00"
SINCE = "2024-01-15 00:00:00"
QUEUE_LIMIT = 50
STALE_AS_OF = "1998-08-02 00:00:00"
STALE_TTL_DAYS = 365
LINKS_LIMIT = 100
PURGE_BEFORE = "1995-01-01 00:00:00"

_PAGE_COLS = "id, title, content_hash, fetch_status, redirect_to, fetched_at, created_at, updated_at"

# Page state after every event (M5), latest per title by (updated_at, event_id).
PAGES_UPDATED_CTE = (
    "pages_updated",
    """
  WITH u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title
                 ORDER BY updated_at DESC, event_id DESC) AS rn FROM fx_updates) z WHERE rn = 1)
  SELECT p.id, p.title,
         CASE WHEN u.title IS NULL THEN p.content_hash ELSE nullif(u.content_hash, '') END AS content_hash,
         CASE WHEN u.title IS NULL THEN p.fetch_status ELSE u.fetch_status END AS fetch_status,
         CASE WHEN u.title IS NULL THEN p.redirect_to ELSE nullif(u.redirect_to, '') END AS redirect_to,
         CASE WHEN u.title IS NULL THEN p.fetched_at ELSE u.updated_at END AS fetched_at,
         p.created_at,
         CASE WHEN u.title IS NULL THEN p.updated_at ELSE u.updated_at END AS updated_at
  FROM fx_pages p LEFT JOIN u ON u.title = p.title""",
)

REQ_TITLES_CTE = (
    "req_titles",
    "SELECT target_title AS title FROM fx_links UNION SELECT target_title FROM html_links",
)


def pages_updated(spark, sf_dir):
    return M.update_status(
        TB.fx_pages(spark, sf_dir), TB.fx_page_updates(spark, sf_dir), ["updated_at", "event_id"]
    )


def requested_titles(spark, sf_dir):
    return (
        TB.fx_links(spark, sf_dir)
        .select(F.col("target_title").alias("title"))
        .unionByName(html_links(spark, sf_dir).select(F.col("target_title").alias("title")))
        .distinct()
    )


def html_as_links(spark, sf_dir):
    return html_links(spark, sf_dir).select(F.col("page_id").alias("source_id"), "target_title")


# ---------------------------------------------------------------- lookups
@register(
    "f1_pages_by_title",
    O.cte("fx_pages", "fx_links", extra=[A3_CTE, REQ_TITLES_CTE])
    + "SELECT r.title, p.* EXCLUDE (title) FROM req_titles r LEFT JOIN fx_pages p USING (title)",
)
def f1_pages_by_title(spark, sf_dir):
    return L.pages_by_title(TB.fx_pages(spark, sf_dir), requested_titles(spark, sf_dir))


@register(
    "f2_page_exists",
    O.cte("fx_nodes", extra=[A3_CTE, REQ_TITLES_CTE])
    + "SELECT r.title, r.title IN (SELECT title FROM fx_nodes) AS \"exists\" FROM req_titles r",
)
def f2_page_exists(spark, sf_dir):
    nodes = fx_graph(spark, sf_dir)[0]
    return L.page_exists(requested_titles(spark, sf_dir), nodes)


@register(
    "f3_pending_queue",
    O.cte("fx_pages")
    + f"""SELECT * FROM fx_pages WHERE fetch_status = 'pending'
ORDER BY created_at NULLS FIRST, id LIMIT {QUEUE_LIMIT}""",
)
def f3_pending_queue(spark, sf_dir):
    return L.pending_queue(TB.fx_pages(spark, sf_dir), QUEUE_LIMIT)


@register(
    "f4_stale_pages",
    O.cte("fx_pages")
    + f"""SELECT * FROM fx_pages WHERE fetch_status = 'success'
  AND fetched_at < TIMESTAMP '{STALE_AS_OF}' - INTERVAL {STALE_TTL_DAYS} DAY
ORDER BY fetched_at, id LIMIT {QUEUE_LIMIT}""",
)
def f4_stale_pages(spark, sf_dir):
    return L.stale_pages(TB.fx_pages(spark, sf_dir), STALE_AS_OF, STALE_TTL_DAYS, QUEUE_LIMIT)


@register(
    "f5_updated_pages",
    O.cte("fx_pages", "fx_updates", extra=[PAGES_UPDATED_CTE])
    + f"""SELECT id, title, fetch_status, updated_at FROM pages_updated
WHERE updated_at > TIMESTAMP '{SINCE}'""",
)
def f5_updated_pages(spark, sf_dir):
    return L.updated_pages(pages_updated(spark, sf_dir), SINCE)


_TOPK_SQL = """SELECT title, link FROM (
  SELECT {key} AS title, {other} AS link, row_number() OVER (PARTITION BY {key} ORDER BY {other}) AS rn
  FROM fx_edges) z WHERE rn <= {k}"""


@register("f6_out_links", O.cte("fx_edges") + _TOPK_SQL.format(key="src", other="dst", k=LINKS_LIMIT))
def f6_out_links(spark, sf_dir):
    nodes, edges = fx_graph(spark, sf_dir)
    return L.out_links(edges, nodes, LINKS_LIMIT)


@register("f7_in_links", O.cte("fx_edges") + _TOPK_SQL.format(key="dst", other="src", k=LINKS_LIMIT))
def f7_in_links(spark, sf_dir):
    nodes, edges = fx_graph(spark, sf_dir)
    return L.in_links(edges, nodes, LINKS_LIMIT)


@register(
    "f8_retry_queue",
    O.cte("fx_pages", "fx_updates", extra=[PAGES_UPDATED_CTE])
    + f"""SELECT * FROM pages_updated WHERE fetch_status = 'error'
ORDER BY updated_at NULLS FIRST, id LIMIT {QUEUE_LIMIT}""",
)
def f8_retry_queue(spark, sf_dir):
    return L.retry_queue(pages_updated(spark, sf_dir), QUEUE_LIMIT)


# ---------------------------------------------------------------- joins on state
@register(
    "j6_backlinks_titled",
    O.cte("fx_pages", "fx_links")
    + """SELECT l.target_title AS title, p.title AS source_title
FROM fx_links l JOIN fx_pages p ON p.id = l.source_id
WHERE l.target_title IN (SELECT title FROM fx_pages)""",
)
def j6_backlinks_titled(spark, sf_dir):
    pages = TB.fx_pages(spark, sf_dir)
    return L.backlinks_titled(TB.fx_links(spark, sf_dir), pages, pages.select("title"))


@register(
    "j7_unfetched_targets",
    O.cte("fx_pages", "fx_links", extra=[A3_CTE])
    + """SELECT DISTINCT title FROM (SELECT target_title AS title FROM fx_links
                        UNION ALL SELECT target_title FROM html_links) t
WHERE title NOT IN (SELECT title FROM fx_pages)""",
)
def j7_unfetched_targets(spark, sf_dir):
    links = TB.fx_links(spark, sf_dir).select("source_id", "target_title").unionByName(
        html_as_links(spark, sf_dir)
    )
    return L.unfetched_targets(links, TB.fx_pages(spark, sf_dir))


@register(
    "j8_pages_without_embedding",
    O.cte("fx_pages") + "SELECT id, title FROM fx_pages WHERE id NOT IN (SELECT vec_id FROM embeddings)",
)
def j8_pages_without_embedding(spark, sf_dir):
    return L.pages_without_embedding(TB.fx_pages(spark, sf_dir), TB.read(spark, sf_dir, "embeddings"))


def _stored_doc_hashes(spark, sf_dir):
    """Previously stored hashes: labelled documents; low-quality ones were stored
    from an older edition (the text without its final newline added)."""
    docs = TB.read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = TB.read(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(
        "doc_id",
        F.when(F.col("quality") == 1, F.md5("text"))
        .otherwise(F.md5(F.concat("text", F.lit("\n"))))
        .alias("content_hash"),
    )


@register(
    "j9_changed_content",
    """SELECT d.doc_id, s.stored_hash, md5(d.text) AS new_hash,
       NOT (s.stored_hash IS NOT NULL AND s.stored_hash = md5(d.text)) AS changed
FROM documents d LEFT JOIN (
  SELECT d.doc_id, CASE WHEN l.quality = 1 THEN md5(d.text) ELSE md5(d.text || chr(10)) END AS stored_hash
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id) s ON s.doc_id = d.doc_id""",
)
def j9_changed_content(spark, sf_dir):
    docs = TB.read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("content_hash"))
    return L.changed_content(_stored_doc_hashes(spark, sf_dir), docs, key="doc_id")


# ---------------------------------------------------------------- validation
# The stored tables keep every rule: one broken page and link per supplier are added.
_BROKEN_PAGES = (
    "broken_pages",
    """
  SELECT id, title, fetch_status, redirect_to, fetched_at FROM fx_pages UNION ALL
  SELECT -s_suppkey, CASE WHEN s_acctbal >= 0 THEN s_name END,
         CASE WHEN s_acctbal < 0 THEN 'redirect' WHEN s_acctbal < 5000 THEN 'success' ELSE s_name END, NULL, NULL
  FROM supplier""",
)
_BROKEN_LINKS = (
    "broken_links",
    """
  SELECT source_id, target_title FROM fx_links UNION ALL
  SELECT -s_suppkey, CASE WHEN s_acctbal >= 0 THEN repeat(s_name, 40) END FROM supplier""",
)


@register(
    "v1_constraint_violations",
    O.cte("fx_pages", "fx_links", extra=[_BROKEN_PAGES, _BROKEN_LINKS])
    + """SELECT 'pages' AS table_name, CAST(id AS VARCHAR) AS row_key, rule FROM (
  SELECT id, unnest([
    CASE WHEN fetch_status IS NULL OR fetch_status NOT IN
              ('pending', 'success', 'redirect', 'not_found', 'error') THEN 'status_domain' END,
    CASE WHEN fetch_status = 'redirect' AND redirect_to IS NULL THEN 'redirect_target' END,
    CASE WHEN fetch_status NOT IN ('pending', 'error') AND fetched_at IS NULL THEN 'fetched_at_required' END,
    CASE WHEN title IS NULL THEN 'title_not_null' END]) AS rule FROM broken_pages) z
WHERE rule IS NOT NULL
UNION ALL
SELECT 'links', concat_ws('|', CAST(source_id AS VARCHAR), target_title), rule FROM (
  SELECT source_id, target_title, unnest([
    CASE WHEN target_title IS NULL THEN 'target_not_null' END,
    CASE WHEN length(target_title) > 512 THEN 'target_length' END]) AS rule FROM broken_links) z
WHERE rule IS NOT NULL""",
)
def v1_constraint_violations(spark, sf_dir):
    """All pages and links, and one page and one link per supplier that break the rules."""
    supplier, no_balance = TB.read(spark, sf_dir, "supplier"), F.col("s_acctbal") < 0
    bad_pages = supplier.select(
        (-F.col("s_suppkey")).cast("long").alias("id"),
        F.when(~no_balance, F.col("s_name")).alias("title"),
        F.when(no_balance, F.lit(S.STATUS_REDIRECT)).when(F.col("s_acctbal") < 5000, F.lit(S.STATUS_SUCCESS)).otherwise(F.col("s_name")).alias("fetch_status"),
        F.lit(None).cast("string").alias("redirect_to"),
        F.lit(None).cast("timestamp_ntz").alias("fetched_at"),
    )
    bad_links = supplier.select((-F.col("s_suppkey")).cast("long").alias("source_id"), F.when(~no_balance, F.repeat("s_name", F.lit(40))).alias("target_title"))
    pages = TB.fx_pages(spark, sf_dir).select(*bad_pages.columns).unionByName(bad_pages)
    return V.constraint_violations(pages, TB.fx_links(spark, sf_dir).select(*bad_links.columns).unionByName(bad_links))


_A3_ALL_CTE = (
    "html_anchor_links",
    A3_CTE[1].replace("SELECT DISTINCT page_id, target_title FROM t", "SELECT page_id, target_title FROM t"),
)


@register(
    "v2_uniqueness_violations",
    O.cte("fx_pages", extra=[_A3_ALL_CTE])
    + """SELECT 'pages.title' AS key_name, title AS key_value, count(*) AS n
FROM fx_pages GROUP BY title HAVING count(*) > 1
UNION ALL
SELECT 'links.source_target', CAST(page_id AS VARCHAR) || '|' || target_title, count(*)
FROM html_anchor_links GROUP BY page_id, target_title HAVING count(*) > 1""",
)
def v2_uniqueness_violations(spark, sf_dir):
    """Duplicates among page titles and among raw anchor rows (before A3's de-duplication)."""
    anchors = IN.extract_links(TB.read(spark, sf_dir, "pages"), prefix=HTML_PREFIX, distinct=False)
    links = anchors.select(F.col("page_id").alias("source_id"), "target_title")
    return V.uniqueness_violations(TB.fx_pages(spark, sf_dir), links)


@register(
    "v3_fk_orphans",
    O.cte("fx_pages", "fx_links")
    + """SELECT * FROM (SELECT source_id, target_title FROM fx_links
  UNION ALL SELECT -s_suppkey, s_name FROM supplier) l WHERE source_id NOT IN (SELECT id FROM fx_pages)""",
)
def v3_fk_orphans(spark, sf_dir):
    """Orphans among all links and one link per supplier, whose source page does not exist."""
    links = TB.fx_links(spark, sf_dir).select("source_id", "target_title")
    stray = TB.read(spark, sf_dir, "supplier").select((-F.col("s_suppkey")).cast("long").alias("source_id"), F.col("s_name").alias("target_title"))
    return V.fk_orphans(links.unionByName(stray), TB.fx_pages(spark, sf_dir))


@register(
    "v4_valid_title",
    O.cte(extra=[A3_CTE])
    + """SELECT title, reason IS NULL AS valid, reason FROM (
  SELECT title, CASE WHEN title IS NULL OR length(title) = 0 THEN 'empty'
                     WHEN length(title) > 256 THEN 'too_long'
                     WHEN regexp_matches(title, '[<>{}\\[\\]|]') THEN 'forbidden_character' END AS reason
  FROM (SELECT DISTINCT target_title AS title FROM html_links) t) z""",
)
def v4_valid_title(spark, sf_dir):
    titles = html_links(spark, sf_dir).select(F.col("target_title").alias("title")).distinct()
    return V.valid_title(titles)


# ---------------------------------------------------------------- stats
@register(
    "g1_page_stats",
    O.cte("fx_pages", "fx_links")
    + """SELECT count(*) AS total_pages,
       count(*) FILTER (WHERE fetch_status = 'success') AS success_pages,
       count(*) FILTER (WHERE fetch_status = 'pending') AS pending_pages,
       count(*) FILTER (WHERE fetch_status = 'redirect') AS redirect_pages,
       count(*) FILTER (WHERE fetch_status = 'error') AS error_pages,
       count(*) FILTER (WHERE fetch_status = 'not_found') AS not_found_pages,
       min(fetched_at) AS oldest_fetch, max(fetched_at) AS newest_fetch,
       (SELECT count(*) FROM fx_links) AS total_links
FROM fx_pages""",
)
def g1_page_stats(spark, sf_dir):
    return ST.page_stats(TB.fx_pages(spark, sf_dir), TB.fx_links(spark, sf_dir))


# ---------------------------------------------------------------- maintenance
_NEW_PAGES_SQL = f"""
  SELECT (SELECT max(id) FROM fx_pages) + row_number() OVER (ORDER BY title) AS id, title,
         NULL::VARCHAR AS content_hash, 'pending' AS fetch_status, NULL::VARCHAR AS redirect_to,
         NULL::TIMESTAMP AS fetched_at, TIMESTAMP '{NOW}' AS created_at, TIMESTAMP '{NOW}' AS updated_at
  FROM (SELECT DISTINCT {{src}} AS title FROM {{tbl}}) t
  WHERE title IS NOT NULL AND title NOT IN (SELECT title FROM fx_pages)"""


@register(
    "m1_ensure_pages",
    O.cte("fx_pages", extra=[A3_CTE])
    + f"SELECT {_PAGE_COLS} FROM fx_pages UNION ALL "
    + _NEW_PAGES_SQL.format(src="target_title", tbl="html_links"),
)
def m1_ensure_pages(spark, sf_dir):
    titles = html_links(spark, sf_dir).select(F.col("target_title").alias("title"))
    return M.ensure_pages(TB.fx_pages(spark, sf_dir), titles, NOW)


_ADD_LINKS_SQL = f"""SELECT * FROM {{base}} UNION ALL
SELECT DISTINCT page_id AS source_id, target_title, TIMESTAMP '{NOW}' AS created_at
FROM html_links h WHERE length(target_title) <= 512
  AND NOT EXISTS (SELECT 1 FROM {{base}} l WHERE l.source_id = h.page_id AND l.target_title = h.target_title)"""


@register(
    "m2_add_links",
    O.cte("fx_links", extra=[A3_CTE]) + _ADD_LINKS_SQL.format(base="fx_links"),
)
def m2_add_links(spark, sf_dir):
    return M.add_links(TB.fx_links(spark, sf_dir), html_as_links(spark, sf_dir), NOW)


@register(
    "m3_replace_links",
    O.cte(
        "fx_links",
        extra=[
            A3_CTE,
            ("kept_links", "SELECT * FROM fx_links WHERE source_id NOT IN (SELECT page_id FROM pages)"),
        ],
    )
    + _ADD_LINKS_SQL.format(base="kept_links"),
)
def m3_replace_links(spark, sf_dir):
    """Every HTML page replaces the link list of the page with the same id."""
    sources = TB.read(spark, sf_dir, "pages").select(F.col("page_id").alias("source_id"))
    return M.replace_links(TB.fx_links(spark, sf_dir), html_as_links(spark, sf_dir), sources, NOW)


@register(
    "m4_delete_links",
    O.cte("fx_pages", "fx_links")
    + "SELECT * FROM fx_links WHERE source_id NOT IN (SELECT id FROM fx_pages WHERE fetch_status <> 'success')",
)
def m4_delete_links(spark, sf_dir):
    pages = TB.fx_pages(spark, sf_dir)
    sources = pages.where(F.col("fetch_status") != S.STATUS_SUCCESS).select(F.col("id").alias("source_id"))
    return M.delete_links(TB.fx_links(spark, sf_dir), sources)


@register(
    "m5_update_status",
    O.cte("fx_pages", "fx_updates", extra=[PAGES_UPDATED_CTE]) + "SELECT * FROM pages_updated",
)
def m5_update_status(spark, sf_dir):
    return pages_updated(spark, sf_dir)


@register(
    "m6_delete_pages",
    O.cte("fx_pages", "fx_links")
    + "SELECT * FROM fx_links WHERE source_id NOT IN (SELECT id FROM fx_pages WHERE fetch_status = 'not_found')",
)
def m6_delete_pages(spark, sf_dir):
    """Links remaining after deleting every ``not_found`` page (cascade on source)."""
    pages = TB.fx_pages(spark, sf_dir)
    doomed = pages.where(F.col("fetch_status") == S.STATUS_NOT_FOUND).select("title")
    return M.delete_pages(pages, TB.fx_links(spark, sf_dir), doomed)[1]


@register(
    "m6_delete_pages_detach",
    O.cte("fx_pages", "fx_links")
    + """SELECT * FROM fx_links
WHERE source_id NOT IN (SELECT id FROM fx_pages WHERE fetch_status = 'not_found')
  AND target_title NOT IN (SELECT title FROM fx_pages WHERE fetch_status = 'not_found')""",
)
def m6_delete_pages_detach(spark, sf_dir):
    pages = TB.fx_pages(spark, sf_dir)
    doomed = pages.where(F.col("fetch_status") == S.STATUS_NOT_FOUND).select("title")
    return M.delete_pages(pages, TB.fx_links(spark, sf_dir), doomed, detach=True)[1]


@register(
    "m7_add_edges",
    O.cte("fx_edges", "fx_all") + "SELECT src, dst FROM fx_edges UNION SELECT src, dst FROM fx_all",
)
def m7_add_edges(spark, sf_dir):
    edges = fx_graph(spark, sf_dir)[1]
    return G.add_edges(edges, TB.fx_all_edges(spark, sf_dir))


_LATEST_NOT_OK = """SELECT title FROM (SELECT title, fetch_status, row_number() OVER
  (PARTITION BY title ORDER BY updated_at DESC, event_id DESC) AS rn FROM fx_updates) z
  WHERE rn = 1 AND fetch_status <> 'success'"""


@register(
    "m8_remove_out_edges",
    O.cte("fx_edges", "fx_updates") + f"SELECT * FROM fx_edges WHERE src NOT IN ({_LATEST_NOT_OK})",
)
def m8_remove_out_edges(spark, sf_dir):
    """Drop the out-edges of pages whose latest event is not a success."""
    edges = fx_graph(spark, sf_dir)[1]
    latest = M.latest_per_title(TB.fx_page_updates(spark, sf_dir), ["updated_at", "event_id"])
    return G.remove_out_edges(edges, latest.where(F.col("fetch_status") != S.STATUS_SUCCESS).select("title"))


M9_CTES = [
    PAGES_UPDATED_CTE,
    ("changed", f"SELECT * FROM pages_updated WHERE updated_at > TIMESTAMP '{SINCE}'"),
    (
        "fresh",
        """SELECT c.title AS src, l.target_title AS dst FROM changed c JOIN fx_links l ON l.source_id = c.id
  WHERE c.fetch_status = 'success'""",
    ),
    (
        "new_edges",
        "SELECT * FROM fx_edges WHERE src NOT IN (SELECT title FROM changed) UNION ALL SELECT * FROM fresh",
    ),
]


def m9_changes(spark, sf_dir):
    """(titles changed since, the current edges of those that are a success)."""
    changed = pages_updated(spark, sf_dir).where(F.col("updated_at") > F.lit(SINCE).cast("timestamp_ntz"))
    ok = changed.where(F.col("fetch_status") == S.STATUS_SUCCESS).select(F.col("id").alias("source_id"), F.col("title").alias("src"))
    fresh = TB.fx_links(spark, sf_dir).join(ok, "source_id").select("src", F.col("target_title").alias("dst"))
    return changed.select("title"), fresh


def _m9(spark, sf_dir):
    nodes, edges = fx_graph(spark, sf_dir)
    return G.refresh_graph(nodes, edges, pages_updated(spark, sf_dir), TB.fx_links(spark, sf_dir), SINCE)


@register(
    "m9_refresh_graph_edges",
    O.cte("fx_nodes", "fx_updates", extra=M9_CTES) + "SELECT * FROM new_edges",
)
def m9_refresh_graph_edges(spark, sf_dir):
    return _m9(spark, sf_dir)[1]


@register(
    "m9_refresh_graph_nodes",
    O.cte("fx_nodes", "fx_updates", extra=M9_CTES)
    + "SELECT title FROM fx_nodes UNION SELECT src FROM fresh UNION SELECT dst FROM fresh",
)
def m9_refresh_graph_nodes(spark, sf_dir):
    return _m9(spark, sf_dir)[0]


_UPSERTS_CTE = (
    "upserts",
    f"""SELECT event_id, title, fetch_status, content_hash, redirect_to, updated_at FROM fx_updates
  UNION ALL
  SELECT -1, target_title, 'success', md5(target_title), NULL, TIMESTAMP '{NOW}'
  FROM (SELECT DISTINCT target_title FROM html_links) h""",
)


@register(
    "m10_upsert_pages",
    O.cte(
        "fx_pages",
        "fx_updates",
        extra=[
            A3_CTE,
            _UPSERTS_CTE,
            (
                "ensured",
                f"SELECT {_PAGE_COLS} FROM fx_pages UNION ALL "
                + _NEW_PAGES_SQL.format(src="title", tbl="upserts"),
            ),
            (
                "u",
                """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title
                 ORDER BY updated_at DESC, event_id DESC) AS rn FROM upserts) z WHERE rn = 1""",
            ),
        ],
    )
    + """SELECT p.id, p.title,
       CASE WHEN u.title IS NULL THEN p.content_hash ELSE nullif(u.content_hash, '') END AS content_hash,
       CASE WHEN u.title IS NULL THEN p.fetch_status ELSE u.fetch_status END AS fetch_status,
       CASE WHEN u.title IS NULL THEN p.redirect_to ELSE nullif(u.redirect_to, '') END AS redirect_to,
       CASE WHEN u.title IS NULL THEN p.fetched_at ELSE u.updated_at END AS fetched_at,
       p.created_at,
       CASE WHEN u.title IS NULL THEN p.updated_at ELSE u.updated_at END AS updated_at
FROM ensured p LEFT JOIN u ON u.title = p.title""",
)
def m10_upsert_pages(spark, sf_dir):
    """Upsert event updates (known titles) and HTML link targets fetched as success (new titles)."""
    ev = TB.fx_page_updates(spark, sf_dir).select(
        "event_id", "title", "fetch_status", "content_hash", "redirect_to", "updated_at"
    )
    fetched = (
        html_links(spark, sf_dir)
        .select(F.col("target_title").alias("title"))
        .distinct()
        .select(
            F.lit(-1).cast("long").alias("event_id"),
            "title",
            F.lit(S.STATUS_SUCCESS).alias("fetch_status"),
            F.md5("title").alias("content_hash"),
            F.lit(None).cast("string").alias("redirect_to"),
            F.lit(NOW).cast("timestamp_ntz").alias("updated_at"),
        )
    )
    return M.upsert_pages(TB.fx_pages(spark, sf_dir), ev.unionByName(fetched), NOW, ["updated_at", "event_id"])


@register(
    "m11_purge_pages",
    O.cte("fx_pages", "fx_links")
    + f"""SELECT (SELECT count(*) FROM fx_pages WHERE fetched_at < TIMESTAMP '{PURGE_BEFORE}') AS removed_pages,
       (SELECT count(*) FROM fx_links WHERE source_id IN
          (SELECT id FROM fx_pages WHERE fetched_at < TIMESTAMP '{PURGE_BEFORE}')) AS removed_links""",
)
def m11_purge_pages(spark, sf_dir):
    return M.purge_pages(TB.fx_pages(spark, sf_dir), TB.fx_links(spark, sf_dir), PURGE_BEFORE)[2]


# ---------------------------------------------------------------- X7
def _fetch_results(spark, sf_dir):
    """Replayed fetches of every non-pending page: errors, 404s, redirects to the
    fixture target, and success bodies (the page's document text when it has one,
    else its title -- whose hash equals the stored one)."""
    from linkweave.functions import text as X

    pages = TB.fx_pages(spark, sf_dir).where(F.col("fetch_status") != S.STATUS_PENDING)
    docs = TB.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    st = F.col("fetch_status")
    return pages.join(docs, "id", "left").select(
        "title",
        F.when(st == S.STATUS_NOT_FOUND, F.lit(404)).otherwise(F.lit(200)).alias("status_code"),
        F.when(st == S.STATUS_REDIRECT, X.title_to_url("redirect_to")).otherwise(X.title_to_url("title")).alias(
            "final_url"
        ),
        F.when(st == S.STATUS_SUCCESS, F.coalesce("text", "title")).alias("html"),
        F.when(st == S.STATUS_ERROR, F.lit("fetch failed")).alias("error"),
    )


@register(
    "x7_classify_fetches",
    O.cte("fx_pages")
    + """SELECT p.title,
       CASE p.fetch_status WHEN 'error' THEN 'error' WHEN 'not_found' THEN 'not_found'
            WHEN 'redirect' THEN 'redirect' ELSE 'success' END AS outcome,
       CASE WHEN p.fetch_status = 'redirect' THEN p.redirect_to END AS redirect_to,
       CASE WHEN p.fetch_status = 'success' THEN md5(coalesce(d.text, p.title)) END AS content_hash,
       p.fetch_status = 'success' AND md5(coalesce(d.text, p.title)) <> p.content_hash AS fetched,
       p.fetch_status IN ('not_found', 'redirect')
         OR (p.fetch_status = 'success' AND md5(coalesce(d.text, p.title)) = p.content_hash) AS skipped
FROM fx_pages p LEFT JOIN documents d ON d.doc_id = p.id
WHERE p.fetch_status <> 'pending'""",
)
def x7_classify_fetches(spark, sf_dir):
    return IN.classify_fetches(_fetch_results(spark, sf_dir), TB.fx_pages(spark, sf_dir)).drop("html")


@register(
    "g5_fetch_stats",
    O.cte("fx_pages", "fx_links")
    + """, o AS (
  SELECT p.id, p.fetch_status, p.fetch_status = 'success' AND md5(coalesce(d.text, p.title)) <> p.content_hash AS fetched
  FROM fx_pages p LEFT JOIN documents d ON d.doc_id = p.id WHERE p.fetch_status <> 'pending')
SELECT count(*) FILTER (WHERE fetched) AS pages_fetched,
       count(*) FILTER (WHERE NOT fetched AND fetch_status <> 'error') AS pages_skipped,
       (SELECT count(*) FROM fx_links WHERE source_id IN (SELECT id FROM o WHERE fetched)) AS links_found,
       count(*) FILTER (WHERE fetch_status = 'error') AS errors
FROM o""",
)
def g5_fetch_stats(spark, sf_dir):
    """G5 over the classified fetches (X7): links are those of the fetched pages."""
    pages = TB.fx_pages(spark, sf_dir)
    n_links = TB.fx_links(spark, sf_dir).groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("n_links"))
    found = pages.select("id", "title").join(n_links, "id", "left").select("title", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return ST.crawl_stats(IN.classify_fetches(_fetch_results(spark, sf_dir), pages).join(found, "title"))
