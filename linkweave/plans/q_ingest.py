"""Registered queries: link extraction and URL/title functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkweave.functions import text as X
from linkweave.operators import ingest as IN
from linkweave.operators import stats as ST
from linkweave.plans import oracle as O
from linkweave.plans.catalog import register
from linkweave.sources import tables as TB

# The driver's HTML corpus links with relative ``/word`` hrefs (FIXTURES.md B.4).
HTML_PREFIX = "/"

_NS = ", ".join("'" + n + "'" for n in X.EXCLUDED_NAMESPACES)

# A3 in SQL: same anchor pattern, same title rules.
A3_CTE = (
    "html_links",
    rf"""
  WITH a AS (
    SELECT page_id, unnest(regexp_extract_all(html,
        '(?i)<a\s[^>]*?href\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1)) AS raw
    FROM pages),
  h AS (
    SELECT page_id, replace(replace(replace(replace(replace(replace(
        CASE WHEN left(raw, 1) IN ('"', '''') THEN raw[2:-2] ELSE raw END,
        '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS href
    FROM a),
  p AS (
    SELECT page_id, split_part(substr(href, {len(HTML_PREFIX) + 1}), '#', 1) AS path
    FROM h WHERE starts_with(href, '{HTML_PREFIX}') AND NOT starts_with(href, '//')),
  t AS (
    SELECT page_id,
           CASE WHEN contains(regexp_replace(path, '%[0-9A-Fa-f]{{2}}', '', 'g'), '%') THEN path
                ELSE replace(url_decode(path), '_', ' ') END AS target_title
    FROM p)
  SELECT DISTINCT page_id, target_title FROM t
  WHERE target_title <> ''
    AND NOT (contains(target_title, ':') AND split_part(target_title, ':', 1) IN ({_NS}))
    AND NOT ends_with(target_title, '{X.DISAMBIGUATION_SUFFIX}')""",
)


def html_links(spark, sf_dir):
    return IN.extract_links(TB.read(spark, sf_dir, "pages"), prefix=HTML_PREFIX)


@register("a3_extract_links", O.cte(extra=[A3_CTE]) + "SELECT * FROM html_links")
def a3_extract_links(spark, sf_dir):
    return html_links(spark, sf_dir)


# Hrefs that the corpus lacks, one of each kind per page, and the titles they stand for (none: no link).
_AWKWARD = (
    ("/Topic_{}%20a#part", "Topic {} a"),
    ("/Caf%C3%A9_{}?x=1", "Café {}?x=1"),
    ("/50%_of_{}", "50%_of_{}"),
    ("/Talk_show:{}", "Talk show:{}"),
    ("/File:{}.png", None),
    ("/Category:{}#a", None),
    ("/Topic_{}_(disambiguation)", None),
    ("//other.host/{}", None),
    ("#note_{}", None),
)


@register(
    "x2_x5_title_rules",
    O.cte(extra=[A3_CTE])
    + "SELECT * FROM html_links "
    + " ".join(f"UNION SELECT page_id, replace('{title}', '{{}}', CAST(page_id AS VARCHAR)) FROM pages" for _, title in _AWKWARD if title),
)
def x2_x5_title_rules(spark, sf_dir):
    """Link extraction over all pages, each with an anchor for every title rule."""
    pages = TB.read(spark, sf_dir, "pages")
    anchors = "".join(f'<a href="{href}">x</a>' for href, _ in _AWKWARD)
    extra = F.replace(F.lit(anchors), F.lit("{}"), F.col("page_id").cast("string"))
    return IN.extract_links(pages.withColumn("html", F.concat(extra, "html")), prefix=HTML_PREFIX)


# The corpus marks its link list by element, not by id: give that element the scope's id.
_SCOPED_CTE = (
    A3_CTE[0],
    A3_CTE[1].replace("FROM pages)", "FROM (SELECT page_id, regexp_extract(html, '<nav>.*?</nav>', 0, 's') AS html FROM pages))"),
)


@register("a3_extract_links_scoped", O.cte(extra=[_SCOPED_CTE]) + "SELECT * FROM html_links")
def a3_extract_links_scoped(spark, sf_dir):
    """Links inside the marked element only; those of the rest of the page are left out."""
    pages = TB.read(spark, sf_dir, "pages").withColumn("html", F.replace("html", F.lit("<nav>"), F.lit(f'<nav id="{IN.SCOPE_ID}">')))
    return IN.extract_links(pages, prefix=HTML_PREFIX, scoped=True)


@register(
    "g6_distinct_targets",
    O.cte(extra=[A3_CTE]) + "SELECT DISTINCT target_title AS title FROM html_links",
)
def g6_distinct_targets(spark, sf_dir):
    return ST.distinct_targets(html_links(spark, sf_dir))


@register(
    "x6_content_hash",
    "SELECT doc_id, md5(text) AS content_hash FROM documents",
)
def x6_content_hash(spark, sf_dir):
    docs = TB.read(spark, sf_dir, "documents")
    return docs.select("doc_id", X.content_hash("text").alias("content_hash"))


_X9_SQL = O.cte("fx_pages") + """SELECT id, title,
  'https://en.wikipedia.org/wiki/' || replace(replace(replace(replace(replace(replace(
      url_encode(replace(title, ' ', '_')),
      '%24', '$'), '%26', '&'), '%2B', '+'), '%3A', ':'), '%3D', '='), '%40', '@') AS url
FROM fx_pages"""


@register("x9_title_url", _X9_SQL)
def x9_title_url(spark, sf_dir):
    pages = TB.fx_pages(spark, sf_dir)
    return pages.select("id", "title", X.title_to_url("title").alias("url"))


_X8_SQL = """SELECT p.page_id, p.url AS original, n.url AS final,
  CASE WHEN p.url = n.url THEN ''
       WHEN NOT starts_with(regexp_extract(n.url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') THEN ''
       ELSE replace(url_decode(substr(regexp_extract(n.url, '^[a-z]+://[^/?#]*([^?#]*)', 1), 2)), '_', ' ')
  END AS redirect_to
FROM pages p JOIN pages n ON n.page_id = p.page_id + 1"""


@register("x8_redirect_target", _X8_SQL)
def x8_redirect_target(spark, sf_dir):
    """Redirect detection for a fetch of each page's URL that landed on the next page's URL."""
    pages = TB.read(spark, sf_dir, "pages").select("page_id", "url")
    nxt = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("final"))
    return pages.join(nxt, "page_id").select(
        "page_id",
        F.col("url").alias("original"),
        "final",
        X.redirect_target("url", "final", HTML_PREFIX).alias("redirect_to"),
    )
