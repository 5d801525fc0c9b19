"""Registered queries: streaming jobs run to completion (availableNow) on staged updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkweave.plans import oracle as O
from linkweave.plans.catalog import fx_graph, register
from linkweave.sources import tables as TB
from linkweave.streaming import refresh as ST

_LATEST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title
    ORDER BY updated_at DESC, event_id DESC) AS rn FROM fx_updates) z WHERE rn = 1"""


def _stream(spark, sf_dir, name):
    base = ST.scratch(spark, name)
    src = ST.stage_updates(TB.fx_page_updates(spark, sf_dir), f"{base}/source")
    return base, ST.read_updates(spark, src)


_T1 = O.cte(
    "fx_nodes",
    "fx_updates",
    extra=[
        ("latest", _LATEST),
        (
            "fresh",
            """SELECT u.title AS src, l.target_title AS dst FROM latest u JOIN fx_links l ON l.source_id = u.page_id
  WHERE u.fetch_status = 'success'""",
        ),
    ],
)


def _t1(spark, sf_dir):
    nodes, edges = fx_graph(spark, sf_dir)
    base, stream = _stream(spark, sf_dir, "t1")
    return ST.refresh_stream(stream, nodes, edges, TB.fx_links(spark, sf_dir), f"{base}/out", f"{base}/ckpt")


@register(
    "t1_refresh_stream_edges",
    _T1 + "SELECT * FROM fx_edges WHERE src NOT IN (SELECT title FROM latest) UNION ALL SELECT * FROM fresh",
)
def t1_refresh_stream_edges(spark, sf_dir):
    return _t1(spark, sf_dir)[1]


@register(
    "t1_refresh_stream_nodes",
    _T1 + "SELECT title FROM fx_nodes UNION SELECT src FROM fresh UNION SELECT dst FROM fresh",
)
def t1_refresh_stream_nodes(spark, sf_dir):
    return _t1(spark, sf_dir)[0]


@register(
    "t2_changed_content_stream",
    O.cte("fx_updates")
    + """SELECT title, event_id, content_hash, updated_at FROM (
  SELECT *, lag(content_hash) OVER (PARTITION BY title ORDER BY updated_at, event_id) AS prev
  FROM fx_updates WHERE content_hash IS NOT NULL) z
WHERE prev IS NULL OR prev <> content_hash""",
)
def t2_changed_content_stream(spark, sf_dir):
    base, stream = _stream(spark, sf_dir, "t2")
    return ST.changed_content_stream(stream, f"{base}/out", f"{base}/ckpt")


_LINKS_AT = """SELECT u.title, u.event_id, u.updated_at, l.target_title AS target FROM changed u
  JOIN fx_links l ON l.source_id = u.page_id AND substr(md5(u.content_hash || l.target_title), 1, 1) < '8'"""


@register(
    "t2_link_delta_stream",
    O.cte(
        "fx_links",
        "fx_updates",
        extra=[
            (
                "content",
                """SELECT *, lag(content_hash) OVER w AS prev FROM fx_updates WHERE content_hash IS NOT NULL
  WINDOW w AS (PARTITION BY title ORDER BY updated_at, event_id)""",
            ),
            (
                "changed",
                """SELECT *, lag(event_id) OVER (PARTITION BY title ORDER BY updated_at, event_id) AS prev_event,
  lead(event_id) OVER (PARTITION BY title ORDER BY updated_at, event_id) AS next_event
  FROM content WHERE prev IS NULL OR prev <> content_hash""",
            ),
            ("held", _LINKS_AT),
        ],
    )
    + """SELECT h.title, h.event_id, h.updated_at, h.target, 'added' AS change FROM held h JOIN changed c USING (event_id)
WHERE NOT EXISTS (SELECT 1 FROM held p WHERE p.event_id = c.prev_event AND p.target = h.target)
UNION ALL
SELECT n.title, n.event_id, n.updated_at, h.target, 'removed' FROM held h JOIN changed c USING (event_id)
JOIN changed n ON n.event_id = c.next_event
WHERE NOT EXISTS (SELECT 1 FROM held p WHERE p.event_id = n.event_id AND p.target = h.target)""",
)
def t2_link_delta_stream(spark, sf_dir):
    """Links that every content change adds and removes; a content shows about half of its page's links, by hash."""
    updates = TB.fx_page_updates(spark, sf_dir)
    shown = TB.fx_links(spark, sf_dir).select(F.col("source_id").alias("page_id"), "target_title")
    pairs = updates.where(F.col("content_hash").isNotNull()).select("event_id", "page_id", "content_hash").join(shown, "page_id")
    pairs = pairs.where(F.substring(F.md5(F.concat("content_hash", "target_title")), 1, 1) < "8")
    lists = pairs.groupBy("event_id").agg(F.collect_set("target_title").alias("links"))  # one page's links
    base = ST.scratch(spark, "t2links")
    rows = updates.join(lists, "event_id", "left").select("event_id", "title", "updated_at", "content_hash", "links")
    ST.stage(rows.withColumn("day", F.to_date("updated_at")), f"{base}/source", "day", "event_id")
    schema = "event_id long, title string, updated_at timestamp_ntz, content_hash string, links array<string>, day date"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(f"{base}/source")
    return ST.link_delta_stream(stream, f"{base}/out", f"{base}/ckpt")


def _t3(spark, sf_dir, name):
    base, stream = _stream(spark, sf_dir, name)
    links = ST.read_links(spark, ST.stage_links(TB.fx_links(spark, sf_dir), f"{base}/links"))
    return ST.export_stream(stream, links, f"{base}/out", f"{base}/ckpt")


@register(
    "t3_export_stream_nodes",
    O.cte("fx_updates") + "SELECT DISTINCT title FROM fx_updates WHERE fetch_status = 'success'",
)
def t3_export_stream_nodes(spark, sf_dir):
    return _t3(spark, sf_dir, "t3n")[0]


@register(
    "t3_export_stream_edges",
    O.cte("fx_links", "fx_updates")
    + """SELECT DISTINCT u.title AS src, l.target_title AS dst
FROM (SELECT DISTINCT title, page_id FROM fx_updates WHERE fetch_status = 'success') u
JOIN fx_links l ON l.source_id = u.page_id
WHERE l.target_title IN (SELECT title FROM fx_updates WHERE fetch_status = 'success')""",
)
def t3_export_stream_edges(spark, sf_dir):
    return _t3(spark, sf_dir, "t3e")[1]


@register(
    "t4_status_counts_stream",
    O.cte("fx_updates", extra=[("latest", _LATEST)])
    + "SELECT fetch_status, count(*) AS pages FROM latest GROUP BY fetch_status",
)
def t4_status_counts_stream(spark, sf_dir):
    base, stream = _stream(spark, sf_dir, "t4")
    return ST.status_counts_stream(stream, f"{base}/out", f"{base}/ckpt")
