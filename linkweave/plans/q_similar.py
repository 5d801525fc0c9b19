"""Registered queries: embeddings and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkweave.operators import similarity as SIM
from linkweave.plans import oracle as O
from linkweave.plans.catalog import fx_graph, register
from linkweave.sources import tables as TB

TOP_K = 10
SIMILAR_THRESHOLD = 0.5

_VEC = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
              sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n
       FROM embeddings)"""

_SCORE = """round(CASE WHEN a.n > 0 AND b.n > 0 AND len(a.e) = len(b.e)
                  THEN list_dot_product(a.e, b.e) / (a.n * b.n) ELSE 0 END, 6)"""

_TOPK_SQL = f"""WITH {_VEC},
s AS (SELECT a.vec_id AS query_id, b.vec_id, {_SCORE} AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s)
SELECT query_id, vec_id, score, CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= {TOP_K}"""


def _vectors(spark, sf_dir):
    return TB.read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


@register("a11_scan_embeddings", "SELECT vec_id, embedding, label FROM embeddings")
def a11_scan_embeddings(spark, sf_dir):
    return _vectors(spark, sf_dir)


@register(
    "s1_cosine_pairs",
    f"""WITH {_VEC}
SELECT a.vec_id AS left_id, b.vec_id AS right_id, {_SCORE} AS score
FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""",
)
def s1_cosine_pairs(spark, sf_dir):
    """Cosine of each vector with the vector of the next key."""
    vec = _vectors(spark, sf_dir)
    pairs = vec.select(F.col("vec_id").alias("left_id"), (F.col("vec_id") + 1).alias("right_id"))
    return SIM.cosine_pairs(pairs, vec)


@register("s2_similar_topk", _TOPK_SQL)
def s2_similar_topk(spark, sf_dir):
    """Every vector's 10 nearest other vectors by cosine."""
    vec = _vectors(spark, sf_dir)
    return SIM.similar_topk(
        vec.select(F.col("vec_id").alias("query_id"), "embedding"), vec, TOP_K, exclude_self=True
    )


@register("s2_similar_topk_blocks", _TOPK_SQL)
def s2_similar_topk_blocks(spark, sf_dir):
    """The same by block pairs, the way of query tables that are too large to broadcast."""
    vec = _vectors(spark, sf_dir)
    return SIM.similar_topk(vec.select(F.col("vec_id").alias("query_id"), "embedding"), vec, TOP_K, exclude_self=True, broadcast_max=200)


@register("s3_find_similar", f"SELECT * FROM ({_TOPK_SQL}) t WHERE score >= {SIMILAR_THRESHOLD}")
def s3_find_similar(spark, sf_dir):
    return SIM.find_similar(_vectors(spark, sf_dir), TOP_K, SIMILAR_THRESHOLD)


@register(
    "s6_embedding_profile",
    """SELECT count(*) AS vectors, min(len(embedding)) AS min_dimensions,
       max(len(embedding)) AS max_dimensions FROM embeddings""",
)
def s6_embedding_profile(spark, sf_dir):
    return SIM.embedding_profile(_vectors(spark, sf_dir))


@register(
    "s8_embedding_text",
    O.cte("fx_edges")
    + """SELECT p.title, CASE WHEN o.l IS NULL THEN p.title ELSE p.title || ' ' || array_to_string(o.l, ' ') END AS text
FROM fx_pages p LEFT JOIN (SELECT src, list_sort(list(dst)) AS l FROM fx_edges GROUP BY src) o ON o.src = p.title""",
)
def s8_embedding_text(spark, sf_dir):
    edges = fx_graph(spark, sf_dir)[1]
    return SIM.embedding_text(TB.fx_pages(spark, sf_dir), edges)


@register("s8_embedding_text_title", O.cte("fx_pages") + "SELECT title, title AS text FROM fx_pages")
def s8_embedding_text_title(spark, sf_dir):
    return SIM.embedding_text(TB.fx_pages(spark, sf_dir))


@register(
    "s8_embedding_text_paragraph",
    """SELECT url AS title, url || CASE WHEN trim(p) = '' THEN '' ELSE ' ' || trim(p) END AS text FROM (
  SELECT url, trim(regexp_replace(regexp_replace(coalesce(regexp_extract(html, '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1), ''),
         '<[^>]*>', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS p FROM pages WHERE url IS NOT NULL) z""",
)
def s8_embedding_text_paragraph(spark, sf_dir):
    """Title (here the url) and first paragraph of every raw page."""
    raw = TB.read(spark, sf_dir, "pages").where(F.col("url").isNotNull())
    body = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<p(?:\s[^>]*)?>(.*?)</p>", 1)
    plain = F.regexp_replace(F.regexp_replace(body, "<[^>]*>", ""), r"[ \t\r\n]+", " ")
    pages = raw.select(F.col("url").alias("title"), plain.alias("paragraph"))
    return SIM.embedding_text(pages, paragraphs=pages)


@register("s4_embed_batch")
def s4_embed_batch(spark, sf_dir):
    """Hashing-encoder vectors for every document's whole text (no SQL form)."""
    docs = TB.read(spark, sf_dir, "documents").select("doc_id", "text")
    return SIM.embed_batch(docs, "doc_id")


@register("s5_compute_missing_embeddings")
def s5_compute_missing_embeddings(spark, sf_dir):
    return SIM.compute_missing_embeddings(TB.fx_pages(spark, sf_dir), _vectors(spark, sf_dir))


@register("s7_similar_approx")
def s7_similar_approx(spark, sf_dir):
    return SIM.similar_approx(_vectors(spark, sf_dir), TOP_K)
