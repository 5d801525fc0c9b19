"""Explicit schemas of the data model (no inference anywhere)."""

from __future__ import annotations

from pyspark.sql import types as T

# The page fetch-status domain.
STATUS_PENDING = "pending"
STATUS_SUCCESS = "success"
STATUS_REDIRECT = "redirect"
STATUS_NOT_FOUND = "not_found"
STATUS_ERROR = "error"
STATUSES = (STATUS_PENDING, STATUS_SUCCESS, STATUS_REDIRECT, STATUS_NOT_FOUND, STATUS_ERROR)

# Fixed value: longest accepted link target title (links.target_title).
MAX_TARGET_LEN = 512

TS = T.TimestampNTZType()

PAGES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("content_hash", T.StringType(), True),
        T.StructField("fetch_status", T.StringType(), False),
        T.StructField("redirect_to", T.StringType(), True),
        T.StructField("fetched_at", TS, True),
        T.StructField("created_at", TS, True),
        T.StructField("updated_at", TS, True),
    ]
)

LINKS = T.StructType(
    [
        T.StructField("source_id", T.LongType(), False),
        T.StructField("target_title", T.StringType(), False),
        T.StructField("created_at", TS, True),
    ]
)

EDGES = T.StructType(
    [T.StructField("src", T.StringType(), False), T.StructField("dst", T.StringType(), False)]
)

NODES = T.StructType([T.StructField("title", T.StringType(), False)])

PATH_QUERIES = T.StructType(
    [
        T.StructField("query_id", T.LongType(), False),
        T.StructField("from", T.StringType(), True),
        T.StructField("to", T.StringType(), True),
        T.StructField("max_depth", T.IntegerType(), True),
    ]
)

PATH_RESULT = T.StructType(
    [
        T.StructField("query_id", T.LongType(), False),
        T.StructField("from", T.StringType(), True),
        T.StructField("to", T.StringType(), True),
        T.StructField("found", T.BooleanType(), False),
        T.StructField("path", T.ArrayType(T.StringType()), True),
        T.StructField("hops", T.IntegerType(), True),
        T.StructField("explored", T.LongType(), False),
    ]
)

HTML_PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType(), False),
        T.StructField("url", T.StringType(), True),
        T.StructField("html", T.StringType(), True),
    ]
)

FETCH_RESULTS = T.StructType(
    [
        T.StructField("title", T.StringType(), False),
        T.StructField("status_code", T.IntegerType(), True),
        T.StructField("final_url", T.StringType(), True),
        T.StructField("html", T.StringType(), True),
        T.StructField("error", T.StringType(), True),
    ]
)

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType()), True),
        T.StructField("label", T.IntegerType(), True),
    ]
)
