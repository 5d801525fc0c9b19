"""Versioned graph snapshots on shared storage (A4 write, A5 read).

Layout under ``root``::

    v=<N>/nodes/     parquet
    v=<N>/edges/     parquet, hash-partitioned by ``src``
    v=<N>/manifest/  one-row JSON, written LAST -- the commit point

A reader only considers versions whose manifest exists, so it sees the old
or the new graph, never a half-written one.  A writer never overwrites a
version directory.  All I/O goes through Spark, so ``root`` may be any
Hadoop-compatible shared file system.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Fixed value: on-disk format version of the snapshot layout.
FORMAT_VERSION = 1


def _manifests(spark: SparkSession, root: str) -> DataFrame | None:
    """All committed manifests; None before the first commit.  Other errors surface."""
    pattern = f"{root.rstrip('/')}/v=*/manifest-*/part-*"
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return spark.read.json(pattern) if found is not None and len(found) else None


def _size(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return int(p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength())


def latest_version(spark: SparkSession, root: str) -> int | None:
    m = _manifests(spark, root)
    if m is None or "version" not in m.columns:
        return None
    row = m.agg(F.max("version").alias("v")).first()
    return None if row is None or row["v"] is None else int(row["v"])


def write_graph_snapshot(
    nodes: DataFrame, edges: DataFrame, root: str, partitions: int | None = None
) -> dict:
    """A4: write a new version; returns its manifest.

    Every attempt writes to folders of its own and the manifest, written last,
    names them.  What a crashed attempt leaves behind is never read and never
    in the way of the next one.
    """
    spark = nodes.sparkSession
    version = (latest_version(spark, root) or 0) + 1
    attempt = uuid.uuid4().hex
    base = f"{root.rstrip('/')}/v={version}/data-{attempt}"
    n_obs, e_obs = Observation("nodes"), Observation("edges")
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes.select("title").observe(n_obs, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").parquet(
        f"{base}/nodes"
    )
    (
        edges.select("src", "dst")
        .repartition(parts, "src")
        .observe(e_obs, F.count(F.lit(1)).alias("n"))
        .write.mode("errorifexists")
        .parquet(f"{base}/edges")
    )
    manifest = {
        "format_version": FORMAT_VERSION,
        "version": version,
        "node_count": int(n_obs.get["n"]),
        "edge_count": int(e_obs.get["n"]),
        "size_bytes": _size(spark, base),
        "attempt": attempt,
        "created_at": dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"),
    }
    spark.createDataFrame([manifest]).coalesce(1).write.mode("errorifexists").json(
        f"{root.rstrip('/')}/v={version}/manifest-{attempt}"
    )
    return manifest


def read_graph_snapshot(
    spark: SparkSession, root: str, version: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A5: (nodes, edges, info) of a committed version (latest by default).

    Rejects an unknown format version; drops edges whose ends are not nodes.
    ``info`` has format/version/counts from the manifest (no data scan) plus the
    snapshot's age in seconds.
    """
    m = _manifests(spark, root)
    if m is None:
        raise FileNotFoundError(f"no committed snapshot under {root}")
    v = version if version is not None else latest_version(spark, root)
    # Two writers that raced to one version: the lesser attempt is the committed one.
    info = m.where(F.col("version") == v).orderBy("attempt").limit(1)
    row = info.first()
    if row is None:
        raise FileNotFoundError(f"snapshot version {v} not committed under {root}")
    if int(row["format_version"]) != FORMAT_VERSION:
        raise ValueError(f"snapshot format {row['format_version']} != {FORMAT_VERSION}")
    base = f"{root.rstrip('/')}/v={v}/data-{row['attempt']}"
    nodes = spark.read.parquet(f"{base}/nodes")
    edges = spark.read.parquet(f"{base}/edges")
    edges = edges.join(nodes.select(F.col("title").alias("src")), "src", "left_semi").join(
        nodes.select(F.col("title").alias("dst")), "dst", "left_semi"
    ).select("src", "dst")
    info = info.select(
        F.col("format_version").cast("int").alias("format_version"),
        F.col("version").cast("int").alias("version"),
        F.col("node_count").cast("long").alias("node_count"),
        F.col("edge_count").cast("long").alias("edge_count"),
        F.col("size_bytes").cast("long").alias("size_bytes"),
        F.col("created_at"),
        (F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(F.to_timestamp("created_at"))).alias(
            "age_seconds"
        ),
    )
    return nodes, edges, info
