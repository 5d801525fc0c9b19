"""Log-structured graph snapshots: full versions, deltas with tombstones, merge on read.

Layout under ``root``::

    data/<attempt>/...      parquet, one folder per commit attempt
    log/<version>.json      the commit: what the version adds and where it lies

A commit writes its data first and then creates ``log/<n + 1>.json``, which
fails if another writer has taken the number; it then takes the next one, its
data stands as written.  Versions are gapless and never change.

A *delta* holds new nodes, new edges and tombstones by source title: a tombstone
at version v takes out the source's edges of all versions before v.  A *fold* is
a full graph; reading a version merges the last fold before it with the deltas
after that.  So a commit costs what it brings, a read the graph plus the deltas
since the last fold, and :func:`fold` keeps these few.

Edges that came by a delta are marked: their ends are nodes for as long as the
edge stands, while the nodes of a full version, and those that a delta names,
stay.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Fixed value: on-disk format version of the log.
FORMAT_VERSION = 2
_EDGE, _NODE, _TOMB = "src string, dst string, late boolean", "title string", "title string"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, root: str) -> list[dict]:
    """Manifests of all versions, oldest first (one small row per commit)."""
    fs, folder = _fs(spark, f"{root}/log")
    if not fs.exists(folder) or not len(fs.listStatus(folder)):
        return []
    rows = spark.read.schema("version long, kind string, data string, node_rows long, edge_rows long, tombstones long, format_version int, created_at string").json(f"{root}/log")
    return sorted((r.asDict() for r in rows.collect()), key=lambda r: r["version"])


def _commit(spark: SparkSession, root: str, entry: dict) -> dict:
    """Take the next free version number for data that is already written."""
    known = versions(spark, root)
    version = known[-1]["version"] + 1 if known else 1
    while True:
        entry = {**entry, "version": version, "format_version": FORMAT_VERSION, "created_at": dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")}
        fs, path = _fs(spark, f"{root}/log/{version:012d}.json")
        if not fs.exists(path):
            # Written aside and renamed into place: a reader never sees half a manifest.
            _, aside = _fs(spark, f"{root}/log/_{uuid.uuid4().hex}")
            out = fs.create(aside, False)
            out.write(bytearray(json.dumps(entry), "utf-8"))
            out.close()
            if not fs.exists(path) and fs.rename(aside, path):
                return entry
            fs.delete(aside, False)
        version += 1


def _write(spark: SparkSession, root: str, kind: str, nodes: DataFrame, edges: DataFrame, tombs: DataFrame | None) -> dict:
    data, counts = f"{root}/data/{uuid.uuid4().hex}", {}
    for name, frame in (("nodes", nodes.select("title")), ("edges", edges.select("src", "dst", "late")), ("tombs", tombs.select("title") if tombs is not None else None)):
        if frame is None:
            counts[name] = 0
            continue
        seen = Observation()
        frame.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").parquet(f"{data}/{name}")
        counts[name] = int(seen.get["n"])
    return _commit(spark, root, {"kind": kind, "data": data, "node_rows": counts["nodes"], "edge_rows": counts["edges"], "tombstones": counts["tombs"]})


def write_full(nodes: DataFrame, edges: DataFrame, root: str) -> dict:
    """A4: commit a whole graph as a version of its own; returns its manifest."""
    return _write(nodes.sparkSession, root, "full", nodes, edges.select("src", "dst", F.lit(False).alias("late")), None)


def write_delta(changed: DataFrame, nodes: DataFrame, edges: DataFrame, root: str) -> dict:
    """Commit a change: the edges of the sources in ``changed (title)`` go, ``nodes`` and ``edges`` (with their ends) come."""
    if not versions(changed.sparkSession, root):
        raise FileNotFoundError(f"no full version under {root}")
    return _write(changed.sparkSession, root, "delta", nodes, edges.select("src", "dst", F.lit(True).alias("late")), changed)


def _read(spark: SparkSession, entries: list[dict], name: str, schema: str) -> DataFrame:
    """Rows of the given commits with the version they came with."""
    out = None
    for e in entries:
        part = spark.read.schema(schema).parquet(f"{e['data']}/{name}").withColumn("version", F.lit(e["version"]))
        out = part if out is None else out.unionByName(part)
    return out


def _merged(spark: SparkSession, root: str, version: int | None) -> tuple[DataFrame, DataFrame]:
    """(named nodes, edges with their mark) of a version.

    An edge counts unless its source has a tombstone of a later version.  The
    tombstones are reduced to one row per source first; edges meet them in one
    join, which Spark broadcasts when the deltas since the last full version are
    small.  An unknown version, and one whose full version was retired, raise.
    """
    known = [e for e in versions(spark, root) if version is None or e["version"] <= version]
    if not known or (version is not None and known[-1]["version"] != version):
        raise FileNotFoundError(f"no version {version or ''} under {root}")
    if any(e["format_version"] != FORMAT_VERSION for e in known):
        raise ValueError(f"log format other than {FORMAT_VERSION} under {root}")
    full = max(e["version"] for e in known if e["kind"] == "full")
    since = [e for e in known if e["version"] >= full]
    fs, folder = _fs(spark, since[0]["data"])
    if not fs.exists(folder):
        raise FileNotFoundError(f"version {version} was retired from {root}")
    nodes = _read(spark, since, "nodes", _NODE).select("title")
    edges = _read(spark, since, "edges", _EDGE)
    deltas = [e for e in since if e["kind"] == "delta" and e["tombstones"]]
    if not deltas:
        return nodes, edges.select("src", "dst", "late")
    last = _read(spark, deltas, "tombs", _TOMB).groupBy(F.col("title").alias("_t")).agg(F.max("version").alias("_v"))
    kept = edges.join(last, F.col("src") == F.col("_t"), "left").where(F.col("_v").isNull() | (F.col("version") >= F.col("_v")))
    return nodes, kept.select("src", "dst", "late")


def read(spark: SparkSession, root: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A5: (nodes, edges) of a version, the latest by default; both distinct."""
    nodes, edges = _merged(spark, root, version)
    late = edges.where("late").select(F.explode(F.array("src", "dst")).alias("title"))
    return nodes.unionByName(late).distinct(), edges.select("src", "dst").distinct()


def fold(spark: SparkSession, root: str) -> dict:
    """Commit the latest version once more as a full one, so that reads merge fewer deltas."""
    nodes, edges = _merged(spark, root, None)
    return _write(spark, root, "full", nodes.distinct(), edges.groupBy("src", "dst").agg(F.min("late").alias("late")), None)


def retire(spark: SparkSession, root: str, keep_full: int = 2) -> int:
    """Delete the data of versions before the last ``keep_full`` full ones; returns how many lost theirs."""
    known = versions(spark, root)
    full = [e["version"] for e in known if e["kind"] == "full"]
    if len(full) <= keep_full:
        return 0
    old = [e for e in known if e["version"] < full[-keep_full]]
    gone = 0
    for e in old:
        fs, folder = _fs(spark, e["data"])
        gone += int(bool(fs.exists(folder)) and bool(fs.delete(folder, True)))
    return gone
