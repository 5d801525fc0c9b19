"""Graph export (A7-A10) with verification (G4) and run statistics.

The reference pushes nodes and edges to an external property graph in
batches; here the sink is any Spark writer (parquet by default).  Semantics
kept: nodes are success pages; an edge lands only if both ends are nodes;
duplicates merge; counts are reported as *submitted* and as *landed*.
What lands is counted on the write itself through ``Observation``.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from linkweave.operators import graph as G
from linkweave.session import checkpoint_dir
from linkweave.sources import schemas as S


def export_nodes(pages: DataFrame) -> DataFrame:
    """Titles of success pages, distinct."""
    return G.success_pages(pages).select("title").distinct()


def export_edges(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Edges of success sources whose two ends are nodes, distinct."""
    return G.closed_edges(G.graph_edges(pages, links), pages).distinct()


def _write(df: DataFrame, path: str | None, fmt: str) -> int:
    """Merge rows into the sink: those it already holds are not written again; returns rows landed."""
    spark = df.sparkSession
    obs, rows = Observation(), df
    if path is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            rows = df.join(spark.read.format(fmt).schema(df.schema).load(path), df.columns, "left_anti")
    # Counted where it lands: after what the sink already holds has gone.
    landing = rows.observe(obs, F.count(F.lit(1)).alias("n"))
    if path is None:
        landing.write.format("noop").mode("overwrite").save()
    else:
        landing.write.mode("append").format(fmt).save(path)
    return int(obs.get["n"])


def full_export(
    pages: DataFrame, links: DataFrame, sink: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    """A9 + G7: nodes then edges; one row of submitted/landed counts, duration and rates."""
    spark = pages.sparkSession
    t0 = time.perf_counter()
    submitted_edges = G.graph_edges(pages, links)
    # Counted by themselves: an export that lands nothing may skip reading its input.
    nodes_submitted = pages.where(F.col("fetch_status") == S.STATUS_SUCCESS).count()
    edges_submitted = submitted_edges.count()
    landed_nodes = _write(export_nodes(pages), None if sink is None else f"{sink}/nodes", fmt)
    edges = G.closed_edges(submitted_edges, pages).distinct()
    landed_edges = _write(edges, None if sink is None else f"{sink}/edges", fmt)
    secs = time.perf_counter() - t0
    row = {
        "nodes_submitted": nodes_submitted,
        "edges_submitted": edges_submitted,
        "nodes_landed": landed_nodes,
        "edges_landed": landed_edges,
        "duration_sec": round(secs, 3),
        "nodes_per_sec": round(landed_nodes / secs, 1) if secs > 0 else None,
        "edges_per_sec": round(landed_edges / secs, 1) if secs > 0 else None,
    }
    return spark.createDataFrame([row])


def delta_export(
    pages: DataFrame, links: DataFrame, since, mode: str = "literal"
) -> tuple[DataFrame, DataFrame]:
    """A10: additions since ``since``; never deletes.

    ``literal``: success pages created after ``since`` and edges of links
    created after it (a page fetched after being discovered earlier is missed,
    as in the reference).  ``strict``: pages *updated* after ``since`` and every
    current edge of those sources as well.
    """
    ts = F.lit(since).cast("timestamp_ntz")
    ok = G.success_pages(pages)
    if mode == "literal":
        new_nodes = ok.where(F.col("created_at") > ts).select("title").distinct()
        new_links = links.where(F.col("created_at") > ts)
    elif mode == "strict":
        changed = ok.where(F.col("updated_at") > ts)
        new_nodes = changed.select("title").distinct()
        new_links = links.where(F.col("created_at") > ts).unionByName(
            links.join(changed.select(F.col("id").alias("source_id")), "source_id", "left_semi")
        )
    else:
        raise ValueError(f"mode must be literal or strict, not {mode!r}")
    new_edges = G.closed_edges(G.graph_edges(pages, new_links), pages).distinct()
    return new_nodes, new_edges


DIGEST_RANGES = 4096


def _digests(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(range, n, mixed, total) per range of the key hash: equal rows in equal numbers give equal digests."""
    h = F.xxhash64(*keys)
    ranged = rows.select(F.shiftrightunsigned(h, 52).cast("int").alias("range"), F.xxhash64(h, *keys).alias("h"))
    return ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("mixed"), F.sum(F.col("h").cast("decimal(20,0)")).alias("total"))


def compare_rows(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """One row (expected, actual, missing, extra): row counts of both sides, and rows that only one of them has.

    Each side is read once for the digests of ``DIGEST_RANGES`` hash ranges (a
    count, a xor and a sum of 64-bit hashes); only the ranges that differ are
    read again, row by row.  Repeated rows count as often as they occur.
    """
    spark = expected.sparkSession
    checkpoint_dir(spark)
    a, b = _digests(expected, keys), _digests(actual, keys)
    both = a.join(b.select(F.col("range").alias("r2"), F.col("n").alias("n2"), F.col("mixed").alias("m2"), F.col("total").alias("t2")), F.col("range") == F.col("r2"), "full")
    same = F.col("n").eqNullSafe(F.col("n2")) & F.col("mixed").eqNullSafe(F.col("m2")) & F.col("total").eqNullSafe(F.col("t2"))
    ranges = both.select(F.coalesce("range", "r2").alias("range"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n2", F.lit(0)).alias("n2"), same.alias("same")).checkpoint()  # at most DIGEST_RANGES rows
    counts = ranges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("expected"), F.coalesce(F.sum("n2"), F.lit(0)).alias("actual"))
    differing = ranges.where("NOT same").select("range")
    zero = F.lit(0).cast("long")
    if differing.isEmpty():
        return counts.select("expected", "actual", zero.alias("missing"), zero.alias("extra"))

    def rows_of(side: DataFrame, sign: int) -> DataFrame:
        ranged = side.select(*keys, F.shiftrightunsigned(F.xxhash64(*keys), 52).cast("int").alias("range"))
        return ranged.join(F.broadcast(differing), "range", "left_semi").select(*keys, F.lit(sign).cast("long").alias("sign"))

    off = rows_of(expected, 1).unionByName(rows_of(actual, -1)).groupBy(*keys).agg(F.sum("sign").alias("off"))
    off = off.agg(F.coalesce(F.sum(F.greatest("off", zero)), zero).alias("missing"), F.coalesce(F.sum(F.greatest(-F.col("off"), zero)), zero).alias("extra"))
    return counts.crossJoin(off)  # one row each


def verify_export(
    pages: DataFrame, links: DataFrame, exported_nodes: DataFrame, exported_edges: DataFrame
) -> DataFrame:
    """One row per check ``(check, expected, actual, ok)``.

    ``literal`` checks compare with all success pages and *all* links, as the
    reference does (so they flag false alarms); ``strict`` checks compare with
    what an export should contain and count rows missing or extra both ways
    (:func:`compare_rows`).
    """
    nodes = compare_rows(export_nodes(pages), exported_nodes, ["title"])
    edges = compare_rows(export_edges(pages, links), exported_edges, ["src", "dst"])
    n_success = G.success_pages(pages).agg(F.count(F.lit(1)).alias("success"))
    n_links = links.agg(F.count(F.lit(1)).alias("links"))
    one = nodes.select(F.col("actual").alias("nodes"), F.col("missing").alias("lost_nodes"), F.col("extra").alias("new_nodes")).crossJoin(
        edges.select(F.col("expected").alias("wanted"), F.col("actual").alias("edges"), F.col("missing").alias("lost_edges"), F.col("extra").alias("new_edges"))
    ).crossJoin(n_success).crossJoin(n_links)  # one row each
    zero = F.lit(0).cast("long")
    checks = [
        ("literal_nodes", F.col("success"), F.col("nodes")),
        ("literal_edges", F.col("links"), F.col("edges")),
        ("strict_edges", F.col("wanted"), F.col("edges")),
        ("strict_missing_nodes", zero, F.col("lost_nodes")),
        ("strict_extra_nodes", zero, F.col("new_nodes")),
        ("strict_missing_edges", zero, F.col("lost_edges")),
        ("strict_extra_edges", zero, F.col("new_edges")),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("check"), e.alias("expected"), a.alias("actual"), (e == a).alias("ok")) for n, e, a in checks])
    return one.select(F.explode(rows).alias("r")).select("r.*")
