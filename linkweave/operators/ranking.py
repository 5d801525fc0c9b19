"""Dense ranks over a distributed order, without a single-partition window.

``dense_rank_table`` sorts by range, fixes that order once with a checkpoint and
derives every rank from the fixed rows: position inside the partition plus the
number of rows of the same group in earlier partitions.  Deriving both sides
from one materialised frame matters: a range sort samples its bounds, so two
evaluations of the same plan may cut the order at different places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.session import checkpoint_dir

_ROW_BITS = 33  # monotonically_increasing_id: partition << 33 | row


def dense_rank_table(df: DataFrame, order: list[str], within: list[str] | None = None, name: str = "rank", size: str | None = None) -> DataFrame:
    """``df`` plus ``name``: 0-based, gapless rank by ``order`` inside each ``within`` group.

    With ``size`` a column of that name holds the number of rows of the group.

    Ties in ``order`` get distinct consecutive ranks.  Add a column that tells
    equal rows apart to ``order`` if many rows can tie, so that they can be cut
    into several partitions.  Null keys form a group of their own and sort first.
    """
    within = within or []
    spark = df.sparkSession
    checkpoint_dir(spark)
    keys = [*within, *order]
    ranged = (
        df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_pid", F.shiftright("_mid", _ROW_BITS))
        .checkpoint()
    )
    stats = ranged.groupBy(*within, "_pid").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # One row per partition and group touched there: as small as partitions + groups.
    before = Window.partitionBy(*within).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    stats = stats.withColumn("_size", F.sum("_n").over(Window.partitionBy(*within)))
    stats = stats.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(within)], F.col("_pid").alias("_p"), "_first", "_base", "_size")
    cond = ranged["_pid"] == stats["_p"]
    for i, c in enumerate(within):
        cond = cond & ranged[c].eqNullSafe(stats[f"_k{i}"])
    out = ranged.join(stats, cond)
    extra = [stats["_size"].alias(size)] if size else []
    return out.select(*[ranged[c] for c in df.columns], (ranged["_mid"] - stats["_first"] + stats["_base"]).alias(name), *extra)
