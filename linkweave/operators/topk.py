"""Per-group top-k that never sorts a whole (possibly huge) group in one task.

Stage 1 ranks inside ``(group, salt)`` sub-groups, where the salt is a hash of
the row's tie-break columns, and keeps at most ``k`` rows of each.  Stage 2
ranks the surviving ``<= salts * k`` rows per group.  The result equals a plain
``row_number() <= k`` over the group because every row of the global top-k is
also in the top-k of its own sub-group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    k: int,
    salt_cols: list[str] | None = None,
    salts: int | None = None,
    rank_col: str | None = None,
) -> DataFrame:
    cols = df.columns
    if salts is None:  # grows with the cluster
        salts = max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if salts > 1:
        salt_src = salt_cols or cols
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_src), F.lit(salts)))
        w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
        df = (
            salted.withColumn("_r1", F.row_number().over(w1))
            .where(F.col("_r1") <= k)
            .select(*cols)
        )
    w2 = Window.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(w2)).where(F.col("_rank") <= k)
    if rank_col:
        return ranked.withColumnRenamed("_rank", rank_col)
    return ranked.drop("_rank")
