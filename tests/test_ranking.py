"""Dense ids at a size where range bounds are sampled, and ranks inside groups."""

from pyspark.sql import functions as F

from linkweave.operators.maintain import dense_ids
from linkweave.operators.ranking import dense_rank_table


def test_dense_ids_are_unique_and_dense_on_many_titles(spark):
    n = 1_200_000
    df = spark.range(n).select(F.md5(F.col("id").cast("string")).alias("title"), F.lit(10).alias("b"))
    got = dense_ids(df, ["title"], F.col("b")).agg(F.count("*"), F.countDistinct("id"), F.min("id"), F.max("id")).first()
    assert tuple(got) == (n, n, 11, 10 + n)


def test_ranks_inside_groups_with_ties_and_nulls(spark):
    rows = [("a", 2), ("a", 1), ("a", 1), ("b", None), ("b", 3), (None, 5), (None, 4)]
    out = dense_rank_table(spark.createDataFrame(rows, "g string, v int"), ["v"], ["g"], "r").collect()
    by = {}
    for g, v, r in out:
        by.setdefault(g, []).append((r, v))
    assert {g: [x[1] for x in sorted(v)] for g, v in by.items()} == {"a": [1, 1, 2], "b": [None, 3], None: [4, 5]}
    assert all(sorted(x[0] for x in v) == list(range(len(v))) for v in by.values())
    assert dense_rank_table(spark.createDataFrame([], "g string, v int"), ["v"], ["g"], "r").count() == 0
