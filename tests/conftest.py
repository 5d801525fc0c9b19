import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from linkweave.session import get_spark

    os.environ.setdefault("LINKWEAVE_DRIVER_MEMORY", "8g")
    s = get_spark("*", shuffle_partitions=8)
    yield s
    s.stop()


def edges_df(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def queries_df(spark, rows):
    return spark.createDataFrame(rows, "query_id long, `from` string, `to` string, max_depth int")
