"""Every registered query against its DuckDB oracle on the smallest scale.

Also checks the entry contract and a plan property: no registered query plans
a Cartesian product.
"""

import pytest
from conftest import SMOKE_DIR

import __spark_entry__ as E
from tools.compare import digest, duck

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMOKE_DIR)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "path" in df.columns


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SMOKE_DIR)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLES[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert len(srows) == len(drows)
    assert digest(df.columns, srows) == digest(dcols, drows)
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SMOKE_DIR)
    assert df.count() >= 0
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j1_graph_edges", "g3_degrees", "a8_export_edges", "f6_out_links", "s8_embedding_text"])
def test_no_cartesian_product(spark, name):
    plan = QUERIES[name](spark, SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
