"""Every registered query against its DuckDB oracle on the smallest fixture (sf0.001)."""

import os
import re
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import TABLES, kinds, rows  # noqa: E402

SF = "/root/testdata/sf0.001"
# those of the corpus subpackage have tests of their own
NAMES = sorted(n for n in E.queries() if not re.match(r"op\d+_|pipeline$", n))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", [n for n in NAMES if n in E.oracle_sql()])
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert kinds(got) == kinds(want)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n in NAMES if n not in E.oracle_sql()])
def test_rows_only_queries_run(spark, name):
    got = E.queries()[name](spark, SF).toPandas()
    assert len(got) and not got.isna().all().any()


@pytest.mark.parametrize("name", ["weighted_interleave", "sort_runs", "char_budget_sample", "train_time_eta", "chunk_flat"])
def test_result_independent_of_partition_count(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(rows(E.queries()[name](spark, SF).toPandas()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_entry(spark):
    df = E.entry(spark)
    assert set(df.columns) >= {"source", "n_draws", "share", "target_share"}
    assert df.count() > 0
