"""The registered queries against their SQL, and those without SQL against brute force."""

import os
import sys

import duckdb
import pytest
from brute import near, suffixes

from textmill import llm

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
from oracle_check import TABLES, kinds, rows  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = llm.QUERIES[name](spark, SF).toPandas(), con.execute(llm.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert kinds(got) == kinds(want)
    assert rows(got) == rows(want)


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_op6(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in llm.QUERIES["op6_suffix_dedup"](spark, SF).collect()}
    assert got == suffixes(documents(spark))


def test_op9(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in llm.QUERIES["op9_ngram_join"](spark, SF).collect()}
    assert got == near(documents(spark))


def test_op5_near_targets(spark):
    got = llm.QUERIES["op5_mixing"](spark, SF).toPandas()
    assert len(got) == len(documents(spark))
    for _, g in got.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max()
        assert (g["taken"] <= 3 * g["size"]).all()
