"""Every registered query of the text-cleaning operators, against its SQL."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from sparkscour.plans import oracle

QUERIES, SQL = oracle.QUERIES, oracle.ORACLE_SQL


@pytest.fixture(scope="module")
def tables(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.sql(f"create view {name.split('.')[0]} as select * from read_parquet('{data}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, tables, name):
    want, got = tables.sql(SQL[name]).df(), QUERIES[name](spark, data).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).values.tolist()))
    assert rows(got) == rows(want)
    if name.startswith("rule_"):
        assert got.n.sum() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    rows = QUERIES[name](spark, data)
    assert rows.count() > 0 and len(set(rows.columns)) == len(rows.columns)
    if name.startswith("rule_"):
        assert rows.agg({"n": "sum"}).first()[0] > 0


def test_own_rule_beside_digits(spark, tmp_path):
    texts = ["4e2a a at", "is is5 x_be be", "ha ha ha ha7 ha", "the2 the the theme", "no no-no no"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = dict(con.sql(SQL["own_rule"]).fetchall())
    assert want[0] == 1 and {r.doc_id: r.n for r in QUERIES["own_rule"](spark, str(tmp_path)).collect()} == want


def test_changes_of_long_texts(spark, tmp_path):
    texts = ["One word and more. Then the next line\n" * 25_000 + "End", "short. One", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.sql(SQL["changes"]).fetchall())
    assert len(texts[0]) > 800_000 and want[0][1] == 75_001 and sorted(map(tuple, QUERIES["changes"](spark, str(tmp_path)).collect())) == want


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.count() == 200 and "signals_per_1k" in rows.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
