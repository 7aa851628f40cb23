from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from sparkscour.llm import decontamination, langid, mixing, simhash
from sparkscour.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_sql(spark, data, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.sql(f"create view {table} as select * from read_parquet('{data}/{table}.parquet')")
    want = con.sql(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, data).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).values.tolist()))
    assert rows(got) == rows(want)


def test_each_stage_against_its_operator(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        rows = after.collect()
        if name != "sharding":
            assert after.columns == columns
        if name == "language_id":
            found = {r.doc_id: r.lang_pred for r in langid.identified(docs).collect()}
            assert sorted(r.doc_id for r in rows) == sorted(i for i, lang in found.items() if lang != "und")
        elif name == "near_dedup":
            found = simhash.near_duplicates(docs).collect()
            assert sorted(r.doc_id for r in rows) == sorted({r.component_id for r in found})
        elif name == "decontamination":
            bad = {r.doc_id for r in decontamination.contamination(docs, spark.read.parquet(f"{data}/benchmark.parquet")).collect() if r.contaminated}
            assert bad and sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in before if r.doc_id not in bad)
        elif name == "mixing":
            reps = {r.doc_id: r.reps for r in mixing.mix(docs).collect()}
            assert sorted(r.doc_id for r in rows) == sorted(i for i, n in reps.items() for _ in range(n))
        else:
            assert len(rows) == len(before) and {r.shard for r in rows} == set(range(8))
            assert all(r.grown_shard in (r.shard, 8) for r in rows)
        docs = after
    assert corpus_pipeline.run(spark, data).count() == docs.count()


def test_stages_take_odd_and_no_rows(spark, odd_docs, no_docs, data):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, data)
            docs.collect()
