from __future__ import annotations

import weakref
from pathlib import Path
from types import SimpleNamespace
from urllib.parse import urlparse

import pytest

from sparkscour.llm import common


def test_hot_keys_join_like_others(spark):
    rows = spark.createDataFrame([(1, i) for i in range(300)] + [(2, i) for i in range(40)] + [(3, 0), (None, 1), (9, 1)], "key int, x int")
    facts = spark.createDataFrame([(1, "hot", 300), (2, "cold", 40), (3, "one", 1), (4, "none", 0)], "key int, name string, n long")
    got = common.joined(rows, facts, "key", "n", 343)
    assert sorted(got.columns) == ["key", "name", "x"]
    want = rows.join(facts.drop("n"), "key")
    assert sorted(map(tuple, got.select("key", "x", "name").collect())) == sorted(map(tuple, want.select("key", "x", "name").collect()))
    assert common.joined(rows.where("false"), facts, "key", "n", 0).collect() == []


def test_intermediate_tables_are_removed(spark):
    table = common.written(spark.range(3).toDF("x"), "some")
    folder = Path(urlparse(table.scratch_path).path)
    assert folder.is_dir() and folder.parent.name == spark.sparkContext.applicationId and table.count() == 3
    common.discard(table)
    assert not folder.exists()
    other = Path(urlparse(common.written(spark.range(3).toDF("x"), "some").scratch_path).path)
    common.clear(spark)
    assert not other.exists()


def test_a_cluster_needs_a_shared_folder(spark):
    sc = spark.sparkContext
    conf = {}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__), sparkContext=SimpleNamespace(master="spark://h:1", applicationId="app-1", _jvm=sc._jvm, _jsc=sc._jsc))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch(session, "x")
    conf["spark.checkpoint.dir"] = "hdfs://n/shared/"
    assert common.scratch(session, "x").startswith("hdfs://n/shared/app-1/x-")
    conf.clear()
    session.sparkContext.master = "local[4]"
    assert common.scratch(session, "x").startswith("file:///")


def test_freed_collects_and_stages_call_it(spark, monkeypatch):
    import corpus_pipeline

    class Held:
        pass

    held = Held()
    held.itself, gone = held, weakref.ref(held)
    del held
    common.freed(spark)
    assert gone() is None
    calls = []
    monkeypatch.setattr(corpus_pipeline, "freed", calls.append)
    docs = spark.createDataFrame([(i, "some words " * 9 + str(i), "en", "a") for i in range(3)], "doc_id long, text string, lang string, source string")
    for module, name in (("langid", "recognised"), ("simhash", "keep_one"), ("decontamination", "clean"), ("mixing", "mixed"), ("sharding", "sharded")):
        monkeypatch.setattr(getattr(corpus_pipeline, module), name, lambda docs, *_: docs)
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: docs)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "")
    assert calls == [spark] * len(corpus_pipeline.STAGES)
