from __future__ import annotations

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from sparkscour.llm import mixing, sharding
from sparkscour.llm.queries import ORACLE_SQL, QUERIES


def waterfill(sizes: dict, weights=(5, 2, 1), cap=3) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > cap * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        open_ -= full
    return target


def check_mix(rows):
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    target = waterfill(dict(sizes))
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(target[s]) for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= max(r.size for r in own) / 2 + 1e-6
        assert all(r.taken <= 3 * r.size and r.taken == r.reps * r.size for r in own)


def test_op8_equals_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{data}/documents.parquet')")
    want = sorted(con.sql(ORACLE_SQL["op8_mixing"]).fetchall())
    got = QUERIES["op8_mixing"](spark, data)
    assert sorted(tuple(r) for r in got.select("doc_id", "size", "source_size", "target", "taken").collect()) == want


def test_mix_of_odd_rows(spark, odd_docs, no_docs):
    out = mixing.mix(odd_docs, keep_row=True).select("row.source", "doc_id", "size", "source_size", "target", "reps", "taken").collect()
    assert len(out) == 12
    check_mix(out)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(odd_docs.repartition(5), keep_row=True).select("row.source", "doc_id", "size", "source_size", "target", "reps", "taken").collect()))
    assert mixing.mix(no_docs).collect() == []
    whole = mixing.mixed(odd_docs)
    assert whole.columns == odd_docs.columns and whole.count() == sum(r.reps for r in out)


def test_mix_caps_and_ties(spark):
    rows = [(i, "w " * (1 + i % 7), "big") for i in range(400)] + [(1000 + i, "w w", "small") for i in range(5)] + [(2000, "w", None), (3000, "", "none")] + [(7, "a b c", "same")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, keep_row=True).select("row.source", "size", "source_size", "target", "reps", "taken").collect()
    check_mix(out)
    capped = {r.source for r in out if r.target == 3.0 * r.source_size}
    assert {"small", "none"} <= capped


def test_jump_is_consistent():
    keys = np.random.default_rng(3).integers(0, 2**63, 20_000).astype(np.uint64)
    before = sharding.jump(keys, 1)
    assert not before.any()
    for n in range(1, 20):
        after = sharding.jump(keys, n + 1)
        moved = after != before
        assert (after[moved] == n).all() and abs(moved.mean() - 1 / (n + 1)) < 0.02
        before = after
    # published algorithm, one key at a time
    for key in keys[:200].tolist():
        b, j, k = -1, 0, key
        while j < 20:
            b = j
            k = (k * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / float((k >> 33) + 1)))
        assert sharding.jump(np.array([key], np.uint64), 20)[0] == b


def test_op5(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = QUERIES["op5_sharding"](spark, data).collect()
    assert {r.doc_id: (r.size, r.text_crc32, r.law) for r in got} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode()), "key") for i, t in docs.items()}
    def naive(doc_id, shards):
        b, j, k = -1, 0, xxhash.xxh64_intdigest(str(doc_id))
        while j < shards:
            b, k = j, (k * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * ((1 << 31) / ((k >> 33) + 1)))
        return b

    assert {r.doc_id: (r.shard, r.grown_shard) for r in got} == {i: (naive(i, 8), naive(i, 9)) for i in docs}
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 8) for r in got) and {r.grown_shard for r in got} == set(range(9))


def test_many_rows_alike_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    docs = spark.createDataFrame([(1, "same")] * 50 + [(2, "b")] * 7 + [(None, "same")] * 8, "doc_id long, text string")
    got = sharding.numbered(docs).collect()
    assert len(got) == 65
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_sharding_of_odd_rows(odd_docs, no_docs):
    got = sharding.numbered(odd_docs).collect()
    assert len(got) == 12 and len({(r.shard, r.slot) for r in got}) == 12
    assert len({r.shard for r in got if r.doc_id == 9}) == 1
    assert {r.size for r in got if r.doc_id in (3, 4)} == {1}
    assert sharding.numbered(no_docs).collect() == []
    rows = sharding.sharded(odd_docs)
    assert rows.count() == 12 and set(rows.columns) == {*odd_docs.columns, "size", "text_crc32", "law", "shard", "grown_shard"}
