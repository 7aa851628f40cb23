"""Exact and near duplicates, and their components."""

from __future__ import annotations

import hashlib
import os
import re
import time

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkscour.llm import exact_dedup, simhash
from sparkscour.llm.components import components
from sparkscour.llm.queries import QUERIES
from sparkscour.llm.simhash_kernel import simhash as kernel


def plain_fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(values: list[int], linked) -> dict[int, int]:
    at = {v: v for v in values}
    for i, a in enumerate(values):
        for b in values[:i]:
            if linked(a, b):
                old, new = at[a], at[b]
                at = {k: new if v == old else v for k, v in at.items()}
    return at


@given(st.text(max_size=80))
@settings(max_examples=200, deadline=None)
def test_kernel(text):
    assert kernel(text.encode("utf-8", "surrogatepass") if not any("\ud800" <= c <= "\udfff" for c in text) else b"") == (plain_fingerprint(text) if not any("\ud800" <= c <= "\udfff" for c in text) else 0)


def test_embedding_bounds_hamming(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(a) ^ int(sum(1 << int(i) for i in rng.choice(64, k, replace=False)))) for k in range(65) for a in rng.integers(0, 2**63, 4)]
    signed = [tuple(x - 2**64 if x >> 63 else x for x in p) for p in pairs]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(signed, "a long, b long")
    got = df.select(simhash.manhattan(simhash.embedding(F.col("a")), simhash.embedding(F.col("b"))).alias("m"), F.bit_count(F.expr("a ^ b")).alias("h"), "a", "b").collect()
    for r in got:
        counts = [[(x >> 2 * i & 1) + (x >> 2 * i + 1 & 1) for i in range(32)] for x in (r.a, r.b)]
        assert r.m == sum(abs(x - y) for x, y in zip(*counts, strict=True)) <= r.h


@pytest.mark.parametrize("small, broadcast", [(simhash.SMALL_CELL, simhash.MAX_BROADCAST), (2, simhash.MAX_BROADCAST), (1, 0)])
def test_dense_groups_lose_no_link(spark, monkeypatch, small, broadcast):
    """Chains and balls of fingerprints, many in one cell, against all pairs."""
    monkeypatch.setattr(simhash, "SMALL_CELL", small)
    monkeypatch.setattr(simhash, "MAX_BROADCAST", broadcast)
    rng = np.random.default_rng(7)
    values = set()
    for centre in rng.integers(0, 2**64, 6, dtype=np.uint64).tolist():
        for _ in range(60):
            values.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)))
    values = sorted(x - 2**64 if x >> 63 else x for x in values)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    found = {r.node: r.component for r in components(simhash.links(fps)).collect()}
    want = roots(values, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    groups = lambda m: sorted(sorted(v for v in values if m.get(v, v) == r) for r in {m.get(v, v) for v in values})
    assert groups(found) == groups(want)


@pytest.mark.parametrize("small", [simhash.SMALL_CELL, 4])
def test_one_crowded_cell(spark, monkeypatch, small):
    """Hundreds of fingerprints that share 40 bits and differ at random in the others, so that few of one cell are linked."""
    monkeypatch.setattr(simhash, "SMALL_CELL", small)
    rng = np.random.default_rng(11)
    values = sorted({int(x) << 40 | 0xABCDE12345 for x in rng.integers(0, 1 << 23, 400)} | {(1 << 30 | int(x) << 8 | 7) for x in rng.integers(0, 1 << 8, 40)})
    found = {r.node: r.component for r in components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))).collect()}
    want = roots(values, lambda a, b: (a ^ b).bit_count() <= 4)
    groups = lambda m: sorted(sorted(v for v in values if m.get(v, v) == r) for r in {m.get(v, v) for v in values})
    assert groups(found) == groups(want) and 1 < len(groups(want)) < len(values)


def test_few_candidates_beside_cells(spark):
    """Random fingerprints meet in hardly any of their 70 cells."""
    counts = {}
    for n in (10_000, 40_000):
        fps = spark.range(n).selectExpr("xxhash64(id) AS fp")
        cells = simhash._cells(fps).groupBy("cell").count().where("count > 1")
        counts[n] = cells.selectExpr("coalesce(sum(count * (count - 1) / 2), 0)").first()[0]
    assert counts[10_000] <= 20 and counts[40_000] <= 100


def test_crossed_embedding(spark):
    from pyspark.sql import functions as F

    values = [int(x) - 2**63 for x in np.random.default_rng(5).integers(0, 2**63, 50)]
    for r in spark.createDataFrame([(v,) for v in values], "v long").select("v", simhash.embedding(simhash.crossed(F.col("v"))).alias("e")).collect():
        bit = lambda i, v=r.v: v >> i & 1
        want = [bit(4 * q + i) + bit(4 * q + i + 2) for q in range(16) for i in (0, 1)]
        assert [(r.e >> 2 * i & 3) for i in range(32)] == want


def test_hot_star(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 3000)] + [(5000, i) for i in range(2500, 4000)] + [(9001, 9000)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(4000)} | {5000: 0, 9000: 9000, 9001: 9000}


def test_components_of_a_chain_and_none(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5)], "u long, v long")
    got = {r.node: r.component for r in components(chain).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components(chain.where("false")).collect() == []


def test_op10_against_brute_force(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    fps = {i: plain_fingerprint(t) for i, t in docs.items()}
    want = roots(sorted(docs), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op10_simhash"](spark, data).collect()}
    assert got == {i: (f"{fps[i]:016x}", min(j for j in docs if want[j] == want[i])) for i in docs}


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == 12
    blank = [r for r in got if r.fp == 0]
    assert {r.doc_id for r in blank} == {3, 4, 5, None} and {r.component_id for r in blank} == {3}
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    assert simhash.near_duplicates(no_docs).collect() == []
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 1, 3, 7, 8, 9, 9]
    assert simhash.keep_one(no_docs).collect() == []


def test_op2_keeps_state_between_runs(spark, tmp_path, odd_docs, no_docs):
    source, state = str(tmp_path / "in"), (tmp_path / "state").as_uri()
    odd_docs.repartition(1).write.parquet(source)
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    rows = [(r.doc_id, normal(r.text)) for r in odd_docs.collect()]

    def check(got, rows):
        assert len(got) == len(rows)
        for r in got:
            same = [(i, t) for i, t in rows if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256]
            assert r.group_size == len(same) and r.keep_id == min((i for i, _ in same if i is not None), default=None)
        for h in {r.text_sha256 for r in got}:
            assert [r.doc_id for r in got if r.text_sha256 == h and r.kept] == [next(r.keep_id for r in got if r.text_sha256 == h)]

    check(exact_dedup.exact_duplicates(spark, source, state).collect(), rows)
    spark.createDataFrame([(0, "Another text  with the same id."), (50, "new")], "doc_id long, text string").repartition(1).write.mode("append").parquet(source)
    rows += [(0, "Another text with the same id."), (50, "new")]
    groups = {r.digest: r for r in exact_dedup.groups(spark, source, state).collect()}
    again = groups[hashlib.sha256(b"Another text with the same id.").hexdigest()]
    assert (again.keep_id, again.group_size) == (0, 2)
    check(exact_dedup.exact_duplicates(spark, source, state).collect(), rows)
    empty = str(tmp_path / "empty")
    no_docs.write.parquet(empty)
    assert exact_dedup.exact_duplicates(spark, empty).collect() == []


def test_op2_reads_old_files(spark, tmp_path):
    source, state = tmp_path / "in", (tmp_path / "state").as_uri()
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    docs((1, "one"), (2, "two")).write.parquet(str(source))
    assert len(exact_dedup.exact_duplicates(spark, str(source), state).collect()) == 2
    before = set(source.glob("*.parquet"))
    docs((3, "three"), (4, "one")).write.mode("append").parquet(str(source))
    for file in set(source.glob("*.parquet")) - before:
        os.utime(file, (time.time() - 30 * 86400,) * 2)
    got = exact_dedup.exact_duplicates(spark, str(source), state).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(1, 1, 2), (2, 2, 1), (3, 3, 1), (4, 1, 2)]


def test_op2_tells_of_a_text_that_the_state_lacks(spark, tmp_path, monkeypatch):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string").write.parquet(source)
    whole = exact_dedup.groups
    monkeypatch.setattr(exact_dedup, "groups", lambda *a: whole(*a).where("keep_id = 1"))
    with pytest.raises(Exception, match="the state lacks a text of"):
        exact_dedup.exact_duplicates(spark, source).collect()


def test_op2_in_small_batches(spark, tmp_path, data):
    source = str(tmp_path / "in")
    spark.read.parquet(f"{data}/documents.parquet").repartition(6).write.parquet(source)
    whole = {r.digest: (r.keep_id, r.group_size) for r in exact_dedup.groups(spark, source).collect()}
    parts = {r.digest: (r.keep_id, r.group_size) for r in exact_dedup.groups(spark, source, files_per_batch=1).collect()}
    assert whole == parts and len(whole) < 200


def test_op2_keeps_texts_apart_that_share_a_digest(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "digest", lambda text: F.sha2(F.length(text).cast("string"), 256))
    source = str(tmp_path / "in")
    spark.createDataFrame([(5, "abc"), (1, "abd"), (2, "abc"), (3, "xyz"), (None, "xyz"), (4, "longer")], "doc_id long, text string").write.parquet(source)
    got = exact_dedup.exact_duplicates(spark, source).collect()
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in got) == [(0, 3, 2, False), (1, 1, 1, True), (2, 2, 2, True), (3, 3, 2, True), (4, 4, 1, True), (5, 2, 2, False)]


def test_op2_follows_the_locator_to_files_that_left_the_source(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "digest", lambda text: F.sha2(F.length(text).cast("string"), 256))
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    state = (tmp_path / "state").as_uri()
    docs((1, "one")).write.parquet(str(tmp_path / "a"))
    exact_dedup.exact_duplicates(spark, str(tmp_path / "a"), state).collect()
    first = exact_dedup.groups(spark, str(tmp_path / "a"), state)
    docs((2, "two")).write.parquet(str(tmp_path / "b"))
    found = first.unionByName(first).groupBy("digest").agg(F.first("keep_id").alias("keep_id"), F.first("keep_file").alias("keep_file"), F.first("keep_row").alias("keep_row"), F.lit(2).cast("long").alias("group_size"))
    assert [r.digest for r in exact_dedup._differing(spark, str(tmp_path / "b"), found, "text").collect()] == [hashlib.sha256(b"3").hexdigest()]
    assert exact_dedup._differing(spark, str(tmp_path / "a"), found, "text").collect() == []
