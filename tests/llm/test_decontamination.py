from __future__ import annotations

import hashlib
import re

import pytest

from sparkscour.llm import decontamination
from sparkscour.llm.queries import QUERIES


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, named = words(text), set(), set()
        for item, t in items:
            iw = words(t)
            n = min(10, len(iw))
            for win in {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if iw and item is not None else ():
                for p in range(len(w) - n + 1):
                    if tuple(w[p : p + n]) == win:
                        hit.update(range(p, p + n))
                        named.add(str(item))
        out.append((doc_id, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_op1_against_brute_force(spark, data):
    read = lambda t, i: [tuple(r) for r in spark.read.parquet(f"{data}/{t}.parquet").select(i, "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op1_decontamination"](spark, data).collect()), key=str)
    want = brute(read("documents", "doc_id"), read("benchmark", "item_id"))
    assert got == want and any(r[-1] for r in want)


def run(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contamination(docs, items).collect()
    kept = decontamination.clean(docs, items).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r.items).encode()).hexdigest(), r.contaminated) for r in found), key=str), kept


def test_short_items_repeats_and_nulls(spark):
    ten = "one two three four five six seven eight nine ten"
    docs = [(1, f"x {ten} eleven y"), (2, "The CAT, sat"), (3, None), (4, ""), (5, "a a a a a a a a a a a a"), (None, "cat sat"), (6, ten), (6, "no match here"), (7, "É é K k"), (8, ten + " " + ten)]
    items = [(10, ten), (9, f"{ten} eleven"), (11, "cat sat"), (11, "cat sat"), (12, None), (13, "!!"), (None, "one"), (14, "a a a a a a a a a a a"), (15, "é k")]
    got, kept = run(spark, docs, items)
    assert got == brute(docs, items)
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id) == [(3, None), (4, ""), (6, "no match here"), *([] if any(r[0] == 7 and r[-1] for r in got) else [(7, "É é K k")])]


@pytest.mark.parametrize("keys, windows", [(decontamination.MAX_KEYS, 0), (0, 0)])
def test_joins_that_shuffle(spark, data, monkeypatch, keys, windows):
    monkeypatch.setattr(decontamination, "MAX_KEYS", keys)
    monkeypatch.setattr(decontamination, "MAX_BROADCAST", windows)
    test_short_items_repeats_and_nulls(spark)
    test_op1_against_brute_force(spark, data)


def test_items_that_share_a_window(spark):
    ten = "one two three four five six seven eight nine ten"
    docs = [(i, f"{i} {ten} {i}") for i in range(30)]
    items = [(100 + i, ten if i % 2 else f"{ten} {i}") for i in range(40)]
    got, _ = run(spark, docs, items)
    assert got == brute(docs, items) and all(r[3] == 40 for r in got)


def test_empty_tables_and_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "fox jumps over the lazy dog"), (2, "word " * 12)], "item_id long, text string")
    got = decontamination.contamination(odd_docs, items).collect()
    assert len(got) == odd_docs.count() and {r.doc_id for r in got if r.contaminated} == {1, 2, 7}
    assert next(r.n_hit for r in got if r.doc_id == 7) == 60_000
    assert decontamination.contamination(no_docs, items).collect() == []
    assert not any(r.contaminated for r in decontamination.contamination(odd_docs, items.where("false")).collect())
    left = decontamination.clean(odd_docs, items)
    assert left.columns == odd_docs.columns and left.count() == 8
