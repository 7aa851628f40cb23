from __future__ import annotations

from collections import Counter
from math import exp, log
from zlib import crc32

import numpy as np

from sparkscour.llm import langid, toxicity
from sparkscour.llm.linear import Rows, fit
from sparkscour.llm.ngrams import buckets, counted, letters
from sparkscour.llm.queries import QUERIES


def test_buckets_do_not_depend_on_blocks(monkeypatch):
    data = letters("Größe und Länge, 12 naïve Wörter!" * 50)
    whole = counted(data, (1, 3, 5), 12)
    monkeypatch.setattr("sparkscour.llm.ngrams.BLOCK", 37)
    parts = counted(data, (1, 3, 5), 12)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert letters(None) == b"  " and sum(len(x) for x in buckets(b"", (1, 2), 8)) == 0
    assert whole[1].sum() == sum(len(data) - n + 1 for n in (1, 3, 5))


def test_fit_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    y = np.where(x @ [1, -2, 0, 0.5, 0] + 0.3 > 0, 1.0, -1.0)
    rows = Rows([np.arange(5)] * 300, list(x), 5)
    for loss in ("hinge", "logistic"):
        w, b = fit(rows, y, loss, 1e-3, 300)
        assert (np.sign(rows.dot(w) + b) == y).mean() > 0.95


def test_rows_with_and_without_values():
    rows = Rows([np.array([0, 2]), np.array([], int), np.array([2]), np.array([], int)], [np.array([1.0, 3.0]), np.array([]), np.array([5.0]), np.array([])], 4)
    assert rows.dot(np.array([1.0, 10.0, 100.0, 1000.0])).tolist() == [301.0, 0.0, 500.0, 0.0]
    assert rows.back(np.array([1.0, 7.0, 2.0, 9.0])).tolist() == [1.0, 0.0, 13.0, 0.0]
    none = Rows([np.array([], int)] * 2, [np.array([])] * 2, 3)
    assert none.dot(np.ones(3)).tolist() == [0.0, 0.0] and none.back(np.ones(2)).tolist() == [0.0] * 3


def held_out(doc_id) -> bool:
    return crc32(str(doc_id).encode()) % 4 == 2


def test_op6(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op6_language_id"](spark, folder).collect()
    assert {r.doc_id for r in got} == set(truth) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in out) > 0.95 * len(out) > 100


def test_op4(spark):
    folder = "/root/testdata/sf0.01"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op4_toxicity"](spark, folder).collect()}
    assert all(0 <= r.score <= 1 and r.held_out == held_out(r.doc_id) and r.predicted == (r.score >= 0.3) for r in got.values())
    out = [(toxic[i], r.predicted) for i, r in got.items() if r.held_out and i in toxic]
    assert sum(a == b for a, b in out) >= 0.9 * len(out) and any(a and b for a, b in out)


def test_op4_with_more_labels(spark):
    folder = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    out = [(toxic[r.doc_id], r.score, r.predicted) for r in QUERIES["op4_toxicity"](spark, folder).where("held_out").collect() if r.doc_id in toxic]
    yes, no = [s for y, s, _ in out if y], [s for y, s, _ in out if not y]
    assert sum(a > b for a in yes for b in no) / (len(yes) * len(no)) > 0.98
    assert sum(y == p for y, _, p in out) > 0.95 * len(out)


def test_families_come_first():
    assert langid.family("en-GB") == "germanic" and langid.family("xx") == "other"
    sample = [(lang, *counted(letters(text), langid.SIZES, langid.BITS)) for lang, text in (("en", "the cat and the dog"), ("de", "der hund und die katze"), ("fr", "le chien et la chatte"), ("es", "el perro y la gata")) for _ in range(3)]
    model = langid.train(sample)
    assert model.families == ["germanic", "romance"] and set(model.pairs) == {("germanic", "romance"), ("de", "en"), ("es", "fr")}
    for lang, text in (("en", "the dog"), ("de", "die hund"), ("fr", "le chatte"), ("es", "el gata")):
        assert model.predict(text)[0] == lang
    assert model.predict("12 ?!") == model.predict(None) == ("und", 0.0)


def test_every_language_is_learned(spark):
    codes = [f"x{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(203)]
    word = lambda code: "".join(chr(0x4E00 + 40 * codes.index(code) + j) for j in range(6))
    docs = spark.createDataFrame([(10 * i + j, f"{word(c)} {j}", c) for i, c in enumerate(codes) for j in range(6)], "doc_id long, text string, lang string")
    model = langid.fitted(docs)
    assert {x for names in model.members.values() for name in names for x in langid.leaves(name)} == set(codes)
    assert len(model.pairs) < 2000 and all(len(names) <= langid.GROUP for names in model.members.values())
    assert sum(model.predict(word(c))[0] == c for c in codes) >= 200


def test_odd_rows(spark, odd_docs, no_docs):
    got = langid.identified(odd_docs).collect()
    assert len(got) == 12
    for r in got:
        assert (r.lang_pred == "und") == (r.doc_id in (3, 4, 5, 8) or r.doc_id is None and r.score == 0.0)
    assert langid.identified(no_docs).collect() == []
    kept = langid.recognised(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 2, 7, 9, 9]
    unlabelled = langid.identified(odd_docs.withColumn("lang", odd_docs.lang.cast("string").substr(9, 1)))
    assert len(unlabelled.collect()) == 12
    labels = spark.createDataFrame([(1, 1), (2, 0), (9, 0), (9, 1), (None, 1), (77, 1), (7, None)], "doc_id long, toxic int")
    scored = toxicity.scored(odd_docs, labels).collect()
    assert len(scored) == 12 and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if r.doc_id in (3, 4, 5)}) == 1
    assert toxicity.scored(no_docs, labels).collect() == []
    none = toxicity.scored(odd_docs, labels.where("false")).collect()
    assert not any(r.predicted for r in none)


def test_inputs_are_text_only(spark):
    """The same texts under other sources, ids and languages get the same scores from one model."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from pyspark.sql import functions as F

    model = langid.fitted(docs)
    a = docs.select("doc_id", langid.predicted(spark, model, F.col("text")).alias("p")).collect()
    b = docs.select((F.col("doc_id") + 10**6).alias("doc_id"), "text").select("doc_id", langid.predicted(spark, model, F.col("text")).alias("p")).collect()
    assert {(r.doc_id + 10**6, r.p) for r in a} == {(r.doc_id, r.p) for r in b}


def plain_grams(text, sizes):
    """The byte n-grams of the lower-cased words of a text, with a space before and after each."""
    data = "".join(c if c.isalpha() or ord(c) >= 0x80 else " " for c in (text or "").lower()).encode()
    data = b" " + b" ".join(data.split()) + b" "
    return [data[i : i + n] for n in sizes for i in range(len(data) - n + 1)]


def plain_bucket(gram, bits):
    return ((int.from_bytes(gram, "big") + (len(gram) << 56)) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - bits)


def test_toxic_scores_by_brute_force(spark):
    """Ratios, weights and scores once more, row by row: naive Bayes shares, and a gradient that vanishes at the fit."""
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    known = {i: y for i, y in labels.items() if y in (0, 1) and not held_out(i) and i in texts}
    size = {y: sum(v == y for v in known.values()) for y in (0, 1)}
    grams = {i: {plain_bucket(g, toxicity.BITS) for g in plain_grams(texts[i], toxicity.SIZES)} for i in texts}
    seen = {y: Counter(b for i, v in known.items() if v == y for b in grams[i]) for y in (0, 1)}
    ratio = {b: log(((seen[1][b] + 1) / (size[1] + 2)) / ((seen[0][b] + 1) / (size[0] + 2))) for b in seen[0] | seen[1]}
    told = {b: r for b, r in ratio.items() if abs(r) >= 1 and seen[0][b] + seen[1][b] >= 5}
    model = toxicity.fitted(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert set(np.flatnonzero(model.weights).tolist()) <= set(told)
    margin = lambda i: sum(float(model.weights[b]) for b in grams[i]) + model.bias
    for r in QUERIES["op4_toxicity"](spark, folder).collect():
        assert abs(r.score - 1 / (1 + exp(-margin(r.doc_id)))) < 1e-5
    push = {i: (1 if y else -1) * (0.5 / size[y]) / (1 + exp((1 if y else -1) * margin(i))) for i, y in known.items()}
    assert abs(sum(push.values())) < 0.02
    for b, x in told.items():
        assert abs(sum(push[i] * x for i in known if b in grams[i]) - toxicity.PENALTY * float(model.weights[b]) / x) < 0.05


def test_language_votes_by_brute_force(spark):
    """Family first, then all duels of the family: margins from relative frequencies, votes by sigmoids."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = langid.fitted(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in QUERIES["op6_language_id"](spark, folder).collect()}
    bucket_of = lambda g: plain_bucket(g, langid.BITS)
    for r in docs.collect():
        counts = Counter(bucket_of(g) for g in plain_grams(r.text, langid.SIZES))
        n = sum(counts.values())

        def winner(of, names, counts=counts, n=n):
            if len(names) == 1:
                return names[0], 1.0
            duels, won = model.duels[of], dict.fromkeys(names, 0.0)
            for (a, b), i in duels.pairs.items():
                margin = duels.bias[i] + sum(c / n * 30.0 * float(duels.weights[duels.place[x], i]) for x, c in counts.items())
                p = 1 / (1 + exp(-3 * margin))
                won[a] += p
                won[b] += 1 - p
            best = max(names, key=lambda x: (won[x], x))
            return best, won[best] / (len(names) - 1)

        kin, p = winner(None, model.families)
        lang, q = winner(("family", kin), model.members["family", kin])
        if any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id][0] == lang and abs(got[r.doc_id][1] - p * q) < 1e-5
        else:
            assert got[r.doc_id] == ("und", 0.0)


def test_features_are_bounded_in_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 7} " * 400 + "x" * i, "en" if i % 2 else "de") for i in range(400)], "doc_id long, text string, lang string")
    whole = langid._sample(docs, "doc_id", "text", "lang", 400)
    monkeypatch.setattr(langid, "MOST_BYTES", 1_000_000)
    part = langid._sample(docs, "doc_id", "text", "lang", 400)
    assert 2 * langid.LEAST_ROWS / 2 <= len(part) < len(whole) / 2 and {x for x, _, _ in part} == {"de", "en"}


def test_toxic_features_are_bounded_in_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{'bad' if i % 3 else 'good'} words{i % 5} and more {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(300)], "doc_id long, toxic int")
    sizes = []
    whole = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda sample: sizes.append((len(sample), {y for y, _ in sample})) or whole(sample))
    toxicity.fitted(docs, labels)
    monkeypatch.setattr(toxicity, "MOST_BYTES", 10_000)
    toxicity.fitted(docs, labels)
    assert 200 < sizes[0][0] <= 300 and 0 < sizes[1][0] < sizes[0][0] / 2 and all(x == {0, 1} for _, x in sizes)
