from __future__ import annotations

import re
from collections import Counter
from math import log2

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkscour.llm import pii, url_filters
from sparkscour.llm.queries import QUERIES


def plain_spans(text):
    """The kinds' patterns as they are stated, leftmost and without overlaps."""
    digits = lambda s: re.sub(r"[^0-9]", "", s)

    def luhn(d):
        return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(k, *m.span()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m[0])]


@given(st.text(alphabet="a@.b-+_%0123 1()C,", max_size=40))
@settings(max_examples=2000, deadline=None)
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


@pytest.mark.parametrize("text", ["a@b.cd@e.fg", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "x@@y.z", "4111 1111-1111 1111", "+1 (543) 555-1435.", "256.1.1.1", "é@x.y", "a" * 50_000 + "@", "1." * 50_000, "+" * 20_000 + "1", "1.2.3." + "0" * 3000, "at 1.2.3." + "0" * 900 + "7 or 0001.2.3.4"])
def test_hard_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_op9_against_patterns(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in QUERIES["op9_pii"](spark, folder).collect():
        want = plain_spans(texts[r.doc_id])
        listed = [f"{k}:{a}:{b}" for k, a, b in want]
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == listed
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in want) for kind in pii.KINDS)


def test_terms_that_disclose(spark):
    docs = [(i, f"Case {i} of Xanthippe mail xan{i}@a.org and common words here") for i in range(40)]
    docs += [(100 + i, f"note {i}: Quixotic wrote to don@mancha.es about common stuff") for i in range(4)]
    docs += [(200 + i, f"plain {i} with common words and nothing else to tell") for i in range(200)] + [(999, docs[-1][1])] * 5
    rows = {(r.doc_id, r.text): r.spans for r in pii.spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    terms = lambda i, t: [t[s.start : s.end] for s in rows[i, t] if s.kind == "term"]
    for i, t in docs:
        assert terms(i, t) == (["Quixotic", "wrote", "about", "stuff"] if 100 <= i < 104 or i == 999 else []), (i, t)
    clean = pii.sanitised(spark.createDataFrame(docs[40:41], "doc_id long, text string")).first()
    assert "<email>" in clean.text and "don@" not in clean.text


def test_terms_of_an_entity_in_one_text(spark):
    docs = [(1, "Zenobia wrote to zen@a.org about common words")] + [(10 + i, f"plain {i} wrote about common words") for i in range(200)]
    found = {r.doc_id: r for r in pii.spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [found[1].text[s.start : s.end] for s in found[1].spans if s.kind == "term"] == ["Zenobia"]
    assert not any(found[i].spans for i, _ in docs[1:])


@pytest.mark.parametrize("broadcast", [pii.MAX_BROADCAST, 0])
def test_terms_anywhere_in_the_document(spark, monkeypatch, broadcast):
    monkeypatch.setattr(pii, "MAX_BROADCAST", broadcast)
    text = "Xanthippe Miller of the local council, mail x@a.org. " + "local mail of the council " * 20 + "Xanthippe Miller"
    docs = [(1, text), (2, "Quixotic wrote to don@mancha.es about the local council mail, said Quixotic")]
    docs += [(10 + i, f"plain {i} wrote about local council mail said the common words") for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    terms = lambda found: {r.doc_id: [r.text[s.start : s.end] for s in r.spans if s.kind == "term"] for r in found.collect() if r.doc_id < 10}
    assert terms(pii.spans(frame)) == {1: [], 2: ["Quixotic"] * 2}
    assert terms(pii.spans(frame, near=None)) == {1: ["Xanthippe", "Miller"] * 2, 2: ["Quixotic"] * 2}


def test_ip_part_longer_than_python_reads(spark):
    text = "1.2.3." + "0" * 5000
    docs = spark.createDataFrame([(1, text), (2, text + "9"), (3, "1.2.3." + "9" * 5000)], "doc_id long, text string")
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in pii.spans(docs, near=None).collect()} == {1: [("ip", 0, 5006)], 2: [("ip", 0, 5007)], 3: []}


def brute_terms(texts):
    """Per different text the (start, end) of its disclosing words, by counts over all pairs of words and entities."""
    word = lambda t: [(m[0].lower(), *m.span()) for m in re.finditer(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", t)]
    texts = sorted(set(texts))
    base = {t: plain_spans(t) for t in texts}
    free = {t: [(w, a, b) for w, a, b in word(t) if b - a >= 4 and not any(a < e and s < b for _, s, e in base[t])] for t in texts}
    value = lambda t, k, a, b: (k, t[a:b].lower() if k in ("email", "ip") else re.sub("[^0-9]", "", t[a:b]))
    entities = {t: {value(t, *s) for s in base[t]} for t in texts}
    n, m, k = Counter(), Counter(), Counter()
    for t in texts:
        n.update(entities[t])
        m.update({w for w, _, _ in word(t)})
        k.update({(w, e) for w, _, _ in free[t] for e in entities[t]})
    share = lambda w, e: log2(k[w, e] * len(texts) / (n[e] * m[w])) / log2(len(texts) / n[e]) if n[e] < len(texts) else 0.0
    told = {p for p in k if share(*p) >= 0.9}
    return {t: [(a, b) for w, a, b in free[t] if any((w, e) in told for e in entities[t])] for t in texts}


@pytest.mark.parametrize("folder, broadcast", [("sf0.01", pii.MAX_BROADCAST), ("sf0.001", 0)])
def test_disclosing_terms_by_brute_force(spark, monkeypatch, folder, broadcast):
    monkeypatch.setattr(pii, "MAX_BROADCAST", broadcast)
    monkeypatch.setattr(pii, "MAX_HASHES", broadcast)
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    want = brute_terms([r.text or "" for r in docs.collect()])
    got = pii.spans(docs, near=None).collect()
    assert len(got) == docs.count() and any(want.values())
    for r in got:
        assert [(s.start, s.end) for s in r.spans if s.kind == "term"] == want[r.text]


def test_pii_of_odd_rows(odd_docs, no_docs):
    assert all(r.spans == [] for r in pii.spans(odd_docs).collect())
    assert pii.spans(odd_docs).count() == 12 and pii.spans(no_docs).collect() == []


def test_prefixes_with_slashes_and_capitals(spark):
    entries = spark.createDataFrame([("prefix", v, 0, "add") for v in ("a.org/blog/", "b.org/", "C.org/Blog", "d.org/x")], "kind string, value string, at long, action string")
    blocked = ["http://a.org/blog/", "http://a.org/blog/1/2", "http://b.org", "http://b.org/x", "http://b.org/x/", "http://c.org/Blog", "http://C.ORG/Blog/1", "http://d.org/x/"]
    open_ = ["http://a.org/blog", "http://a.org/blog-2", "http://a.org/", "http://c.org/blog", "http://d.org/x-2", "http://d.org/"]
    captures = spark.createDataFrame([(i, u, 1) for i, u in enumerate(blocked + open_)], "page_id long, url string, fetched long")
    assert sorted(r.url for r in url_filters.evaluated(captures, entries).where("blocked").collect()) == sorted(blocked)


def test_very_long_urls(spark):
    entries = spark.createDataFrame([("prefix", "a.org/x/x", 0, "add"), ("domain", "b.org", 0, "add"), ("host", "c.org", 0, "add")], "kind string, value string, at long, action string")
    urls = ["http://a.org" + "/x" * 200_000, "http://a.org/y" + "/x" * 200_000, "http://" + "w." * 50_000 + "b.org/", "http://c.org/?" + "q" * 2_000_000, "http://d.org/" + "z" * 2_000_000]
    captures = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, fetched long")
    got = {r.page_id: r.rules for r in url_filters.evaluated(captures, entries).collect()}
    assert got == {0: ["prefix:a.org/x/x"], 1: [], 2: ["domain:b.org"], 3: ["host:c.org"], 4: []}
    only = url_filters.evaluated(captures, entries.where("kind = 'host'")).collect()
    assert [r.page_id for r in only if r.blocked] == [3]


def test_intervals_and_captures(spark):
    log = [("host", "a.b.org", 10, "add"), ("host", "A.b.org", 20, "remove"), ("host", "a.b.org", 30, "add"), ("host", "a.b.org", 35, "add"), ("domain", "b.org", 15, "add"), ("prefix", "c.net/x", 0, "add"), ("prefix", "c.net/x", 0, "remove"), ("prefix", "c.net/y/z", 5, "add"), ("odd", "q", 1, "add"), ("host", None, 1, "add"), ("host", "z.z", None, "add")]
    entries = spark.createDataFrame(log, "kind string, value string, at long, action string")
    urls = [None, "", "nonsense", "http://a.b.org", "HTTPS://User:pw@A.B.org.:8080/p?q#f", "http://c.net/x/1", "http://c.net/y/z", "http://c.net/y/zz", "http://deep.a.b.org/y", "ftp://org/"]
    captures = [(i, u, t) for i, u in enumerate(urls) for t in (None, 0, 5, 10, 12, 19, 20, 29, 30, 99)]

    def active(kind, value, t):
        last = None
        for k, v, at, action in sorted((e for e in log if e[2] is not None and e[1] is not None), key=lambda e: (e[2], e[3])):
            if k == kind and (v.lower() if k != "prefix" else v) == value and at <= t:
                last = action
        return last == "add"

    def rules(url, t):
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*(/[^?#]*)?", url or "")
        if not m or not m[1] or t is None:
            return []
        host = m[1].lower().rstrip(".")
        names = {("host", host)} | {("domain", ".".join(host.split(".")[i:])) for i in range(host.count(".") + 1)}
        steps = (m[2] or "").split("/")
        names |= {("prefix", host + "/".join(steps[:i])) for i in range(2, len(steps) + 1)}
        return sorted(f"{k}:{v}" for k, v in names if active(k, v, t))

    frame = spark.createDataFrame(captures * 2, "page_id long, url string, fetched long").selectExpr("*", "'x' AS id", "'y' AS value", "'z' AS kind")
    got = url_filters.evaluated(frame, entries).collect()
    assert sorted(str((r.page_id, r.url, r.fetched, r.rules, r.blocked, r.n_rules)) for r in got) == sorted(str((i, u, t, rules(u, t), bool(rules(u, t)), len(rules(u, t)))) for i, u, t in captures * 2)
    assert any(r.blocked for r in got)
    assert url_filters.evaluated(frame.where("false"), entries).collect() == []
    assert not any(r.blocked for r in url_filters.evaluated(frame, entries.where("false")).collect())
