"""The operators on DataFrames, streams and files, against the engine on single texts."""

from __future__ import annotations

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkscour.functions import diff, labels, native
from sparkscour.functions.diff import edits, edits_column, summary, summary_column
from sparkscour.operators import frames
from sparkscour.operators.engine import Change, applied, changes, clean, scan
from sparkscour.plans import oracle
from sparkscour.plans.registry import REGISTRY
from sparkscour.plans.rules import config, moderate, selected
from sparkscour.sources import decoding, word
from sparkscour.streaming import streams

DIRTY = [
    (1, "Furthermore, we delve — into\u00a0it… dаta  \n\n\n\nEnd. \U0001f600"),
    (2, None),
    (3, ""),
    (3, "plain text here.\n"),
    (None, "a\u200bb"),
    (4, "Mail me@x.org now. It is so! It is good. It is fine."),
    (5, "😀 ok".encode("utf-16", "surrogatepass").decode("utf-16")),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DIRTY, "doc_id long, text string").selectExpr("*", "'x' AS found", "1 AS start", "'y' AS c", "'z' AS f")


def test_findings_and_tallies(docs):
    want = sorted((str(i), f.rule_id, f.start, f.end, f.orig, str(f.repl), f.kind, f.suggestions) for i, t in DIRTY for f in scan(t or "", config(REGISTRY.rules), REGISTRY))
    found = frames.findings(docs)
    got = sorted((str(r.doc_id), r.rule_id, r.start, r.end, r.orig, str(r.repl), r.kind, tuple(r.suggestions)) for r in found.collect())
    assert got == want
    assert {r.kind: r.n for r in frames.tally(found, "kind").collect()} == {k: sum(w[6] == k for w in want) for k in {w[6] for w in want}}
    groups = frames.tally_by_group(found).orderBy("place").collect()
    assert sum(r.n for r in groups) == len(want) and [r.group_id for r in groups][0] == "inv"
    skips = found.where("rule_id = 'pu.em'").select("doc_id", "rule_id", "start")
    assert frames.without_skips(found, skips).count() == len(want) - 1
    assert frames.findings(docs.where("false")).collect() == []


def test_cleaned_and_journal(docs):
    out = frames.cleaned(docs)
    got = sorted((str(r.doc_id), r.text, r.n_passes, sorted(r.applied.items()), r.refused) for r in out.collect())
    made = [(i, clean(t or "", config(REGISTRY.rules), REGISTRY, moderate(REGISTRY.rules))) for i, t in DIRTY]
    assert got == sorted((str(i), c.text, len(c.passes), sorted(c.applied.items()), c.refused) for i, c in made)
    total: dict[str, int] = {}
    for _, c in made:
        for k, n in c.applied.items():
            total[k] = total.get(k, 0) + n
    assert {r.rule_id: r.n for r in frames.journal(out).collect()} == total
    skips = frames.findings(docs).where("rule_id = 'pu.em'").select("doc_id", "rule_id", "start")
    kept = {r.doc_id: r.text for r in frames.cleaned(docs, skips=skips).collect()}
    assert "—" in kept[1]


def test_decided(spark, docs):
    decisions = spark.createDataFrame([(1, "sty.opener", 0, False, 0), (1, "pu.em", 21, True, None)], "doc_id long, rule_id string, start int, skip boolean, pick int")
    text = {r.doc_id: r.text for r in frames.decided(docs, decisions).collect()}[1]
    assert text.startswith("We delve — into it... data")


def test_profile(docs):
    rows = {(r.doc_id, r.chars): r for r in frames.profile(docs, signals=True).collect()}
    r = rows[4, len(DIRTY[5][1])]
    assert (r.words, r.sentences, r.paragraphs) == (13, 4, 1) and r.avg_sentence == 13.0 / 4 + 0.25 or r.sentences == 4
    assert rows[2, 0].words == rows[3, 0].words == 0 and rows[2, 0].burstiness == 0.0
    assert rows[5, 5].words == 1  # an astral character has two code units
    assert all(r.signals_per_1k >= 0 for r in rows.values())


def test_regions(docs):
    got = frames.regions(docs).collect()
    assert [(r.doc_id, r.type) for r in got] == [(4, "url")]


def test_basic_cleaning_equals_the_rules(spark, data):
    """The built-in functions against the engine with the same rules."""
    pairs = (("th", "t\u200bh"), (". ", ".\u00a0"), (" de ", " de\u00ad "), ("\n", " \r\n\n\n"), (" of ", " of\x0b"))
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    for old, new in pairs:
        docs = docs.withColumn("text", F.replace("text", F.lit(old), F.lit(new)))
    rules = ["inv.zw", "inv.shy", "inv.ctrl", "sp.nbsp", "sp.odd", "sp.sep", "sp.crlf", "ws.trailing", "ws.blank"]
    native_text = {r.doc_id: r.t for r in docs.select("doc_id", native.basic_cleaning(F.col("text")).alias("t")).collect()}
    engine_text = {r.doc_id: r.text for r in frames.cleaned(docs, frames.default_config(only=rules), selected(rules)).collect()}
    assert native_text == engine_text


@pytest.mark.parametrize("rule", sorted(native.RULES))
def test_native_rules_equal_the_engine(spark, data, rule):
    pairs = next(q for q in oracle.RULE_QUERIES if q.rule == rule).pairs
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(40)
    docs = docs.select("doc_id", oracle.planted(F.col("text"), pairs).alias("text"))
    one = frames.default_config(only=[rule])
    found = {r.doc_id: r.n for r in frames.tally(frames.findings(docs, one), "doc_id").collect()}
    rows = docs.select("doc_id", native.rule_count(F.col("text"), rule).alias("n"), native.rule_fixed(F.col("text"), rule).alias("t"), "text").collect()
    assert {r.doc_id: r.n for r in rows if r.n} == found and found
    for r in rows:
        edits_ = changes(r.text, scan(r.text, one, REGISTRY), lambda f: f.repl)
        assert r.t == applied(r.text, edits_)


def test_pattern_findings_scan_each_text_once(spark):
    rules = {"inv.zw": native.RULES["inv.zw"], "own.digits": (r"[0-9]+", None)}
    texts = ["\ufeffa\u200bb\ufeff", "\U0001f600\ufeff\u2060", "1\u200b" * 700, "", None]
    got = frames.pattern_findings(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), rules)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("regexp_extract_all(") == len(rules)
    want = [(0, "inv.zw", 2, 3), (0, "inv.zw", 4, 5), (1, "inv.zw", 1, 2), (1, "inv.zw", 2, 3)]
    want += [(2, rule, at + (rule == "inv.zw"), at + 1 + (rule == "inv.zw")) for at in range(0, 1400, 2) for rule in rules]
    assert sorted((r.doc_id, r.rule_id, r.start, r.end) for r in got.collect()) == sorted(want)


def test_pattern_findings(spark):
    import re

    texts = ["", None, "a1b22", "7" * 3 + " x " + "é9" * 700, " 5" * 5000, "no digits"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").selectExpr("*", "'x' AS start", "'y' AS f", "'z' AS of")
    got = frames.pattern_findings(docs, {"own.digits": (r"[0-9]+", "<$0>"), "own.e": ("é", None), "own.x": (" ?x ", "")}).collect()
    want = [(i, rule, m.start(), m.end(), m[0], put(m), kind) for rule, pattern, put, kind in (("own.digits", "[0-9]+", lambda m: f"<{m[0]}>", "replace"), ("own.e", "é", lambda m: None, "review"), ("own.x", " ?x ", lambda m: "", "remove")) for i, t in enumerate(texts) for m in re.finditer(pattern, t or "")]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.rule_id, r.start, r.end, r.orig, r.repl, r.kind)) for r in got)


def test_files_that_are_not_read(spark, tmp_path):
    for name in ("a.txt", "b.TEX", "c.pdf", "d.png", "e", "f.docx"):
        (tmp_path / name).write_bytes(b"\x00\x01" if name == "d.png" else b"text")
    read = {r.ending for r in decoding.read_files(spark, str(tmp_path)).collect()}
    left = {r.ending: r.reason for r in decoding.unread_files(spark, str(tmp_path)).collect()}
    assert read == {"txt", "tex", "docx"} and left == {"pdf": "a format that is not text", "png": "an unknown ending", "": "an unknown ending"}
    docs = spark.createDataFrame([(1, "one\ntwo"), (2, None)], "doc_id int, text string")
    decoding.write_text(docs, str(tmp_path / "json"), form="json")
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    decoding.write_text(docs, str(tmp_path / "lines"), form="text")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["", "one", "two"]


def test_paragraphs_of_word_files(spark):
    df = spark.createDataFrame([("a\nb\n \n\nc",)], "t string")
    assert tuple(df.select(native.paragraphs(F.col("t")), native.paragraphs(F.col("t"), word=True)).first()) == (2, 3)


def test_nearest_to_a_line(spark):
    docs = spark.createDataFrame([(1, "ab\u00a0c\nd\u00a0e\nf\u00a0g")], "doc_id int, text string")
    found = frames.findings(docs, frames.default_config(only=["sp.nbsp"]))
    lines = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 9)], "doc_id int, line int")
    assert {r.line: r.start for r in labels.nearest_to_line(found, docs, lines).collect()} == {1: 2, 2: 6, 3: 10, 9: 10}


def test_streams(spark, tmp_path, docs):
    source = str(tmp_path / "in")
    docs.select("doc_id", "text").repartition(3).write.parquet(source)
    for name, make, batch in (("found", streams.findings_stream, frames.findings), ("cleaned", streams.cleaned_stream, frames.cleaned), ("profile", streams.profile_stream, frames.profile)):
        stream = make(spark.readStream.schema("doc_id long, text string").parquet(source))
        streams.to_parquet(stream, str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / name)).count() == batch(docs).count()


def test_differences(spark):
    for a, b in (("", ""), ("abc", "abc"), ("a b c", "a x c"), ("aaa", "aa"), ("", "x"), ("abcabc", "abc")):
        assert applied(a, edits(a, b)) == b
    assert summary("one two three", "one 2 three four") == (6, 3) and summary("a" * 500_000, "b" * 400_000) is None
    df = spark.createDataFrame([("one two", "one 2"), (None, "x")], "a string, b string")
    got = df.select(edits_column(F.col("a"), F.col("b")).alias("e"), summary_column(F.col("a"), F.col("b")).alias("s")).collect()
    assert [tuple(r.s) for r in got] == [(1, 3), (1, 0)] and got[1].e[0].insert == "x"


def test_summary_of_long_texts_takes_no_square_of_time(monkeypatch):
    before = "\n\n\n\n" + "a word and more.\u00a0\n\n\nNext" * 10_000
    after = before.lstrip("\n").replace("\u00a0\n\n\n", "\n\n") + "\n"
    want = (2 * 10_000 + 1, 4 * 10_000 + 4)
    monkeypatch.setattr(diff, "SequenceMatcher", None)
    assert summary(before, after) == want


def test_summary_is_the_least():
    def least(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                rows[i][j] = rows[i - 1][j - 1] + 1 if x == y else max(rows[i - 1][j], rows[i][j - 1])
        return len(b) - rows[-1][-1], len(a) - rows[-1][-1]

    dice, proven = random.Random(1), 0
    for _ in range(400):
        a = [dice.choice("abcdef") for _ in range(dice.randrange(12))]
        b = [dice.choice("xyz") if dice.random() < 0.3 else c for c in a if dice.random() < 0.8]
        if walked := diff._walked(a, b):
            proven += 1
            assert (walked[1].total(), walked[0].total()) == least(a, b)
    assert proven > 100


def test_kept_parts_are_the_most(monkeypatch):
    def most(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            above = row[:]
            for j, y in enumerate(b, 1):
                row[j] = above[j - 1] + 1 if x == y else max(above[j], row[j - 1])
        return row[-1]

    dice = random.Random(2)
    for held in (diff.MASKS, 2):
        monkeypatch.setattr(diff, "MASKS", held)
        for _ in range(300):
            a, b = ([dice.choice("abcdefgh"[: dice.choice((2, 8))]) for _ in range(dice.randrange(25))] for _ in range(2))
            assert diff._kept(a, b).total() == most(a, b)


def test_summary_of_long_texts_that_no_walk_proves(spark):
    dice = random.Random(3)
    words = [f"w{dice.randrange(999)}" for _ in range(90_000)]
    before, after = " ".join(words), " ".join([*words[1:], words[0]])
    parts = [x for i, w in enumerate(words) for x in ((" ", w) if i else (w,))]
    assert diff._walked(parts, [*parts[2:], " ", parts[0]]) is None and len(before) + len(after) > diff.LONGEST
    row = spark.createDataFrame([(before, after)], "a string, b string").select(summary_column(F.col("a"), F.col("b")).alias("s")).first()
    assert tuple(row.s) == (len(words[0]) + 1, len(words[0]) + 1)


def test_estimate_and_conversion(spark, docs):
    found = frames.findings(docs)
    took = sum(sum(r.passes is not None and len(p) for p in r.passes[:1]) for r in frames.cleaned(docs).collect())
    assert frames.estimate(found, frames.default_selection()).first().n >= took - 2
    md = spark.createDataFrame([(1, "# T\n\n**b** [l](u) $x^2$\n")], "doc_id long, text string")
    assert frames.converted(md, "md").first().text == "T\n\nb l (u) x²\n"


def test_labels(spark):
    assert labels.code("a") == "U+0061" and labels.chip("\u200b") == "ZWSP" and labels.chip("\ufe0f") == "VS16" and labels.chip("a") == ""
    assert labels.visible("a\u00a0b\n") == "a[NBSP]b\n" and "ZERO WIDTH" in labels.name("\u200b")
    assert labels.hidden_message("x\U000e0068\U000e0069") == "hi"
    df = spark.createDataFrame([("ab\ncd", 4)], "t string, at int")
    assert tuple(df.select(*labels.position(F.col("t"), F.col("at")), labels.clip(F.lit("123456789"))).first()) == (2, 2, "12345678…")
    assert list(frames.in_words("zero-width")) == ["inv.zw"]


def test_decoding(spark, tmp_path):
    text = "Grüße, „Welt“ – naïve text that is long enough"
    for codec, data in (("utf-8", text.encode()), ("utf-8", b"\xef\xbb\xbf" + text.encode()), ("utf-16le", b"\xff\xfe" + text.encode("utf-16-le")), ("utf-16be", text.encode("utf-16-be")), ("utf-16le", text.encode("utf-16-le")), ("windows-1252", text.encode("cp1252"))):
        assert decoding.decoded(data) == (text, codec)
    assert decoding.decoded(None) == ("", "utf-8") and decoding.decoded(b"\x81\xff")[1] == "windows-1252"
    (tmp_path / "a.txt").write_bytes(b"x\r\ny\rz")
    (tmp_path / "b.TEX").write_bytes("é".encode("cp1252"))
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.docx").write_bytes(b"PK")
    rows = {r.ending: r for r in decoding.read_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"txt", "tex", "docx"} and rows["txt"].text == "x\ny\nz" and rows["txt"].crlf and not rows["txt"].legacy_encoding
    assert rows["tex"].text == "é" and rows["tex"].legacy_encoding and rows["docx"].text is None


def word_file() -> bytes:
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda text, props="": f'<w:r>{f"<w:rPr>{props}</w:rPr>" if props else ""}<w:t xml:space="preserve">{text}</w:t></w:r>'
    body = (
        f"<w:p>{run('He')}{run('llo', '<w:b/>')}{run(' — x')}<w:r><w:tab/></w:r>{run('end')}</w:p>"
        f"<w:p>{run('seen ')}{run('white', '<w:color w:val=&quot;FFFFFF&quot;/>'.replace('&quot;', chr(34)))}{run('gone', '<w:vanish/>')}{run('kept', '<w:vanish w:val=&quot;0&quot;/>'.replace('&quot;', chr(34)))}</w:p>"
        f"<w:tbl><w:tr><w:tc><w:p>{run('cell')}</w:p></w:tc></w:tr></w:tbl>"
        f"<w:p><w:hyperlink>{run('link')}</w:hyperlink><w:del><w:r><w:delText>old</w:delText></w:r></w:del><w:ins>{run('new')}</w:ins></w:p>"
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        z.writestr("word/footnotes.xml", f"<w:footnotes {ns}><w:footnote><w:p>{run('note')}</w:p></w:footnote></w:footnotes>")
        z.writestr("media/unchanged.bin", b"\x00\x01")
    return out.getvalue()


def test_word_files(spark):
    data = word_file()
    doc = word.load(data)
    assert doc.text == "Hello — x\tend\nseen whitegonekept\ncell\nlinknew\n\nnote"
    assert [doc.text[r.start : r.end] for r in doc.hidden] == ["whitegone"]
    assert "link" not in [doc.text[a:b] for a, b in word.wording_spans(doc)] and "He" in [doc.text[a:b] for a, b in word.wording_spans(doc)]
    settings = config([r for r in REGISTRY.rules], "txt", disable=word.DISABLED)
    result = clean(doc.text, settings, REGISTRY, moderate(REGISTRY.rules))
    saved, refused = word.edit_passes(data, result.passes)
    assert refused == 0 and word.load(saved).text == doc.text.replace(" — ", " - ")
    with zipfile.ZipFile(io.BytesIO(saved)) as z:
        assert z.read("media/unchanged.bin") == b"\x00\x01"
    tab, line = doc.text.index("\t"), doc.text.index("\n")
    assert word.edit(word.load(data), [Change(tab, tab + 1, " "), Change(line, line + 1, " "), Change(0, 1, "a\nb")])[0] == 3
    changed = word.load(data)
    assert word.edit(changed, [Change(1, 4, "ola"), Change(0, 0, ">")])[0] == 0
    rows = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"no")), (3, None)], "id int, content binary")
    got = rows.select("id", word.word_text(F.col("content")).alias("w")).orderBy("id").collect()
    assert got[0].w.text == doc.text and got[1].w.text is None and got[1].w.error and got[2].w.error
