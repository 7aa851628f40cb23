"""Word files: fields over paragraphs, structure that wording edits must respect, files that cannot be read, DataFrames."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from sparkscour.operators import frames
from sparkscour.operators.engine import Change, carried, clean
from sparkscour.plans.registry import REGISTRY
from sparkscour.plans.rules import config, selected
from sparkscour.sources import word

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'


def file(body: str, more: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS} {more}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def run(text: str) -> str:
    return f'<w:r><w:t xml:space="preserve">{text}</w:t></w:r>'


def p(*inside: str) -> str:
    return f"<w:p>{''.join(inside)}</w:p>"


def mark(kind: str) -> str:
    return f'<w:r><w:fldChar w:fldCharType="{kind}"/></w:r>'


def free(data: bytes) -> list[str]:
    doc = word.load(data)
    return [doc.text[a:b] for a, b in word.wording_spans(doc)]


def test_a_field_over_paragraphs():
    body = p(run("before"), mark("begin"), run("in1")) + p(run("in2")) + p(run("in3"), mark("end"), run("after"))
    assert free(file(body)) == ["before", "after"]


def test_an_end_without_a_beginning():
    assert free(file(p(mark("end"), run("a"), mark("begin"), run("infield"), mark("end"), run("b")))) == ["a", "b"]


def test_fields_do_not_reach_other_parts():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{p(mark('begin'), run('open'))}</w:body></w:document>")
        z.writestr("word/footnotes.xml", f"<w:footnotes {NS}>{p(run('note'))}</w:footnotes>")
    assert free(out.getvalue()) == ["note"]


@pytest.mark.parametrize("around", ["hyperlink", "fldSimple", "ins", "moveTo", "sdt"])
def test_structure_around_runs_and_paragraphs(around):
    inside = f"<w:{around}>{run('kept')}</w:{around}>"
    assert free(file(p(run("a"), inside))) == ["a"]
    assert free(file(f"<w:{around}>{p(run('kept'))}</w:{around}>" + p(run("b")))) == ["b"]


def test_formulas_are_not_text():
    doc = word.load(file(p("<m:oMath><m:r><m:t>x=2</m:t></m:r></m:oMath>", run("Equation."))))
    assert doc.text == "Equation."


def test_sizes_that_hide():
    sized = lambda n: f'<w:r><w:rPr><w:sz w:val="{n}"/></w:rPr><w:t>x{n}</w:t></w:r>'
    doc = word.load(file(p(*map(sized, ("4", "3.5", "5", "big", "", "0")))))
    assert [doc.text[r.start : r.end] for r in doc.hidden] == ["x4x3.5", "x0"]


def test_prefixes_stay():
    more = 'xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" mc:Ignorable="w14"'
    saved, refused = word.edit_passes(file(p(run("old")), more), [[Change(0, 3, "new")]])
    assert refused == 0 and word.load(saved).text == "new"
    xml = zipfile.ZipFile(io.BytesIO(saved)).read("word/document.xml").decode()
    assert "<w:t" in xml and 'xmlns:w14="' in xml and 'mc:Ignorable="w14"' in xml
    again, _ = word.edit_passes(saved, [[Change(0, 3, "newer")]])
    assert word.load(again).text == "newer"
    ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(again)).read("word/document.xml"))


def test_where_spans_go():
    edits = [Change(2, 4, "xyz"), Change(6, 6, "++"), Change(8, 10, "")]
    assert [carried(i, edits, True) for i in range(12)] == [0, 1, 2, 5, 5, 6, 9, 10, 11, 11, 11, 12]
    assert [carried(i, edits, False) for i in range(12)] == [0, 1, 2, 2, 5, 6, 7, 10, 11, 11, 11, 12]


def test_wording_stays_within_one_run():
    data = file(p(run("In order to test."), run("In order "), run("to stay.")) + p(f"<w:hyperlink>{run('In order to link.')}</w:hyperlink>"))
    doc = word.load(data)
    made = clean(doc.text, config(REGISTRY.rules, only=["sty.concise"]), REGISTRY, selected(["sty.concise"], include_wording=True), wording=word.wording_spans(doc))
    assert made.text == "To test.In order to stay.\nIn order to link." and made.refused == 2


def bad_files() -> list[bytes | None]:
    good = file(p(run("fine — text")))
    damaged = bytearray(good)
    damaged[60:90] = b"\xff" * 30
    locked = bytearray(good)
    at = locked.index(b"PK\x01\x02")
    locked[at + 8] |= 1  # the archive says that the part is encrypted
    return [good, None, b"", b"PK", bytes(damaged), bytes(locked), file("<w:p>")]


def test_files_that_cannot_be_read(spark):
    files = bad_files()
    rows = spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in enumerate(files)], "doc_id int, content binary")
    text = {r.doc_id: r.w for r in rows.select("doc_id", word.word_text(F.col("content")).alias("w")).collect()}
    assert text[0].text == "fine — text" and text[0].error is None and all(text[i].error and text[i].text is None for i in range(1, 7))
    edit = F.array(F.array(F.struct(F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit("good").alias("insert"))))
    made = {r.doc_id: r.w for r in rows.select("doc_id", word.edited_word(F.col("content"), edit).alias("w")).collect()}
    assert word.load(bytes(made[0].content)).text == "good — text" and all(made[i].error and made[i].content is None for i in range(1, 7))
    found = frames.word_findings(rows).collect()
    assert [(r.doc_id, r.rule_id) for r in found if r.error is None] == [(0, "pu.em")] and {r.doc_id for r in found if r.error} == set(range(1, 7))
    cleaned = {r.doc_id: r for r in frames.word_cleaned(rows).collect()}
    assert cleaned[0].text == "fine - text" and cleaned[0].applied == {"pu.em": 1} and all(cleaned[i].error and cleaned[i].content is None for i in range(1, 7))
    assert frames.word_cleaned(rows.where("false")).collect() == frames.word_findings(rows.where("false")).collect() == []


def test_word_findings_on_frames(spark):
    hidden = word.made([[("seen ", False), ("unseen", True), (" end", False)], [("two  \t spaces — here  ", False)]])
    rows = spark.createDataFrame([(1, bytearray(hidden))], "doc_id int, content binary")
    found = frames.word_findings(rows).collect()
    assert [(r.rule_id, r.orig) for r in found if r.rule_id == "inv.hidden"] == [("inv.hidden", "unseen")]
    assert not {r.rule_id for r in found} & word.DISABLED
