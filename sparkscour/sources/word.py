"""Word files: their text, what of it is hidden, where wording may change, and edits put back into the file."""

from __future__ import annotations

import copy
import io
import re
import zipfile
from collections.abc import Iterable
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkscour.operators.engine import Change
from sparkscour.operators.spans import Region

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Rules about the structure of lines, which Word's paragraphs do not have.
DISABLED = frozenset(
    "ws.edges ws.blank sp.sep sp.crlf md.heading md.bold md.italic md.code md.fence md.link md.list md.rule md.table"
    " md.mathdelim pu.bullet plain.md plain.tex plain.math ws.unwrap".split()
)
_PLAIN_TEXT_OFF = frozenset("delText instrText".split())
_WORDING_OFF = frozenset("hyperlink fldSimple ins del moveFrom moveTo sdt".split())
SMALLEST = 4  # half points
_NOT_XML = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


@dataclass
class Segment:
    """A run's text node, and where its text is in the whole."""

    start: int
    end: int
    node: ElementTree.Element
    part: str
    wording: bool


@dataclass
class WordFile:
    archive: dict[str, bytes]
    spaces: dict[str, dict[str, str]]  # of each part, the names that its prefixes stand for
    trees: dict[str, ElementTree.Element]
    text: str = ""
    segments: list[Segment] = field(default_factory=list)
    hidden: list[Region] = field(default_factory=list)


def _on(properties: ElementTree.Element, name: str) -> bool:
    found = properties.find(W + name)
    return found is not None and found.get(W + "val", "true") not in ("0", "false")


def _unseen(run: ElementTree.Element) -> bool:
    p = run.find(W + "rPr")
    if p is None:
        return False
    color, size = p.find(W + "color"), p.find(W + "sz")
    white = color is not None and color.get(W + "val", "").upper() in ("FFFFFF", "WHITE")
    number = re.fullmatch(r"\s*(\d+(?:\.\d*)?|\.\d+)\s*", size.get(W + "val", "")) if size is not None else None
    tiny = number is not None and float(number[1]) <= SMALLEST
    return _on(p, "vanish") or _on(p, "specVanish") or white or tiny


def _parts(names: Iterable[str]) -> list[str]:
    """The parts with text, the document first."""
    names = set(names)
    fixed = [f"word/{x}.xml" for x in ("document", "footnotes", "endnotes", "comments")]
    more = sorted(x for x in names if re.fullmatch(r"word/(?:header|footer)\d*\.xml", x))
    return [x for x in [*fixed, *more] if x in names]


class _Reader:
    """Walks one part in order; a paragraph inside another is a paragraph of its own, after the one it is in. A field may begin
    in one paragraph and end in another; an end without a beginning is none."""

    def __init__(self, word: WordFile, part: str):
        self.word, self.part = word, part
        self.depth = 0
        self.paragraphs: list[list[tuple[str, ElementTree.Element | None, bool, bool]]] = []

    def read(self) -> None:
        stack = [(self.word.trees[self.part], False)]
        while stack:
            node, fixed = stack.pop()
            if node.tag == W + "p":
                self._paragraph(node, fixed, stack)
            else:
                fixed = fixed or node.tag.rpartition("}")[2] in _WORDING_OFF
                stack.extend((x, fixed) for x in reversed(node))

    def _paragraph(self, p: ElementTree.Element, kept: bool, later: list[tuple[ElementTree.Element, bool]]) -> None:
        pieces: list[tuple[str, ElementTree.Element | None, bool, bool]] = []
        inner: list[tuple[ElementTree.Element, bool]] = []
        todo = [(x, False, kept) for x in reversed(p)]
        while todo:
            node, unseen, fixed = todo.pop()
            name = node.tag.removeprefix(W)
            if name == "p":
                inner.append((node, fixed))
            elif name == "fldChar":
                self.depth = max(0, self.depth + {"begin": 1, "end": -1}.get(node.get(W + "fldCharType", ""), 0))
            elif name == "t":
                pieces.append((node.text or "", node, unseen, not fixed and not unseen and not self.depth))
            elif name in ("tab", "br", "cr"):
                pieces.append(("\t" if name == "tab" else "\n", None, unseen, False))
            elif name not in _PLAIN_TEXT_OFF and name not in ("rPr", "pPr"):
                hidden = unseen or name == "r" and _unseen(node)
                todo.extend((x, hidden, fixed or name.rpartition("}")[2] in _WORDING_OFF) for x in reversed(node))
        self.paragraphs.append(pieces)
        later.extend(reversed(inner))


def load(data: bytes) -> WordFile:
    """A Word file; raises ValueError without a document in it."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            archive = {x: z.read(x) for x in z.namelist()}
    except zipfile.BadZipFile as e:
        raise ValueError("no Word file") from e
    if "word/document.xml" not in archive:
        raise ValueError("no Word file: word/document.xml is missing")
    parts = _parts(archive)
    spaces = {x: dict(name for _, name in ElementTree.iterparse(io.BytesIO(archive[x]), ["start-ns"])) for x in parts}
    word = WordFile(archive, spaces, {x: ElementTree.fromstring(archive[x]) for x in parts})
    _index(word)
    return word


def _index(word: WordFile) -> None:
    out: list[str] = []
    at = 0
    unseen: list[tuple[int, int]] = []
    for i, part in enumerate(word.trees):
        reader = _Reader(word, part)
        reader.read()
        for j, pieces in enumerate(reader.paragraphs):
            gap = "\n" if j else "\n\n" if i else ""
            out.append(gap)
            at += len(gap)
            for text, node, hidden, wording in pieces:
                if node is not None:
                    word.segments.append(Segment(at, at + len(text), node, part, wording))
                if hidden and text:
                    if unseen and at - unseen[-1][1] <= 1:
                        unseen[-1] = unseen[-1][0], at + len(text)
                    else:
                        unseen.append((at, at + len(text)))
                out.append(text)
                at += len(text)
    word.text = "".join(out)
    word.hidden = [Region("hidden", a, b) for a, b in unseen]


def wording_spans(word: WordFile) -> list[tuple[int, int]]:
    return [(s.start, s.end) for s in word.segments if s.wording and s.end > s.start]


def edit(word: WordFile, edits: Iterable[Change]) -> tuple[int, set[str]]:
    """Put edits into the runs, last first. How many were refused (a line end to insert, or one that the edit would touch),
    and the parts that changed. A text that spans runs goes into the first of them."""
    refused, touched = 0, set()
    for e in sorted(edits, key=lambda e: -e.start):
        if e.start == e.end:  # an insertion goes to the run that ends there, or else to one that it falls into
            beside = [s for s in word.segments if s.start <= e.start <= s.end]
            hit = ([s for s in beside if s.end == e.start] or beside)[:1]
        else:
            hit = [s for s in word.segments if s.start < e.end and s.end > e.start]
        inside = sum(min(s.end, e.end) - max(s.start, e.start) for s in hit)
        if "\n" in e.insert or not hit or inside != e.end - e.start:
            refused += 1
            continue
        for i, s in enumerate(hit):
            text = s.node.text or ""
            a, b = max(e.start, s.start) - s.start, min(e.end, s.end) - s.start
            s.node.text = text[:a] + (e.insert if not i else "") + text[b:]
            s.node.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
            touched.add(s.part)
    return refused, touched


def edit_passes(data: bytes, passes: Iterable[Iterable[Change]]) -> tuple[bytes, int]:
    """The file after passes of edits, each on the text that the one before left; and how many edits were refused."""
    word, refused, touched = load(data), 0, set()
    for edits in passes:
        more, parts = edit(word, edits)
        refused += more
        touched |= parts
        word.segments, word.hidden = [], []
        _index(word)
    return save(word, touched), refused


def _serialised(root: ElementTree.Element, spaces: dict[str, str]) -> bytes:
    """A part with the prefixes that it had, those without an element too: lists of extensions name them."""
    used = {x.rpartition("}")[0].removeprefix("{") for e in root.iter() for x in (e.tag, *e.attrib)}
    root = copy.copy(root)
    for prefix, name in spaces.items():
        if prefix and not re.fullmatch(r"ns\d+|xml", prefix):
            ElementTree.register_namespace(prefix, name)
            if name not in used:
                root.set(f"xmlns:{prefix}", name)
    return ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True)


def save(word: WordFile, touched: Iterable[str]) -> bytes:
    """The archive with the touched parts written anew, all others as they were."""
    out = io.BytesIO()
    touched = set(touched)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in word.archive.items():
            z.writestr(name, _serialised(word.trees[name], word.spaces[name]) if name in touched else data)
    return out.getvalue()


def made(paragraphs: Iterable[Iterable[tuple[str, bool]]]) -> bytes:
    """A plain Word file: paragraphs of runs (text, hidden). Characters that XML does not know are left out."""
    name = W.strip("{}")
    body = ElementTree.Element(W + "document")
    within = ElementTree.SubElement(body, W + "body")
    for runs in paragraphs:
        p = ElementTree.SubElement(within, W + "p")
        for text, hidden in runs:
            run = ElementTree.SubElement(p, W + "r")
            if hidden:
                ElementTree.SubElement(ElementTree.SubElement(run, W + "rPr"), W + "vanish")
            for i, part in enumerate(_NOT_XML.sub("", text).split("\t")):
                if i:
                    ElementTree.SubElement(run, W + "tab")
                ElementTree.SubElement(run, W + "t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"}).text = part
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", _serialised(body, {"w": name}))
    return out.getvalue()


SPAN = "array<struct<start: int, end: int>>"


def told(e: Exception) -> str:
    return f"{type(e).__name__}: {e}" if str(e) else type(e).__name__


def word_text(content: Column) -> Column:
    """struct<text, hidden, wording, error> of a binary column of Word files. What cannot be read (null, damaged, encrypted) has
    an error and a null text."""

    @F.pandas_udf(f"struct<text: string, hidden: {SPAN}, wording: {SPAN}, error: string>")
    def run(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for data in contents:
            try:
                word = load(data or b"")
                rows.append((word.text, [{"start": r.start, "end": r.end} for r in word.hidden], [{"start": a, "end": b} for a, b in wording_spans(word)], None))
            except Exception as e:  # one bad file must not end the job
                rows.append((None, [], [], told(e)))
        return pd.DataFrame(rows, columns=["text", "hidden", "wording", "error"])

    return run(content)


def edited_word(content: Column, passes: Column) -> Column:
    """struct<content, refused, error> of Word files with the passes that a cleaning of their texts gave; null passes are none."""

    @F.pandas_udf("struct<content: binary, refused: int, error: string>")
    def run(contents: pd.Series, all_passes: pd.Series) -> pd.DataFrame:
        rows = []
        for data, passes in zip(contents, all_passes, strict=True):
            try:
                rows.append((*edit_passes(data or b"", [[Change(e["start"], e["end"], e["insert"]) for e in p] for p in (passes if passes is not None else [])]), None))
            except Exception as e:  # one bad file must not end the job
                rows.append((None, None, told(e)))
        return pd.DataFrame({"content": [r[0] for r in rows], "refused": pd.array([r[1] for r in rows], dtype="Int32"), "error": [r[2] for r in rows]})

    return run(content, passes)
