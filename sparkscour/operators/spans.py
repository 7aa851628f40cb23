"""Regions of a text: what is mathematics, code, comments, keys, command names and addresses."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cached_property
from typing import NamedTuple

from sparkscour.functions.patterns import js


class Region(NamedTuple):
    type: str
    start: int
    end: int


class Cover:
    """The union of spans, for questions about points and overlaps."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self._starts: list[int] = []
        self._ends: list[int] = []
        for a, b in sorted((a, b) for a, b in spans if a < b):
            if self._ends and a <= self._ends[-1]:
                self._ends[-1] = max(self._ends[-1], b)
            else:
                self._starts.append(a)
                self._ends.append(b)

    def has(self, at: int) -> bool:
        i = bisect_right(self._starts, at) - 1
        return i >= 0 and at < self._ends[i]

    def meets(self, start: int, end: int) -> bool:
        """Whether [start, end) shares a character with the union; an empty span is the point it stands at."""
        if start == end:
            return self.has(start)
        i = bisect_right(self._starts, end - 1) - 1
        return i >= 0 and self._ends[i] > start


# LaTeX environments and commands whose content or first argument is not prose.
MATH_ENVIRONMENTS = frozenset(
    "equation equation* align align* alignat alignat* gather gather* multline multline* flalign flalign* eqnarray eqnarray*"
    " math displaymath dmath dmath* split subequations".split()
)
VERBATIM_ENVIRONMENTS = frozenset(
    "verbatim verbatim* Verbatim lstlisting minted comment filecontents filecontents* alltt BVerbatim LVerbatim code"
    " tikzpicture forest".split()
)
KEY_COMMANDS = frozenset(
    "cite citep citet citealp citealt citeauthor citeyear citeyearpar parencite textcite autocite footcite fullcite nocite"
    " Cite Citep Citet supercite smartcite cites ref eqref pageref autoref cref Cref crefrange nameref vref label url href"
    " hyperref hypertarget hyperlink input include includeonly includegraphics includepdf import subimport usepackage"
    " RequirePackage documentclass bibliography bibliographystyle addbibresource usetikzlibrary graphicspath newcommand"
    " renewcommand providecommand newenvironment renewenvironment DeclareMathOperator def let setlength addtolength"
    " setcounter addtocounter hspace vspace color textcolor definecolor pagestyle thispagestyle pagenumbering newtheorem"
    " lstinputlisting inputminted glsadd gls Gls glspl acrshort acrlong acrfull ac acp Ac SI si num qty unit".split()
)
_INLINE_VERBATIM = frozenset("verb lstinline mintinline".split())


def closing(text: str, at: int, pair: str = "{}") -> int:
    """Just past the bracket that closes the one at ``at``; the end of the text if none does."""
    depth = 0
    for m in js(r"\\[\s\S]?|[\[\]{}]").finditer(text, at):
        if m[0] == pair[0]:
            depth += 1
        elif m[0] == pair[1]:
            depth -= 1
            if not depth:
                return m.end()
    return len(text)


def _after(text: str, mark: str, at: int) -> int:
    found = text.find(mark, at)
    return len(text) if found < 0 else found + len(mark)


_TEX_EVENT = js(r"%[^\n]*|\$\$|\$|\\(?:[A-Za-z@]+|[\s\S]|\Z)")
_DOLLAR_END = js(r"(?:\\[\s\S]|(?!\n\n)[^$\\])*+(\$|\Z|(?=\n\n))")


def _tex_command(text: str, start: int, name: str, end: int) -> Iterator[Region | int]:
    """Regions of one command, then (as a number) where to go on."""
    yield Region("cmd", start, end)
    if name in _INLINE_VERBATIM:
        at = end + (text[end : end + 1] == "*")
        if name == "mintinline" and text[at : at + 1] == "{":
            at = closing(text, at)
        mark = text[at : at + 1]
        if mark in ("", "\n"):
            yield end
            return
        stop = closing(text, at) if mark == "{" else _after(text, mark, at + 1)
        yield Region("verbatim", start, stop)
        yield stop
    elif name in ("begin", "end") and text[end : end + 1] == "{":
        stop = closing(text, end)
        yield Region("keys", end, stop)
        of = text[end + 1 : stop - 1]
        if name == "begin" and (of in MATH_ENVIRONMENTS or of in VERBATIM_ENVIRONMENTS):
            stop = _after(text, f"\\end{{{of}}}", stop)
            yield Region("math" if of in MATH_ENVIRONMENTS else "verbatim", start, stop)
        yield stop
    elif name in KEY_COMMANDS:
        at = js(r"\*?(?:(?!\n)\s)*").match(text, end).end()
        while text[at : at + 1] == "[":
            at = js(r" *").match(text, closing(text, at, "[]")).end()
        if text[at : at + 1] == "{":
            stop = closing(text, at)
            yield Region("keys", at, stop)
            at = stop
        yield at
    else:
        yield end


def tex_regions(text: str) -> list[Region]:
    out: list[Region] = []
    at = 0
    while m := _TEX_EVENT.search(text, at):
        start, at, what = m.start(), m.end(), m[0]
        if what[0] == "%":
            out.append(Region("comment", start, at))
        elif what == "$$":
            at = _after(text, "$$", at)
            out.append(Region("math", start, at))
        elif what == "$":
            end = _DOLLAR_END.match(text, at)
            if end and end[1] == "$":
                at = end.end()
                out.append(Region("math", start, at))
        elif what in (r"\(", r"\["):
            at = _after(text, r"\)" if what == r"\(" else r"\]", at)
            out.append(Region("math", start, at))
        elif js(r"\\[A-Za-z@]").match(what):
            for found in _tex_command(text, start, what[1:], at):
                if isinstance(found, Region):
                    out.append(found)
                else:
                    at = found
        if at <= start:
            at = start + 1
        if at >= len(text):
            break
    return [r for r in out if r.end > r.start]


# Inline Markdown that is no prose.
_MARKDOWN_INLINE = (
    (js(r"(`+)(?!`)[\s\S]*?[^`]\1(?!`)"), "verbatim"),
    (js(r"<!--[\s\S]*?-->"), "comment"),
    (js(r"\$\$[\s\S]+?\$\$"), "math"),
    (js(r"(?<![\\$\w])\$(?![\s$])(?:\\.|[^$\\\n])+?(?<!\s)\$(?!\w)"), "math"),
    (js(r"\\\([\s\S]+?\\\)"), "math"),
    (js(r"\\\[[\s\S]+?\\\]"), "math"),
    (js(r'\]\([^)\s]*(?:\s+"[^"]*")?\)'), "keys"),
    (js(r"^\s*\[[^\]]+\]:\s*\S+.*$", "m"), "keys"),
    (js(r"<\/?[A-Za-z][^>\n]*>"), "keys"),
)
_FENCE = js(r" {0,3}(`{3,}|~{3,})([^\r\n]*)\r?\n?\Z")


def fences(text: str) -> list[Region]:
    """Front matter and fenced code; an open fence runs to the end."""
    out = []
    if front := js(r"---\n[\s\S]*?\n---\n").match(text):
        out.append(Region("verbatim", 0, front.end()))
    if "```" not in text and "~~~" not in text:
        return out
    mark, start, at = "", 0, 0
    for line in text.splitlines(keepends=True) if "\r" not in text and not js(r"[\x0B\x0C\x1C-\x1E\x85\u2028\u2029]").search(text) else js(r"[^\n]*\n|[^\n]+").findall(text):
        if mark:
            if js(rf" {{0,3}}{mark[0]}{{{len(mark)},}}[ \t]*\r?\n?\Z").match(line):
                out.append(Region("verbatim", start, at + len(line)))
                mark = ""
        elif (m := _FENCE.match(line)) and not (m[1][0] == "`" and "`" in m[2]):
            mark, start = m[1], at
        at += len(line)
    if mark:
        out.append(Region("verbatim", start, len(text)))
    return out


def markdown_regions(text: str) -> list[Region]:
    found = [Region(kind, *m.span()) for pattern, kind in _MARKDOWN_INLINE for m in pattern.finditer(text)]
    return fences(text) + [r for r in found if r.end > r.start]


_BIB = (
    (js(r"@[A-Za-z]+\s*[{(][^,\n]*,"), "keys"),
    (js(r"^\s*[A-Za-z_-]+\s*=", "m"), "keys"),
    (js(r'\b(?:url|doi|eprint|file|isbn|issn|pdf|howpublished)\s*=\s*(?:\{(?:[^{}]|\{[^{}]*\})*\}|"[^"]*")', "i"), "keys"),
    (js(r"(?<!\\)%.*$", "m"), "comment"),
)


def bib_regions(text: str) -> list[Region]:
    out = [Region(kind, *m.span()) for pattern, kind in _BIB for m in pattern.finditer(text)]
    return out + [r for r in tex_regions(text) if r.type == "math"]


_URL = js(r"\b(?:https?:\/\/|www\.|doi:\s?10\.)[^\s<>\"'`{}|\\^\]]+[^\s<>\"'`{}|\\^\].,;:!?)]", "i")
_EMAIL = js(r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b")


def url_regions(text: str) -> list[Region]:
    out = [Region("url", *m.span()) for m in _URL.finditer(text)] if "://" in text or "." in text else []
    return out + ([Region("url", *m.span()) for m in _EMAIL.finditer(text)] if "@" in text else [])


def regions(text: str, kind: str) -> list[Region]:
    """By start, longest first."""
    own = {"tex": tex_regions, "md": markdown_regions, "bib": bib_regions}.get(kind, lambda _: [])(text)
    return sorted(own + url_regions(text), key=lambda r: (r.start, -r.end))


# Quotations, links and citations, which wording rules leave alone in any file.
_QUOTED = (
    js(r"!?\[[^\]\n]*\](?:\([^\n)]*\)|\[[^\]\n]*\])|\\(?:href|hyperlink)\{[^}\n]*\}\{[^}\n]*\}"),
    js(r"\"(?:\\.|[^\"\\])*\"|\u201C[^\u201D]*\u201D|\u2018[^\u2019]*\u2019|(?<!\w)'[^'\n]+'(?!\w)|``[\s\S]*?''"),
    js(r"^\s*>[^\n]*|\\begin\{(quote|quotation)\}[\s\S]*?\\end\{\1\}", "m"),
    js(r"\[(?:\d+[a-z]?(?:\s*[,;\u2013-]\s*\d+[a-z]?)*)\]|\([A-Z][^()\n]{0,120}\b(?:19|20)\d{2}[a-z]?[^()\n]*\)"),
)
_REFERENCES = js(r"^(?:#{1,6}[ \t]+)?(?:References|Bibliography)[ \t]*\r?$", "im")
_HEADING = js(r"^#{1,6}[ \t]+", "m")


class Wording:
    """Spans that wording rules must not touch; found when first asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def cover(self) -> Cover:
        text = self.text
        spans = [(r.start, r.end) for r in tex_regions(text) + markdown_regions(text) + url_regions(text)]
        for m in _REFERENCES.finditer(text):
            following = _HEADING.search(text[m.end() :])
            spans.append((m.start(), m.end() + following.start() if following else len(text)))
        spans += [m.span() for pattern in _QUOTED for m in pattern.finditer(text)]
        return Cover(spans)
