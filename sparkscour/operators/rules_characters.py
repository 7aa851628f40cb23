"""Rules for characters: invisible ones, encoding damage, spaces, whitespace, punctuation and lookalike letters."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import regex

from sparkscour.functions.patterns import CJK, EMOJI_PART, FOREIGN, JOINING, RTL, js
from sparkscour.operators.finders import LEAVE, Needed, ask, every
from sparkscour.operators.page import Page
from sparkscour.plans.rules import ALL, DELETE, NOT_KEEP, Match, Rule

PLAIN_OR_TEX = frozenset(["latex", "plain"])

# ---- invisible characters ----

# How colours and sizes say that text cannot be seen, and phrases that address a model.
_WHITE = r"(?:white|White|#?[fF]{3}(?:[fF]{3})?|1\s*,\s*1\s*,\s*1|255\s*,\s*255\s*,\s*255)"
_TEX_WHITE = js(r"\\textcolor(?:\[[a-zA-Z]+\])?\{" + _WHITE + r"\}\{")
_TEX_COLOR = js(r"\\color(?:\[[a-zA-Z]+\])?\{" + _WHITE + r"\}")
_TEX_TINY = js(r"\\(?:fontsize\{0?\.\d+\s*(?:pt)?\}\{[^}]*\}(?:\\selectfont)?|scalebox\{0?\.0\d*\}|resizebox\{0?\.0\d*\S*?\}\{[^}]*\})")
_HTML_HIDDEN = js(
    r'<(span|div|p|font|small)\b[^>]*?(?:style\s*=\s*"[^"]*?(?:color\s*:\s*(?:white|#fff(?:fff)?|rgb\(\s*255\s*,\s*255\s*,\s*255\s*\))'
    r'|font-size\s*:\s*0(?:\.\d+)?(?:px|pt|em|rem)?\s*[;"]|display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?:\.0+)?\s*[;"])[^"]*"'
    r'|color\s*=\s*"(?:white|#fff(?:fff)?)")[^>]*>[\s\S]{0,2000}?</\1>',
    "i",
)
INJECTION = (
    r"\b(?:ignore (?:all |any )?(?:previous|prior|above) (?:instructions|prompts)|give (?:a |only )?positive review"
    r"|do not (?:highlight|mention) (?:any )?(?:negatives|weaknesses)|(?:as|for) (?:an? )?(?:AI|LLM) (?:reviewer|model|assistant)s?,"
    r"|recommend accept(?:ing|ance of) this paper)\b"
)


def _group_end(text: str, at: int) -> int | None:
    """Just past the brace that closes the one at ``at``; None if it stays open."""
    depth = 0
    for m in js(r"\\[\s\S]?|[{}]").finditer(text, at):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if m[0] == "}" and not depth:
            return m.end()
    return None


#: Words that an instruction to a model holds.
_INJECTED = Needed(["ignore instructions", "ignore prompts", "positive review", "not negatives", "not weaknesses", "recommend paper"] + [f"{a} {b}{c}" for a in ("ai", "llm") for b in ("reviewer", "model", "assistant") for c in ("", "s")])


def hidden(page: Page) -> Iterable[Match]:
    text, unseen = page.text, "Readers do not see this; programs that read the file do."
    for r in page.regions:
        if r.type == "hidden":
            yield Match(r.start, r.end, None, (DELETE,), "Hidden in the document.")
    if page.kind == "tex":
        for m in _TEX_WHITE.finditer(text):
            if end := _group_end(text, m.end() - 1):
                yield Match(m.start(), end, None, (DELETE,), unseen)
        for m in _TEX_COLOR.finditer(text):
            if page.within("comment", m.start()):
                continue
            brace = text.rfind("{", 0, m.start())
            end = _group_end(text, brace) if brace >= 0 and not text[brace + 1 : m.start()].strip() else None
            yield Match(brace, end, None, (DELETE,), unseen) if end else Match(*m.span(), None, (), unseen)
        for m in _TEX_TINY.finditer(text):
            if not page.within("comment", m.start()):
                yield Match(*m.span(), None, (), "Scaled to almost nothing. " + unseen)
    elif "<" in text:
        for m in _HTML_HIDDEN.finditer(text):
            yield Match(*m.span(), None, (DELETE,), unseen)
    for m in js(INJECTION, "i").finditer(text) if _INJECTED.may_be(page) else ():
        if not any(r.type == "hidden" and r.start <= m.start() < r.end for r in page.regions):
            yield Match(*m.span(), None, (), "Reads like an instruction to a model; it may be a quotation.")


def _zero_width(m: regex.Match, page: Page) -> object:
    return LEAVE if m[0] == "\ufeff" and not m.start() else ""


def _joiner(m: regex.Match, page: Page) -> object:
    around = page.before(m.start()), page.at(m.end())
    if any(js(f"[{JOINING}]").match(c) for c in around):
        return LEAVE
    return LEAVE if m[0] == "\u200d" and all(js(f"[{EMOJI_PART}]").match(c) for c in around) else ""


def _soft_hyphen(m: regex.Match, page: Page) -> object:
    return r"\-" if page.output == "tex" and page.option == r"\-" and not page.protected(m.start()) else ""


def _direction(m: regex.Match, page: Page) -> object:
    return LEAVE if js(f"[{RTL}]").search(page.line_text(m.start())) else ""


def tag_text(tags: str) -> str:
    """What tag characters spell."""
    return "".join(chr(ord(c) - 0xE0000) for c in tags if 0xE0020 <= ord(c) <= 0xE007E)


def _tags(m: regex.Match, page: Page) -> object:
    return LEAVE if page.before(m.start()) == "\U0001f3f4" and js(r"[\U000E0061-\U000E007A]+\U000E007F\Z").match(m[0]) else ""


def selector_bytes(selectors: str) -> str:
    """What variation selectors spell, each being a byte."""
    found = bytes(ord(c) - 0xFE00 if ord(c) <= 0xFE0F else ord(c) - 0xE0100 + 16 for c in selectors)
    return found.decode("utf-8", "replace")


def _selector(m: regex.Match, page: Page) -> object:
    if len(m[0]) > 1:
        return ""
    before, code = page.before(m.start()), ord(m[0])
    if code in (0xFE0E, 0xFE0F):
        kept = js(r"\p{Emoji}").match(before)
    elif code >= 0xE0100:
        kept = js(f"[{CJK}]").match(before)
    else:
        kept = before and not js(r"[\s\x21-\x7E]").match(before)
    return LEAVE if kept else ""


def _filler(m: regex.Match, page: Page) -> object:
    before, after = page.before(m.start()), page.at(m.end())
    near = lambda chars: js(f"[{chars}]").match(before) or js(f"[{chars}]").match(after)
    if m[0] == "\u2800" and near(r"\u2801-\u28FF") or m[0] in "\u115f\u1160" and near(r"\u1100-\u11FF"):
        return LEAVE
    return " " if m[0] in "\u2800\u3164\uffa0" and js(r"\S").match(before) and js(r"\S").match(after) else ""


def _format_mark(m: regex.Match, page: Page) -> object:
    return LEAVE if "\u180b" <= m[0] <= "\u180f" and js(r"\p{Script=Mongolian}").match(page.before(m.start())) else ""


#: Ignorable characters that the rules before ``inv.other`` account for.
_EXPLAINED = (
    r"\u00AD\u034F\u061C\u115F\u1160\u17B4\u17B5\u180B-\u180F\u200B-\u200F\u202A-\u202E\u2060-\u2064\u2066-\u206F\u3164"
    r"\uFE00-\uFE0F\uFEFF\uFFA0\uFFF9-\uFFFB\U0001D173-\U0001D17A\U000E0000-\U000E0FFF"
)

INVISIBLE = [
    Rule("inv.hidden", "text styled to be unseen, and phrases meant for a model", ALL, hidden),
    Rule("inv.zw", "zero-width spaces, word joiners and byte order marks inside a text", ALL, every(r"[\u200B\u2060\uFEFF]", _zero_width)),
    Rule("inv.joiner", "joiners outside the scripts and emoji that need them", ALL, every(r"[\u200C\u200D]", _joiner)),
    Rule("inv.shy", "soft hyphens", ALL, every(r"\u00AD", _soft_hyphen), options={"latex": ""}),
    Rule("inv.bidi", "direction controls on lines without right-to-left script", ALL, every(r"[\u200E\u200F\u061C\u202A-\u202E\u2066-\u2069]", _direction, note=lambda m, p: "Overrides can disguise text." if m[0] in "\u202d\u202e" else None)),
    Rule("inv.tag", "tag characters that spell hidden text", ALL, every(r"[\U000E0000-\U000E007F]+", _tags, note=lambda m, p: f'Spells "{tag_text(m[0])}".' if tag_text(m[0]) else None)),
    Rule("inv.vs", "variation selectors that select nothing", ALL, every(r"[\uFE00-\uFE0F\U000E0100-\U000E01EF]+", _selector, note=lambda m, p: f"{len(m[0])} in a row; as bytes: {selector_bytes(m[0])!r}." if len(m[0]) > 1 else None)),
    Rule("inv.filler", "blank letters: Hangul fillers, the empty braille cell, Khmer inherent vowels", ALL, every(r"[\u115F\u1160\u3164\uFFA0\u2800\u17B4\u17B5]", _filler)),
    Rule("inv.format", "other marks of format that show nothing", ALL, every(r"[\u034F\u2061-\u2064\u206A-\u206F\uFFF9-\uFFFC\u180B-\u180F\U0001D173-\U0001D17A]", _format_mark)),
    Rule("inv.ctrl", "control characters; vertical tab and form feed end a line", ALL, every(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x84\x86-\x9F]", lambda m, p: "\n" if m[0] in "\x0b\x0c" else "")),
    Rule("inv.pua", "characters for private use", ALL, every(r"[\uE000-\uF8FF\U000F0000-\U000FFFFD\U00100000-\U0010FFFD]", lambda m, p: "" if "\ue200" <= m[0] <= "\ue202" else None, suggest=(DELETE,))),
    Rule("inv.other", "any other character that shows nothing", ALL, ask(rf"(?![{_EXPLAINED}])[\p{{Cf}}\p{{Default_Ignorable_Code_Point}}]")),
]

# ---- encoding damage ----

# The characters of Windows-1252 for the bytes 80-9F that it defines.
_CP1252 = {bytes([b]).decode("cp1252"): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_CONTINUED = r"\u0080-\u00BF" + "".join(rf"\u{ord(c):04X}" for c in _CP1252)
_MOJIBAKE = js(rf"(?:[\u00C2-\u00F4][{_CONTINUED}]{{1,3}})+")


def repaired(text: str) -> str | None:
    """The UTF-8 text whose bytes were read as Windows-1252; None if they are none."""
    codes = [_CP1252.get(c, ord(c)) for c in text]
    if max(codes, default=0) > 0xFF:
        return None
    try:
        out = bytes(codes).decode("utf-8")
    except UnicodeDecodeError:
        return None
    return None if out == text or js(r"[\x80-\x9F]").search(out) else out


def _mojibake(page: Page) -> Iterable[Match]:
    for m in _MOJIBAKE.finditer(page.text):
        if (fixed := repaired(m[0])) is not None:
            yield Match(*m.span(), fixed, note="Saved in one encoding, opened in another.")


def _composed(m: regex.Match, page: Page) -> object:
    return unicodedata.normalize("NFC", m[0])


ENCODING = [
    Rule("enc.mojibake", "UTF-8 that was read as Windows-1252", ALL, _mojibake),
    Rule("enc.replacement", "marks of characters that were lost", ALL, ask(r"\uFFFD+")),
    Rule("enc.nfc", "letters with separate accents", ALL, every(r"\p{L}\p{M}+", _composed)),
]

# ---- spaces and whitespace ----


def _no_break(m: regex.Match, page: Page) -> object:
    return "~" if page.output == "tex" and page.option == "~" and not page.protected(m.start()) else " "


def _odd_space(m: regex.Match, page: Page) -> object:
    wide = m[0] == "\u3000" and any(js(f"[{CJK}]").match(c) for c in (page.before(m.start()), page.at(m.end())))
    return LEAVE if wide else " "


SPACES = [
    Rule("sp.nbsp", "no-break spaces", ALL, every(r"\u00A0", _no_break), options={"latex": "~", "markdown": " ", "plain": " ", "keep": " "}),
    Rule("sp.odd", "narrow, thin and other spaces", ALL, every(r"[\u202F\u2000-\u200A\u205F\u1680\u3000]", _odd_space)),
    Rule("sp.sep", "line and paragraph separators", ALL, every(r"[\u2028\u2029\u0085]", lambda m, p: "\n\n" if m[0] == "\u2029" else "\n")),
    Rule("sp.crlf", "carriage returns", ALL, every(r"\r\n?", "\n", needs="\r")),
]

# Lines that begin a block, and lines that nothing is joined to.
_BLOCK = js(r"[ \t]*(?:[-*+\u2022]\s|\d{1,3}[.)]\s|#{1,6}\s|>|\||```|~~~|\\(?:item|begin|end|section|subsection|chapter|paragraph)\b|[ \t]{4})")
_ALONE = js(r"[ \t]*(?:#{1,6}\s|\||```|~~~)")


def _wrapped(page: Page) -> Iterable[Match]:
    """Line ends inside a paragraph."""
    lines, at = page.text.split("\n"), 0
    for line, following in zip(lines, lines[1:], strict=False):
        end = at + len(line)
        at = end + 1
        if not line.strip() or not following.strip() or page.protected(end):
            continue
        if _BLOCK.match(following) or _ALONE.match(line) or line.endswith(("  ", "\\")):
            continue
        if js(r"[A-Za-z]-$").search(line) and js(r"[a-z]").match(following):
            yield Match(end - 1, end + 1, None, (DELETE, "-"), "One word, or two with a hyphen?")
        else:
            yield Match(end, end + 1, " ")


def _column(page: Page, start: int, end: int) -> bool:
    """Whether a run of spaces lines up with one on the line above or below."""
    first, last = page.line(start)
    column = end - first
    beside = []
    if first > 1:
        beside.append(page.line_text(first - 1))
    if last < len(page.text):
        beside.append(page.line_text(last + 1))
    return any(line[max(0, column - 2) : column] == "  " and js(r"\S").match(line[column : column + 1]) for line in beside)


def _edges(page: Page) -> Iterable[Match]:
    text = page.text
    lead = js(r"(?:[ \t]*\n)+").match(text)
    if lead:
        yield Match(*lead.span(), "")
    kept = len(text.rstrip(" \t\n"))
    tail = text[kept:]
    if not text or tail == "\n":
        return
    if tail.count("\n") >= 2:
        start = kept + tail.index("\n")
    elif "\n" not in tail and kept and js(r"\S").match(text[kept - 1]):
        start = kept
    else:
        return
    if not (lead and start < lead.end()):
        yield Match(start, len(text), "\n")


WHITESPACE = [
    Rule("ws.unwrap", "lines broken inside a paragraph", frozenset(), _wrapped, "text", ("txt", "md")),
    Rule("ws.trailing", "spaces at the end of a line", ALL, every(r"[ \t]+(?=[\p{Cf}\u00AD\u2800\u3164]*$)", lambda m, p: LEAVE if p.within("verbatim", m.start()) else "", "m")),
    Rule("ws.multi", "repeated spaces between words", ALL, every(r"(?<=[^\s]) {2,}(?=[^\s\p{Cf}\u00AD])", lambda m, p: LEAVE if _column(p, *m.span()) else " "), "text"),
    Rule("ws.punct", "a space before a punctuation mark", NOT_KEEP, every(r"(?<=[\p{L}\p{N}\)\]'\"])[ \t]+(?=[,.;)\]](?:\s|$))", lambda m, p: LEAVE if p.within("cmd", m.end()) else "", "m"), "text"),
    Rule("ws.blank", "more than one blank line", ALL, every(r"\n(?:[ \t]*\n){2,}", lambda m, p: LEAVE if p.within("verbatim", m.start() + 1) else "\n\n")),
    Rule("ws.edges", "blank lines at the start, and other than one line end at the end", ALL, _edges),
]

# ---- punctuation ----


def _opens(page: Page, at: int) -> bool:
    """Whether a quotation mark opens: at the start, after a space, a bracket, a dash or another opening mark."""
    before = page.before(at)
    return not before or bool(js(r"[\s(\[{<~\-\u2013\u2014/\u201C\u2018`]").match(before))


def _em_dash(m: regex.Match, page: Page) -> object:
    option = page.option if page.option is not None else " - "
    if option == "review":
        return None
    if option == "---" and page.output != "tex":
        return " - "
    start, _ = page.line(m.start())
    return option if page.text[start : m.start()].strip() else option.lstrip()


def _double_quote(m: regex.Match, page: Page) -> object:
    if m[0] == "\u2033" and js(r"\d").match(page.before(m.start())):
        return LEAVE
    return '"' if page.output != "tex" else "``" if _opens(page, m.start()) else "''"


def _single_quote(m: regex.Match, page: Page) -> object:
    before = page.before(m.start())
    if m[0] in "\u2032\u02bc" and not js("[A-Za-z]").match(before):
        return LEAVE
    return "`" if page.output == "tex" and not js("[A-Za-z0-9]").match(before) and _opens(page, m.start()) else "'"


def _minus(m: regex.Match, page: Page) -> object:
    return "$-$" if m[0] == "\u2212" and page.output == "tex" and js(r"\d").match(page.at(m.end())) else "-"


# What arrows and symbols are in LaTeX and in plain text.
ARROWS_TEX = dict(zip("→←↔⇒⇐⇔↑↓⟶⟹➜➔", r"\rightarrow \leftarrow \leftrightarrow \Rightarrow \Leftarrow \Leftrightarrow \uparrow \downarrow \longrightarrow \Longrightarrow \rightarrow \rightarrow".split(), strict=True))
ARROWS_TXT = dict(zip("→←↔⇒⇐⇔⟶⟹➜➔", "-> <- <-> => <= <=> -> => -> ->".split(), strict=True))
SYMBOLS_MATH = dict(zip("≤≥≠≈±×÷∞µ≡∼≃≅∑∏∂∇∈∉∀∃∅∩∪⊂⊃⊆⊇¬∧∨", r"\leq \geq \neq \approx \pm \times \div \infty \mu \equiv \sim \simeq \cong \sum \prod \partial \nabla \in \notin \forall \exists \emptyset \cap \cup \subset \supset \subseteq \supseteq \neg \wedge \vee".split(), strict=True))
SYMBOLS_TEX = {"°": r"$^\circ$", "™": r"\texttrademark{}", "®": r"\textregistered{}", "©": r"\textcopyright{}", "§": r"\S{}", "¶": r"\P{}", "‰": r"\textperthousand{}", "√": r"$\sqrt{}$"} | {k: f"${v}$" for k, v in SYMBOLS_MATH.items()}
SYMBOLS_TXT = {"≤": "<=", "≥": ">=", "≠": "!=", "≈": "~", "±": "+/-", "×": "x", "÷": "/", "™": "(TM)", "®": "(R)", "©": "(C)"}


def _arrow(m: regex.Match, page: Page) -> object:
    return f"${ARROWS_TEX[m[0]]}$" if page.output == "tex" else ARROWS_TXT.get(m[0])


def _symbol(m: regex.Match, page: Page) -> object:
    if page.output == "tex":
        return SYMBOLS_TEX[m[0]]
    return LEAVE if page.output == "md" else SYMBOLS_TXT.get(m[0], LEAVE)


_THIN = r"[ \u00A0\u2009\u200A\u202F]*"
PUNCTUATION = [
    Rule("pu.em", "em dashes with the spaces around them", NOT_KEEP, every(_THIN + r"[\u2014\u2015\u2E3A\u2E3B]" + _THIN, _em_dash, suggest=lambda m, p: ("---", ", ", ": ", "; ", " (", " -- ") if p.output == "tex" else (", ", ": ", "; ", " - ", " (")), "text", options={"latex": "---", "markdown": " - ", "plain": " - ", "keep": " - "}),
    Rule("pu.en", "en dashes", NOT_KEEP, every(r"\u2013", lambda m, p: "--" if p.output == "tex" else "-"), "text"),
    Rule("pu.hyphen", "hyphens and minus signs of other kinds", ALL, every(r"[\u2010\u2011\u2012\u2043\u2212\uFE58\uFE63]", _minus), "text"),
    Rule("pu.dq", "curly double quotation marks", NOT_KEEP, every(r"[\u201C\u201D\u201E\u201F\u2033\u301D\u301E]", _double_quote), "text"),
    Rule("pu.sq", "curly single quotation marks and apostrophes", NOT_KEEP, every(r"[\u2018\u2019\u201A\u201B\u02BC\u2032]", _single_quote), "text"),
    Rule("pu.texquotes", "straight quotation marks in LaTeX", frozenset(["latex"]), every(r'"(?=\S)([^"\n]{1,300}?)(?<=\S)"', lambda m, p: LEAVE if p.protected(m.end() - 1) else f"``{m[1]}''"), "text", ("tex",), tex_output=True),
    Rule("pu.ellipsis", "the ellipsis character", NOT_KEEP, every(r"\u2026", lambda m, p: r"\ldots{}" if p.output == "tex" else "..."), "text"),
    Rule("pu.bullet", "bullet characters at the start of a line", ALL, every(r"^([ \t]*)[\u2022\u2023\u2043\u25E6\u25AA\u25AB\u25CF\u25CB\u25A0\u25A1\u25BA\u25B8\u27A2\u27A4\u2219\u2713\u2714\u2717\u2718\u00B7\u2B24\u2756\u2767\u27A1]\uFE0F?[ \t]*", lambda m, p: m[1] + "- ", "m"), "text"),
    Rule("pu.arrow", "arrows in prose", PLAIN_OR_TEX, every(f"[{''.join(ARROWS_TEX)}]", _arrow, suggest=(DELETE,)), "text"),
    Rule("pu.symbol", "mathematical and legal symbols in prose", PLAIN_OR_TEX, every(f"[{''.join(SYMBOLS_TEX)}]", _symbol, suggest=(DELETE,)), "text"),
]

# ---- letters ----

# Letters of other alphabets, and the Latin letters that they look like.
LOOKALIKES = (
    dict(zip("аеіјорсухѕԁԛԝһӏїүɡ", "aeijopcyxsdqwhliyg", strict=True))
    | dict(zip("АВЕКМНОРСТХІЈЅҮԚԜӀЗ", "ABEKMHOPCTXIJSYQWI3", strict=True))
    | dict(zip("οανρικυχϲϳ", "oavpikuxcj", strict=True))
    | dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX", strict=True))
    | dict(zip("օսհոզա", "ouhnqw", strict=True))
)


def _lookalikes(page: Page) -> Iterable[Match]:
    foreign = js(f"[{FOREIGN}]")
    if not foreign.search(page.text):
        return
    for word in js(r"[\p{L}\p{M}]+").finditer(page.text):
        letters = word[0]
        if not foreign.search(letters) or page.protected(word.start()):
            continue
        if js("[A-Za-z]").search(letters):
            for at, c in enumerate(letters, word.start()):
                if foreign.match(c):
                    plain = LOOKALIKES.get(c)
                    yield Match(at, at + 1, plain, () if plain else (DELETE,), f'In the Latin word "{letters}".')
        elif len(letters) > 1 and all(c in LOOKALIKES for c in letters):
            line = page.line_text(word.start())
            if len(js("[A-Za-z]").findall(line)) >= 4 * len(foreign.findall(line)):
                yield Match(*word.span(), None, ("".join(LOOKALIKES[c] for c in letters),), "Spelt with letters of another alphabet only.")


def _compatible(m: regex.Match, page: Page) -> object:
    if "\uff01" <= m[0] <= "\uff5e" and any(js(f"[{CJK}]").match(c) for c in (page.before(m.start()), page.at(m.end()))):
        return LEAVE
    return unicodedata.normalize("NFKC", m[0])


# Code points of the mathematical alphabets, and the commands that give them.
_ALPHABETS = ((0x1D400, r"\mathbf"), (0x1D434, ""), (0x1D468, r"\boldsymbol"), (0x1D49C, r"\mathcal"), (0x1D504, r"\mathfrak"), (0x1D538, r"\mathbb"), (0x1D56C, r"\mathfrak"), (0x1D5A0, r"\mathsf"), (0x1D670, r"\mathtt"), (0x1D6A4, ""), (0x1D6A8, r"\boldsymbol"), (0x1D6E2, ""), (0x1D7CE, r"\mathbf"), (0x1D7D8, r"\mathbb"), (0x1D7E2, r"\mathsf"), (0x1D7F6, r"\mathtt"), (0x1D800, ""))
_ALPHABET_OF = {c: command for chars, command in (("ℂℕℙℚℝℤ", r"\mathbb"), ("ℋℐℒℛℬℰℱℳ", r"\mathcal"), ("ℌℑℜℨℭ", r"\mathfrak")) for c in chars}


def alphabet_command(c: str) -> str:
    """The command whose letters look like this one; empty if none does."""
    if c in _ALPHABET_OF:
        return _ALPHABET_OF[c]
    return next((command for first, command in reversed(_ALPHABETS) if ord(c) >= first), "")


def _styled_suggestions(m: regex.Match, page: Page) -> tuple[str, ...]:
    plain, command = unicodedata.normalize("NFKC", m[0]), alphabet_command(m[0][0])
    return (f"{command}{{{plain}}}", plain) if command else (plain,)


LETTERS = [
    Rule("uf.homoglyph", "letters of other alphabets in Latin words", ALL, _lookalikes, "text"),
    Rule("uf.compat", "ligatures, full-width and other compatibility forms", ALL, every(r"[\uFB00-\uFB06\uFF01-\uFF5E\u2024\u2025\u2160-\u217F\uFE50-\uFE6B\u01C4-\u01CC\u01F1-\u01F3\u0132\u0133\u013F\u0140\u0149]", _compatible), "text"),
    Rule("uf.styled", "letters of the mathematical alphabets", ALL, every(r"[\U0001D400-\U0001D7FF\u2102\u210A-\u2113\u2115\u2119-\u211D\u2124\u2128\u212C\u212D\u212F-\u2131\u2133\u2134]+", lambda m, p: None if p.within("math", m.start()) else unicodedata.normalize("NFKC", m[0]), suggest=_styled_suggestions)),
]
