"""Regular expressions with the meaning that they have in a browser: what is a space, a line end or a word character."""

from __future__ import annotations

from functools import cache

import regex

# White space and line ends of the pattern dialect.
SPACES = "\\t\\n\\x0B\\x0C\\r \\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
LINE_ENDS = "\\n\\r\\u2028\\u2029"

# Script classes.
_JOINING = "Arabic Syriac Nko Mongolian Bengali Devanagari Gurmukhi Gujarati Oriya Tamil Telugu Kannada Malayalam Sinhala Khmer Myanmar Tibetan Hebrew Thaana Mandaic Manichaean Psalter_Pahlavi Adlam"
_RTL = "Hebrew Arabic Syriac Thaana Nko Adlam"
_FOREIGN = "Cyrillic Greek Armenian"
_CJK = "Han Hiragana Katakana Hangul"


def scripts(names: str) -> str:
    return "".join(rf"\p{{Script={x}}}" for x in names.split())


JOINING = scripts(_JOINING)
RTL = scripts(_RTL)
FOREIGN = scripts(_FOREIGN)
CJK = scripts(_CJK) + r"\u3000-\u303F\uFF61-\uFF9F"
EMOJI_PART = r"\p{Extended_Pictographic}\p{Emoji_Modifier}\uFE0F\u20E3"


_WITHIN = {r"\s": SPACES, r"\w": "A-Za-z0-9_", r"\d": "0-9", r"\S": r"\S"}
_ALONE = {
    r"\s": f"[{SPACES}]",
    r"\S": f"[^{SPACES}]",
    r"\w": "[A-Za-z0-9_]",
    r"\W": "[^A-Za-z0-9_]",
    r"\d": "[0-9]",
    r"\D": "[^0-9]",
    r"\b": "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))",
}


def translated(pattern: str, multiline: bool) -> str:
    """``pattern`` with classes and anchors spelled out, so that no flag of the engine changes them."""
    start = rf"(?:\A|(?<=[{LINE_ENDS}]))" if multiline else r"\A"
    end = rf"(?=[{LINE_ENDS}]|\Z)" if multiline else r"\Z"
    out, at, inside = [], 0, False
    while at < len(pattern):
        c = pattern[at]
        pair = pattern[at : at + 2]
        if c == "\\":
            out.append((_WITHIN if inside else _ALONE).get(pair, pair))
            at += 2
            continue
        if inside:
            inside = c != "]"
            out.append(rf"\{c}" if c == "[" else c)
        elif c == "[":
            inside = True
            out.append(c)
        else:
            out.append({"^": start, "$": end, ".": f"[^{LINE_ENDS}]"}.get(c, c))
        at += 1
    return "".join(out)


@cache
def js(pattern: str, flags: str = "") -> regex.Pattern:
    """Compiled pattern; flags: m (anchors at lines), i (case of ASCII letters does not matter)."""
    kinds = regex.V0 | (regex.IGNORECASE if "i" in flags else 0)
    return regex.compile(translated(pattern, "m" in flags), kinds)
