"""Built-in functions only: the profile, and cleanings that need no look at the surroundings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, as Java patterns: white space of the pattern dialect, commands of LaTeX, words, ends of sentences.
SPACE = r"[\t\n\x0B\x0C\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
TEX_COMMAND = r"\\[a-zA-Z]+\*?(\[[^\]]*\])?(\{[^}]*\})?"
WORD = r"[\p{L}\p{N}][\p{L}\p{N}'-]*"
TOKEN = r"[\p{L}\p{N}]+"
SENTENCE_END = rf"(?<=[.!?]){SPACE}+(?=[A-Z])|\n{SPACE}*\n"
SHORTEST_SENTENCE = 3


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def utf16_length(text: Column) -> Column:
    """Code units of UTF-16."""
    return (F.length(text) + F.length(F.regexp_replace(text, r"[\x{0}-\x{FFFF}]+", ""))).cast("int")


def paragraphs(text: Column, word: bool = False) -> Column:
    """Parts between blank lines that are not blank; of a Word file's text, lines that are not."""
    return F.size(F.filter(F.split(text, r"\n" if word else r"\n[ \t]*\n"), lambda p: p.rlike(rf"(?!{SPACE})[\s\S]")))


def sentence_lengths(text: Column) -> Column:
    """Words of each sentence that has a few."""
    parts = F.split(F.regexp_replace(text, TEX_COMMAND, " "), SENTENCE_END)
    return F.filter(F.transform(parts, lambda s: F.regexp_count(s, F.lit(TOKEN)).cast("long")), lambda n: n >= SHORTEST_SENTENCE)


def profile_parts(text: Column, word: bool = False) -> list[Column]:
    """What the profile is computed from (``word``: of Word files' texts), each part once: chars, words, paragraphs, dashes, and of the sentences n, s (sum of
    their lengths) and q (of their squares)."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("q"))
    sums = F.aggregate(sentence_lengths(text), none, lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")))
    dashes = F.length(text) - F.length(F.replace(text, F.lit("\u2014"), F.lit("")))
    return [utf16_length(text).alias("chars"), count(text, WORD).alias("words"), paragraphs(text, word).alias("paragraphs"), dashes.alias("dashes"), sums.alias("sums")]


def profile_columns() -> list[Column]:
    """chars, words, sentences, paragraphs, avg_sentence, burstiness (sample deviation by mean), em_dash_per_1k, from ``profile_parts``."""
    n, s, q = (F.col(f"sums.{x}") for x in "nsq")
    mean = F.when(n > 0, s / n).otherwise(0.0)
    spread = F.when(n > 1, F.sqrt((n * q - s * s) / (n * (n - 1)))).otherwise(0.0)
    return [
        F.col("chars"),
        F.col("words"),
        n.cast("int").alias("sentences"),
        F.col("paragraphs"),
        mean.alias("avg_sentence"),
        F.when(n > 0, spread / mean).otherwise(0.0).alias("burstiness"),
        F.when(F.col("words") > 0, F.col("dashes") / F.col("words") * 1000).otherwise(0.0).alias("em_dash_per_1k"),
    ]


#: Cleanings of single characters and spaces, in order; each needs to see only its own match.
BASIC = (
    (r"(?<=[\s\S])\x{FEFF}|[\x{200B}\x{2060}]", ""),
    (r"\x{AD}", ""),
    (r"[\x00-\x08\x0E-\x1F\x7F-\x{84}\x{86}-\x{9F}]", ""),
    (r"[\x0B\x0C]", "\n"),
    (r"\x{A0}", " "),
    (r"[\x{202F}\x{2000}-\x{200A}\x{205F}\x{1680}]", " "),
    (r"\x{2029}", "\n\n"),
    (r"[\x{2028}\x{85}]", "\n"),
    (r"\r\n?", "\n"),
    (r"(?m)[ \t]+(?=\n|\z)", ""),
    (r"\n(?:[ \t]*\n){2,}", "\n\n"),
)


def basic_cleaning(text: Column) -> Column:
    """Invisible characters, spaces, line ends and blank lines of plain text, without a Python worker."""
    for pattern, put in BASIC:
        text = F.regexp_replace(text, pattern, put)
    return text


# Rules for plain text that need no parser and no Unicode tables beyond Java's: pattern, and what stays (None: a reader decides).
_CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\x{3000}-\x{303F}\x{FF61}-\x{FF9F}"
RULES: dict[str, tuple[str, str | None]] = {
    "inv.zw": (r"[\x{200B}\x{2060}\x{FEFF}](?<!\A\x{FEFF})", ""),  # looks back only from such a character
    "inv.shy": (r"\x{AD}", ""),
    "inv.format": (r"[\x{34F}\x{2061}-\x{2064}\x{206A}-\x{206F}\x{FFF9}-\x{FFFC}\x{1D173}-\x{1D17A}]|(?<!\p{IsMongolian})[\x{180B}-\x{180F}]", ""),
    "enc.replacement": (r"\x{FFFD}+", None),
    "sp.nbsp": (r"\x{A0}", " "),
    "sp.odd": (rf"[\x{{202F}}\x{{2000}}-\x{{200A}}\x{{205F}}\x{{1680}}]|(?<![{_CJK}])\x{{3000}}(?![{_CJK}])", " "),
    "sp.crlf": (r"\r\n?", "\n"),
    "ws.blank": (r"\n(?:[ \t]*\n){2,}", "\n\n"),
    "res.entity": (r'\x{E200}?entity\x{E202}?\[[\s]*"[^"]*"\s*,\s*"([^"]*)"[^\]\n]*\]\x{E201}?', "$1"),
    "res.filelink": (r"https?:\/\/ppl-ai-file-upload\.[^\s)\]>\"']+", None),
    "res.think": (r"<(think|thinking)>[\s\S]*?</\1>[ \t]*\n?", None),
}


#: Matches that are placed one after another; blocks of so many are placed by themselves, so long texts take no square of time.
BLOCK = 256


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; a lambda that names an expression computes it again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, orig>> of all matches of a Java pattern, in order: what lies between them says where they are."""

    def collected(items: Column, at: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
        def grown(a: Column, x: Column) -> Column:
            after, made = step(a["at"], x)
            return F.struct(after.alias("at"), F.concat(a["out"], F.array(made)).alias("out"))

        return F.aggregate(items, F.struct(at.alias("at"), F.array().cast(f"array<{kind}>").alias("out")), grown, lambda a: a["out"])

    def placed(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        end = start + F.length(x["orig"])
        return end, F.struct(start.alias("start"), end.alias("end"), x["orig"].alias("orig"))

    def paired(orig: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(orig))
        return F.zip_with(orig, gaps, lambda o, g: F.struct(o.alias("orig"), F.length(g).alias("gap")))

    def blocked(pairs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(pairs) - 1, F.lit(0)), F.lit(BLOCK)), lambda at: F.slice(pairs, at + 1, BLOCK))

    def flat(blocks: Column) -> Column:
        lengths = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x["gap"] + F.length(x["orig"])))
        starts = collected(lengths, F.lit(0), "int", lambda at, n: (at + n, at))
        return F.flatten(F.zip_with(blocks, starts, lambda block, at: collected(block, at, "struct<start: int, end: int, orig: string>", placed)))

    orig = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _once(orig, lambda found: _once(paired(found), lambda pairs: _once(blocked(pairs), flat)))


def rule_count(text: Column, rule: str) -> Column:
    """How often a rule of ``RULES`` matches, as if it ran alone."""
    return F.regexp_count(text, F.lit(RULES[rule][0])).cast("long")


def rule_fixed(text: Column, rule: str) -> Column:
    """``text`` after one pass of a rule of ``RULES``; as it is where the rule asks."""
    pattern, put = RULES[rule]
    return text if put is None else F.regexp_replace(text, pattern, put)
