"""Names and labels of characters, and of places in a text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscour.functions.patterns import js
from sparkscour.operators.rules_characters import selector_bytes, tag_text

# Short labels of characters that show nothing.
CHIPS = {
    0x00A0: "NBSP", 0x00AD: "SHY", 0x034F: "CGJ", 0x061C: "ALM", 0x180E: "MVS", 0x200B: "ZWSP", 0x200C: "ZWNJ", 0x200D: "ZWJ",
    0x200E: "LRM", 0x200F: "RLM", 0x2028: "LS", 0x2029: "PS", 0x202A: "LRE", 0x202B: "RLE", 0x202C: "PDF", 0x202D: "LRO",
    0x202E: "RLO", 0x202F: "NNBSP", 0x2060: "WJ", 0x2066: "LRI", 0x2067: "RLI", 0x2068: "FSI", 0x2069: "PDI", 0xFEFF: "BOM",
    0x2009: "THSP", 0x200A: "HSP", 0x2007: "FSP", 0x3000: "IDSP", 0x0085: "NEL", 0xFFFC: "OBJ", 0xFFFD: "�",
}
_INVISIBLE = js(r"[\p{Cf}\p{Cc}\p{Zl}\p{Zp}\p{Default_Ignorable_Code_Point}\p{Co}]|(?! )\p{Zs}")


def code(c: str) -> str:
    """U+ and at least four hexadecimal digits."""
    return f"U+{ord(c):04X}"


def name(c: str) -> str:
    """Code and Unicode name, or the kind of character where it has none."""
    kinds = {"Cc": "control character", "Co": "private use", "Cn": "unassigned", "Cs": "surrogate"}
    return f"{code(c)} {unicodedata.name(c, kinds.get(unicodedata.category(c), 'character'))}"


def invisible(c: str) -> bool:
    return c not in "\t\n" and _INVISIBLE.match(c) is not None


def chip(c: str) -> str:
    """A short label for a character that shows nothing; empty for others."""
    if not invisible(c):
        return ""
    point = ord(c)
    if 0xFE00 <= point <= 0xFE0F:
        return f"VS{point - 0xFE00 + 1}"
    if 0xE0100 <= point <= 0xE01EF:
        return f"VS{point - 0xE0100 + 17}"
    return CHIPS.get(point) or ("PUA" if unicodedata.category(c) == "Co" else code(c)[2:])


def visible(text: str) -> str:
    """``text`` with labels in brackets for what shows nothing."""
    return "".join(f"[{chip(c)}]" if invisible(c) else c for c in text)


def hidden_message(text: str) -> str:
    """What tag characters and runs of variation selectors in a text spell."""
    tags = tag_text("".join(c for c in text if 0xE0000 <= ord(c) <= 0xE007F))
    runs = js(r"[\uFE00-\uFE0F\U000E0100-\U000E01EF]{2,}").findall(text)
    return tags + "".join(map(selector_bytes, runs))


def visible_column(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else visible(t))

    return run(text)


def position(text: Column, at: Column) -> tuple[Column, Column]:
    """Line and column, both from 1, of an offset."""
    before = F.substring(text, F.lit(1), at)
    line = F.size(F.split(before, "\n"))
    return line.alias("line"), (F.length(F.substring_index(before, "\n", -1)) + 1).alias("column")


def clip(text: Column, most: int = 8) -> Column:
    """The first characters of a text."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def neighbours(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Findings with the start of the next and the previous one of their text; the last is followed by the first."""
    order = Window.partitionBy(id_col).orderBy("start", "end", "rule_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following, before = F.lead("start").over(order), F.lag("start").over(order)
    return found.select("*", F.coalesce(following, F.first("start").over(whole)).alias("next_start"), F.coalesce(before, F.last("start").over(whole)).alias("previous_start"))


def nearest_to_line(found: DataFrame, texts: DataFrame, lines: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The finding nearest to the start of a line: ``texts`` (id_col, text_col), ``lines`` (id_col, line from 1); a line beyond
    the last counts as the end of its text."""
    split = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    before = F.aggregate(F.slice(split, F.lit(1), F.greatest(F.col("line") - 1, F.lit(0))), F.lit(0), lambda a, x: a + F.length(x) + 1)
    places = texts.join(lines, id_col).select(id_col, "line", F.least(before, F.length(text_col)).cast("int").alias("at"))
    return nearest(found, places.select(id_col, "at").distinct(), id_col).join(places, [id_col, "at"]).select(id_col, "line", "distance", "start", "end", "rule_id")


def nearest(found: DataFrame, places: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The finding nearest to a place: ``places`` (id_col, at); the earlier of two as near. Partial minima, then a shuffle."""
    pairs = found.join(places, id_col)
    least = F.min(F.struct(F.abs(F.col("start") - F.col("at")).alias("distance"), "start", "end", "rule_id")).alias("f")
    return pairs.groupBy(id_col, "at").agg(least).select(id_col, "at", "f.*")
