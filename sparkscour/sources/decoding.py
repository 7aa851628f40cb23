"""Bytes to text: UTF-16 by its mark or its zeros, else UTF-8, else Windows-1252."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscour.functions.workers import ship

# How much of a file is looked at, file endings read as text, and formats that are not.
SAMPLE = 4000
TEXT_ENDINGS = "tex ltx sty cls bib bbl txt text md markdown mdx rmd qmd csv json html xml yml rst org log".split()
WORD_ENDINGS = ["docx"]
REFUSED_ENDINGS = "doc pdf odt rtf pages".split()


def utf16_order(data: bytes) -> str | None:
    """Byte order of UTF-16 text, by its mark or by where its zero bytes are; None if it is none."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "le" if data[0] == 0xFF else "be"
    if len(data) < 4:
        return None
    start = data[:SAMPLE]
    zeros = start[0::2].count(0), start[1::2].count(0)  # of even and of odd places
    for order, many, few in (("le", zeros[1], zeros[0]), ("be", zeros[0], zeros[1])):
        if many > len(start) / 5 and few < len(start) / 50:
            return order
    return None


def decoded(data: bytes | None) -> tuple[str, str]:
    """Text and encoding ("utf-16le", "utf-16be", "utf-8" or "windows-1252"). A mark at the start is no part of the text."""
    data = data or b""
    if order := utf16_order(data):
        return data.decode(f"utf-16-{order}", "replace").removeprefix("\ufeff"), f"utf-16{order}"
    try:
        return data.decode("utf-8").removeprefix("\ufeff"), "utf-8"
    except UnicodeDecodeError:
        # bytes that Windows-1252 leaves open are the control characters of that number
        return "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in data), "windows-1252"


def decoded_column(content: Column) -> Column:
    """struct<text, encoding> of a binary column."""

    @F.pandas_udf("struct<text: string, encoding: string>")
    def run(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decoded(x) for x in contents], columns=["text", "encoding"])

    return run(content)


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def normalised_lines(text: Column) -> Column:
    """Every line end as one line feed."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, ending, bytes, text, encoding, legacy_encoding, crlf) of text files; the text has line feeds only. Files of other
    formats are left out (``unread_files`` tells which); a Word file has a null text (see ``sparkscour.sources.word``)."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).withColumn("ending", ending(F.col("path")))
    files = files.where(F.col("ending").isin([*TEXT_ENDINGS, *WORD_ENDINGS]))
    word = F.col("ending").isin(WORD_ENDINGS)
    files = files.withColumn("d", F.when(~word, decoded_column(F.when(~word, F.col("content")))))
    return files.select(
        "path",
        "ending",
        F.col("length").alias("bytes"),
        normalised_lines(F.col("d.text")).alias("text"),
        "d.encoding",
        (F.col("d.encoding") != "utf-8").alias("legacy_encoding"),
        F.col("d.text").contains("\r\n").alias("crlf"),
    )


def unread_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, ending, bytes, reason) of the files that ``read_files`` leaves out. Their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", ending(F.col("path")).alias("ending"), F.col("length").alias("bytes"))
    reason = F.when(F.col("ending").isin(REFUSED_ENDINGS), F.lit("a format that is not text")).otherwise(F.lit("an unknown ending"))
    return files.where(~F.col("ending").isin([*TEXT_ENDINGS, *WORD_ENDINGS])).withColumn("reason", reason)


def write_text(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", form: str = "parquet") -> None:
    """Texts in the folder ``path``, which is written anew: ``form`` "parquet" or "json" keeps ids, one row each; "text" writes
    the texts alone as lines of UTF-8, in which a text of several lines is several lines."""
    if form == "text":
        docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("value")).write.mode("overwrite").text(path)
    else:
        docs.select(id_col, text_col).write.mode("overwrite").format(form).save(path)
