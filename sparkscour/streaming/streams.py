"""The row operators on streams: they are maps, so a stream of texts passes through as a table does, with no state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from sparkscour.functions.native import profile_columns, profile_parts
from sparkscour.functions.workers import ship
from sparkscour.operators import frames
from sparkscour.operators.frames import findings_of
from sparkscour.plans.rules import Config, Selection


def _text(docs: DataFrame, name: str) -> Column:
    ship(docs.sparkSession)
    return F.coalesce(docs[name].cast("string"), F.lit(""))


def findings_stream(docs: DataFrame, settings: Config | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stream of findings, a row each."""
    found = docs.select(F.col(id_col), F.explode(findings_of(_text(docs, text_col), settings or frames.default_config())).alias("f"))
    return found.select(id_col, "f.*")


def cleaned_stream(docs: DataFrame, settings: Config | None = None, selection: Selection | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stream of cleaned texts."""
    cleaned = frames.cleaned_of(_text(docs, text_col), settings or frames.default_config(), selection or frames.default_selection())
    return docs.select(F.col(id_col), cleaned.alias("c")).select(id_col, "c.*")


def profile_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stream of profiles."""
    return docs.select(F.col(id_col).alias("of"), *profile_parts(_text(docs, text_col))).select(F.col("of").alias(id_col), *profile_columns())


def to_parquet(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the rows to a Parquet folder, each once; ``once``: take what there is and stop."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
