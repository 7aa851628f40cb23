"""The corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, mixing, sharding.

Every stage takes all rows of its predecessor and whole texts of any length. Empty tables pass as empty tables. Columns beside
those that a stage reads keep their names and values, whatever they are called; the last stage alone adds columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkscour.llm import decontamination, langid, mixing, sharding, simhash
from sparkscour.llm.common import discard, freed, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a language get the predicted one.

    Null texts and texts without a letter go. Rows without id, and repeated rows, are judged by their texts like any other. Of
    languages that win alike, the last by code is predicted.
    """
    out = langid.recognised(docs)
    freed(spark)  # of the rows that were learned
    return out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id.

    Texts without a word are near-duplicates of each other. Of rows that repeat an id, one of each group stays; rows without id
    stay.
    """
    freed(spark)
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Texts without a word hold none. Rows that repeat an id, or have none, are judged each by its own text. Items without id or
    word match nothing.
    """
    freed(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them.

    Null sources are one source; rows without id are ordered by their text. Rows without a word add nothing to the mix and are
    taken as often as their source repeats them. Of rows that are alike, as many are taken as the mix needs.
    """
    freed(spark)
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard, and the columns size, text_crc32, law and grown_shard; each replaces a column of that name.

    A row without id goes by its text, a null text has size 1, and rows that repeat an id share a shard.
    """
    freed(spark)
    return sharding.sharded(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: SQL can express neither the language model nor the jump hash; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each table is removed once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
