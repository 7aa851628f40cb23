"""Sharding by jump consistent hashing: no ring, and one more shard takes only the rows that move into it."""

from __future__ import annotations


import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscour.llm.common import ship, written

SHARDS = 8
#: Parts that each shard is numbered in; a part is ordered by one task.
PARTS = 1024
#: Slots of rows that are alike that one row holds while they are numbered.
RUN = 1000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key: the last jump of its random walk that stays below ``shards``."""
    key = keys.astype(np.uint64)
    at, ahead = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    moving = np.arange(len(key))
    while len(moving):
        at[moving] = ahead[moving]
        key[moving] = key[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (key[moving] >> np.uint64(33)).astype(np.float64) + 1
        ahead[moving] = np.floor((at[moving] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return at


def shard(id_: Column, text: Column, shards: int = SHARDS) -> Column:
    """Shard of a row: its id's text form decides; a row without id goes by its text instead."""

    @F.pandas_udf("int")
    def run(names: pd.Series) -> pd.Series:
        keys = np.fromiter((xxhash.xxh64_intdigest(x) for x in names), np.uint64, len(names))
        return pd.Series(jump(keys, shards).astype(np.int32))

    return run(F.coalesce(id_.cast("string"), F.concat(F.lit("#"), F.xxhash64(text.cast("string")).cast("string"))))


def facts(id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> dict[str, Column]:
    """Columns size (UTF-8 bytes and one), text_crc32, law, shard and grown_shard (with one more shard) of a row."""
    text = F.col(text_col).cast("string")
    id_ = F.col(id_col)
    return {
        "size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1,
        "text_crc32": F.crc32(F.coalesce(text, F.lit("")).cast("binary")),
        "law": F.lit("key"),
        "shard": shard(id_, text, shards),
        "grown_shard": shard(id_, text, shards + 1),
    }


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """``docs`` with the columns of ``facts``; each replaces a column of that name, all others stay. A map without a shuffle.

    A null or empty text has size 1. A row without id goes by its text; rows alike go to one shard. An empty table gives none.
    """
    ship(docs.sparkSession)
    return docs.select(*(c for c in docs.columns if c not in facts(id_col, text_col)), *(v.alias(k) for k, v in facts(id_col, text_col, shards).items()))


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """Per row: id_col, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard.

    A null text counts as empty (size 1). Rows without id are placed by their text. Repeated rows share a shard and
    have slots of their own. Slots follow a hash of the row, so runs agree whatever the partitions are. Texts of any length
    count whole. An empty table gives no rows. Other columns are not read, whatever they are called.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), *(v.alias(k) for k, v in facts(id_col, text_col, shards).items()))
    kinds = ["id", "size", "text_crc32", "law", "shard", "grown_shard"]
    part = F.pmod(F.xxhash64("id", "size", "text_crc32"), F.lit(PARTS)).cast("int")
    rows = written(own.groupBy(*kinds).agg(F.count("*").alias("n")).withColumn("part", part), "shard-rows")
    parts = rows.groupBy("shard", "part").agg(F.sum("n").alias("n"))
    offsets = parts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("offset"))
    order = Window.partitionBy("shard", "part").orderBy("id", "size", "text_crc32")
    ranked = rows.withColumn("first", F.sum("n").over(order) - F.col("n"))
    slots = ranked.join(offsets, ["shard", "part"]).withColumn("first", F.col("first") + F.col("offset"))
    last = F.col("first") + F.col("n") - 1
    slots = slots.select("*", F.explode(F.sequence(F.col("first"), last, F.lit(RUN).cast("long"))).alias("from"))
    slot = F.explode(F.sequence(F.col("from"), F.least(F.col("from") + RUN - 1, last))).alias("slot")
    return slots.select(F.col("id").alias(id_col), "size", "text_crc32", "law", "shard", slot, "grown_shard")
