"""Exact deduplication as a stateful stream, in DataFrame functions only.

The stream groups rows by the SHA-256 of their normalised text. Its keyed state lies on disk (RocksDB, checkpointed to
the shared folder) and never expires; for each digest it retains the least identifier, the locator of that row's
content (file and row in it) and the count. So a later run with the same state folder reads only new files, and still knows
every earlier text. Partial aggregation comes before the shuffle: a text with very many copies reaches the state as one
row per task.

A digest that was hit is then checked on full bytes: the least and the greatest normalised text of its rows are equal only if
all are. The retained locator brings the keeper's text into that check, also where its file is no longer in the source. These,
too, are partial aggregates, so copies meet as one text per task. Texts that share a digest and differ are kept apart.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscour.llm.common import UNEVEN_SPACE, joined, scratch, written

#: State on disk; each partition's store takes the space that it needs, not megabytes in advance.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: A stream skips files that are older than this beside the newest one that it has seen; here none are.
MAX_FILE_AGE = "36500d"
#: Most digests that are broadcast for the check of full bytes.
MAX_BROADCAST = 200_000


def normalised(text: Column) -> Column:
    """Text with every run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), UNEVEN_SPACE, " ")


def digest(text: Column) -> Column:
    """SHA-256 of a normalised text."""
    return F.sha2(text, 256)


def _place(spark: SparkSession, source: str) -> tuple[str, str]:
    """The folder that a stream watches for ``source``, and the names it takes there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    return (str(path.getParent()), path.getName()) if status.isFile() else (source, "*")


def _update(spark: SparkSession, source: str, state: str, id_col: str, text_col: str, files_per_batch: int | None) -> str:
    """Take the files of ``source`` that the state has not seen into it; the folder of the changed states, by batch."""
    schema = spark.read.parquet(source).schema
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(schema).option("maxFileAge", MAX_FILE_AGE)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        folder, names = _place(spark, source)
        rows = reader.option("pathGlobFilter", names).parquet(folder)
        rows = rows.select(
            digest(normalised(rows[text_col])).alias("digest"),
            F.struct(rows[id_col].alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("first"),
            rows[id_col].isNull().alias("nameless"),
        )
        groups = rows.groupBy("digest").agg(F.min(F.struct("nameless", "first")).alias("keeper"), F.count("*").alias("group_size"))

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{state}/changed/batch={number}")

        writer = groups.writeStream.outputMode("update").option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True)
        writer.foreachBatch(keep).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return f"{state}/changed"


def groups(spark: SparkSession, source: str, state: str | None = None, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int | None = None) -> DataFrame:
    """(digest, keep_id, keep_file, keep_row, group_size) of every text seen so far, after reading what is new.

    ``source`` is a Parquet file or folder. ``state`` is kept between runs; without it the run starts afresh in the
    shared folder. Least id first, rows without id last, then by file and row.
    """
    changed = _update(spark, source, state or scratch(spark, "dedup-state"), id_col, text_col, files_per_batch)
    kind = json.loads(spark.read.parquet(source).select(F.col(id_col).alias("id")).schema.json())["fields"][0]["type"]
    schema = f"digest string, keeper struct<nameless: boolean, first: struct<id: {kind}, file: string, row: long>>, group_size long"
    states = spark.read.schema(schema).parquet(changed)
    now = states.groupBy("digest").agg(F.min("keeper").alias("keeper"), F.max("group_size").alias("group_size"))
    return now.select("digest", F.col("keeper.first.id").alias("keep_id"), F.col("keeper.first.file").alias("keep_file"), F.col("keeper.first.row").alias("keep_row"), "group_size")


def _located(rows: DataFrame) -> list[Column]:
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]


def _differing(spark: SparkSession, source: str, found: DataFrame, text_col: str) -> DataFrame:
    """The digests that were hit (group_size above 1) and whose texts, in the source or kept elsewhere, are not all equal."""
    hit = written(found.where("group_size > 1").select(F.col("digest").alias("of"), "keep_file", "keep_row"), "dedup-hits")
    few = F.broadcast if hit.count() <= MAX_BROADCAST else (lambda df: df)
    rows = spark.read.parquet(source)
    text = normalised(rows[text_col])
    texts = rows.select(digest(text).alias("digest"), text.alias("t")).join(few(hit.select("of")), F.col("digest") == F.col("of"), "left_semi")
    own = rows.select("_metadata.file_path").distinct()
    elsewhere = [r.keep_file for r in hit.select("keep_file").distinct().join(own, F.col("keep_file") == F.col("file_path"), "left_anti").collect()]  # files, not rows
    if elsewhere:
        kept = spark.read.schema(rows.schema).parquet(*elsewhere)
        kept = kept.select(normalised(kept[text_col]).alias("t"), *_located(kept))
        texts = texts.unionByName(kept.join(hit, (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))).select(F.col("of").alias("digest"), "t"))
    return texts.groupBy("digest").agg(F.min("t").alias("least"), F.max("t").alias("most")).where("least <> most").select("digest")


def _apart(spark: SparkSession, source: str, digests: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The groups of rows of ``source`` whose texts share one of ``digests``, by text: (digest, t, keep_id, keep_file, keep_row, group_size)."""
    rows = spark.read.parquet(source)
    text = normalised(rows[text_col])
    rows = rows.select(digest(text).alias("digest"), text.alias("t"), rows[id_col].alias("id"), *_located(rows)).join(digests, "digest", "left_semi")
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "file", "row"))
    groups = rows.groupBy("digest", "t").agg(first.alias("k"), F.count("*").alias("group_size"))
    return groups.select("digest", "t", F.col("k.id").alias("keep_id"), F.col("k.file").alias("keep_file"), F.col("k.row").alias("keep_row"), "group_size")


def exact_duplicates(spark: SparkSession, source: str, state: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``source``: id_col, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Null texts are empty texts. Of equal texts the row with the least id stays; of rows that repeat that id with an equal
    text, the first by file and row. A group without any id keeps its first row and has a null keep_id. Other columns are
    not read, whatever they are called. An empty table gives no rows. Texts of any length are compared whole. Raises if the
    state lacks a text of ``source``. Texts that share a digest and differ are groups of their own, of ``source`` alone.
    """
    found = written(groups(spark, source, state, id_col, text_col), "dedup-groups")
    rows = spark.read.parquet(source)
    text = normalised(rows[text_col])
    own = written(rows.select(rows[id_col].alias("id"), digest(text).alias("digest"), *_located(rows)), "dedup-rows")
    apart = written(_differing(spark, source, found, text_col), "dedup-differing")
    lacking = own.groupBy("digest").agg(F.first("file").alias("file")).join(found, "digest", "left_anti").head(1)
    if lacking:
        raise ValueError(f"the state lacks a text of {lacking[0].file}")
    n = found.withColumn("rows", F.col("group_size"))
    if apart.head(1):
        split = written(_apart(spark, source, apart, id_col, text_col), "dedup-apart")
        named = rows.select(digest(text).alias("digest"), text.alias("t"), *_located(rows)).join(split, ["digest", "t"]).drop("t")
        own_apart = own.drop("digest").join(named, ["file", "row"])
        own = own.join(apart, "digest", "left_anti")
        n = n.join(apart, "digest", "left_anti")
    out = joined(own, n, "digest", "rows", found.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0])
    if apart.head(1):
        out = out.unionByName(own_apart)
    kept = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))
