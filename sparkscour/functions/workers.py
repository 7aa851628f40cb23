"""Python workers, and how rows are spread over the cores."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Several workers share an executor's memory: few heaps each, and buffers that return to the system.
LEAN = {"MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ship(spark: SparkSession) -> None:
    """Let Python workers import the package wherever the driver was started, and give memory back when a batch is done."""
    home = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    for name, value in LEAN.items():
        env.setdefault(name, value)
    if home not in known:
        env["PYTHONPATH"] = os.pathsep.join([home, *filter(None, known)])


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` over all cores, if it is small and comes from fewer files: a scan reads a small file, or one row group, in one
    task, and texts take much longer to work on than to move. A table that is large enough for every core to get a split of its
    own, one of many files, and one from elsewhere stay as they are; so at most a split for each core is moved."""
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    plan = docs._jdf.queryExecution().optimizedPlan()
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    if plan.stats().sizeInBytes() >= cores * split:
        return docs
    return docs.repartition(cores) if 0 < len(docs._jdf.inputFiles()) < cores else docs
