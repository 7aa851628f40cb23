"""What the corpus operators share: the scratch folder, materialised tables and worker imports."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscour.functions.workers import ship, spread

__all__ = ["UNEVEN_SPACE", "clear", "discard", "freed", "joined", "scratch", "ship", "spread", "table", "written"]

#: A key with more than one in HOT_SHARE of the rows is hot, if these are more than HOT_ROWS; so fewer than HOT_SHARE keys are.
HOT_SHARE, HOT_ROWS = 2000, 50

#: The white-space runs that differ from one space. Replacing these is the same as replacing every run.
UNEVEN_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _root(spark: SparkSession) -> str:
    """The folder of this application below the cluster's shared ``spark.checkpoint.dir``. Where that is unset: a temporary
    folder in local mode, else one in the home folder of the cluster's file system; raises if that is a machine's own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] == "local":
            root = Path(tempfile.gettempdir(), f"sparkscour-{os.getuid()}").as_uri()
        else:
            files = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.get(spark.sparkContext._jsc.hadoopConfiguration())
            if files.getScheme() == "file":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = f"{files.getHomeDirectory()}/sparkscour"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the application's own."""
    return f"{_root(spark)}/{label}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Remove every intermediate table of this application. Results that have not been read yet read them: call it after."""
    _delete(spark, _root(spark))


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts its lineage, and survives the loss of executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that ``written`` made and that nothing reads any more."""
    _delete(df.sparkSession, df.scratch_path)


def freed(spark: SparkSession) -> None:
    """Give back what the driver no longer uses. Python's freed blocks return to the system, and the JVM collects, which shrinks
    its heap and lets Spark drop the state of past jobs, broadcasts and shuffles."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library
    spark.sparkContext._jvm.System.gc()


def joined(rows: DataFrame, facts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined to ``facts`` (one row for each ``key``, ``n`` rows have it; ``total`` is the sum of ``n``), without ``n``.

    Hot keys are joined by broadcast, of fewer than HOT_SHARE facts; only the others are dealt by key. Both are read twice.
    """
    hot = F.col(n) > max(HOT_ROWS, total // HOT_SHARE)
    few, many = F.broadcast(facts.where(hot).drop(n)), facts.where(~hot).drop(n)
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(many, key))
