"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed n-gram (SIZES bytes, words padded by spaces) in the whole text; its value is the
log ratio of the smoothed shares of toxic and of other rows that have it. N-grams that tell little (a ratio near 0, or too few rows) get
no weight. The model is fitted on the driver from at most about ``per_label`` rows of each label, chosen by a hash of the
id (fewer where their features are more than MOST_BYTES); every row is scored on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscour.llm.common import ship, spread, written
from sparkscour.llm.langid import remainder
from sparkscour.llm.linear import Rows, fit, sigmoid
from sparkscour.llm.ngrams import buckets, letters

SIZES = (3, 4, 5, 6)
BITS = 20
PER_LABEL = 1000
#: Bytes of their features, which the driver holds; of long texts fewer rows are learned.
MOST_BYTES = 200 << 20
#: A row is predicted toxic from this score on.
THRESHOLD = 0.3
SMOOTHING, LEAST_ROWS, LEAST_RATIO = 1.0, 5, 1.0
PENALTY, STEPS = 1e-4, 300


@dataclass
class Model:
    weights: np.ndarray  # by bucket, ratio included; 0 where an n-gram tells nothing
    bias: float

    def score(self, text: str | None) -> float:
        found = [part[self.weights[part] != 0] for part in buckets(letters(text), SIZES, BITS)]
        told = np.unique(np.concatenate([np.empty(0, np.int64), *found]))
        return sigmoid(float(self.weights[told].sum()) + self.bias)


def train(sample: list[tuple[int, np.ndarray]]) -> Model:
    """From (label 0 or 1, distinct buckets) of each sampled row. Without both labels every score is that of the one."""
    labels = np.array([y for y, _ in sample], int)
    size = 1 << BITS
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(size, np.float32), 4.0 if labels.any() else -4.0)
    seen = np.zeros((2, size))
    for y, b in sample:
        seen[y, b] += 1
    share = [(seen[y] + SMOOTHING) / ((labels == y).sum() + 2 * SMOOTHING) for y in (0, 1)]
    ratio = np.log(share[1] / share[0])
    told = (seen[0] + seen[1] >= LEAST_ROWS) & (np.abs(ratio) >= LEAST_RATIO)
    rows = [b[told[b]] for _, b in sample]
    w, bias = fit(Rows(rows, [ratio[b] for b in rows], size), np.where(labels == 1, 1.0, -1.0), "logistic", PENALTY, STEPS)
    return Model((w * ratio * told).astype(np.float32), bias)


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = PER_LABEL) -> Model:
    """A model from labelled rows that are not held out. Null labels are no labels; an id with both is toxic."""
    ship(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1) & (remainder(F.col(id_col)) != 2))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    n = known.groupBy(F.col("label").alias("of")).agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "id"), F.lit(1 << 30)) / float(1 << 30)
    known = known.join(F.broadcast(n), F.col("label") == F.col("of")).withColumn("share", draw * F.col("n") / F.least("n", F.lit(per_label))).where("share < 1").select("id", "label", "share")

    @F.pandas_udf("binary")
    def featured(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(np.concatenate([np.empty(0, np.int64), *buckets(letters(x), SIZES, BITS)])).astype(np.int32).tobytes() for x in texts])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "id")
    rows = written(rows.select("label", "id", "share", featured("text").alias("f")), "toxicity-features")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("f")), F.lit(0))).first()[0]
    got = rows.where(F.col("share") < min(1.0, MOST_BYTES / max(1, size))).select("label", "id", "f").orderBy("label", "id").collect()
    return train([(x.label, np.frombuffer(x.f, np.int32)) for x in got])


def score(spark: SparkSession, model: Model, text: Column) -> Column:
    """0 to 1 for a whole text; a null text is an empty one."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(x) for x in texts], dtype=float)

    return run(text.cast("string"))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, held_out, score, predicted (1 from THRESHOLD on).

    Empty and null texts get the score of the bias. Texts of any length are read whole, in blocks. Rows without id are not held
    out and not learned from. Repeated rows come back as often as they are there. Other columns are not read, whatever they
    are called. Empty tables give no rows or the score of no label at all.
    """
    docs = spread(docs.select(id_col, text_col))
    model = fitted(docs, labels, id_col, text_col)
    found = docs.select(F.col(id_col), F.coalesce(remainder(F.col(id_col)) == 2, F.lit(False)).alias("held_out"), score(docs.sparkSession, model, F.col(text_col)).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
