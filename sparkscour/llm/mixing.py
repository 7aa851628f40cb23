"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Every source's share of all words follows its weight, but no more than ``max_epochs`` times its own words; what exceeds
that is shared among the others by weight until no source is above its cap. The level that this redistribution ends at is
found in closed form: with sources ordered by cap per weight, it is the first level at which the next source stays below
its cap.

A source's target is met by whole repetitions of all its documents and one more of a seeded selection: the documents in
order of a seeded hash up to the rest of the target. A document on the border is taken if that comes nearer to the target.
The order is never built in one task: sums by the hash's first digits find the digits where the target is reached, and
only the documents that share those four digits are ordered one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscour.llm.common import written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 42
#: Most sources whose targets are broadcast; beyond that the joins shuffle, and Spark splits a hot source.
MAX_BROADCAST = 100_000
#: Hexadecimal digits of the hash that each of the two levels of sums looks at.
DIGITS = 2


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _order(id_: Column, text: Column, seed: int) -> Column:
    """The seeded hash of a row's id, or of its text where it has none."""
    name = F.coalesce(id_.cast("string"), F.concat(F.lit("#"), F.md5(F.coalesce(text.cast("string"), F.lit("")))))
    return F.md5(F.concat(F.lit(f"{seed}:"), name))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, whole, rest) of ``sizes`` (source, source_size).

    Sources by code point, null last, get the weights in turn. It orders one row per source in a single task.
    """
    by_name, by_ratio = Window.orderBy(F.col("source").isNull(), "source"), Window.orderBy("ratio", "place")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") - 1) % len(weights) + 1)
    cap = (F.col("source_size") * max_epochs).cast("double")
    table = sizes.select("source", "source_size", F.row_number().over(by_name).alias("place"))
    table = table.withColumn("weight", weight).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    table = table.select(
        "*",
        F.sum("source_size").over(Window.partitionBy()).cast("double").alias("all"),
        F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("capped"),
        F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("open"),
    )
    table = table.withColumn("level", (F.col("all") - F.col("capped")) / F.col("open"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(Window.partitionBy()).getField("level")
    table = table.withColumn("target", F.least("cap", level * F.col("weight")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return table.select("source", "source_size", "target", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("rest"))


def _border(sums: DataFrame, plan: DataFrame, before: str, level: int) -> DataFrame:
    """``plan`` with the digits in which each source's rest is reached, and the words that come before them."""
    order = Window.partitionBy("source").orderBy("digits")
    upto = F.sum("n").over(order)
    runs = sums.select("source", "digits", "n", upto.alias("upto"))
    on = plan["source"].eqNullSafe(runs["source"])
    start = F.col(before) + F.col("upto") - F.col("n")
    reached = runs.join(plan.select("source", before, "rest"), on).where((start <= F.col("rest")) & (F.col("rest") < F.col(before) + F.col("upto")))
    reached = reached.select(runs["source"].alias("of"), F.col("digits").alias(f"digits{level}"), start.alias(f"before{level}"))
    return plan.join(reached, plan["source"].eqNullSafe(reached["of"]), "left").drop("of")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, keep_row: bool = False) -> DataFrame:
    """Per row: id_col, size (words), source_size, target, reps (times the mix takes the document), taken (size * reps).

    A null or blank text has size 0 and takes nothing of a target; null sources are one source. Rows that repeat an id are
    rows of their own. Runs with one seed agree whatever the partitions are. An empty table gives no rows. With
    ``keep_row`` there is a column ``row`` with all columns of ``docs``; else the other columns are not read.
    """
    text, id_ = F.col(text_col), F.col(id_col)
    hashed = _order(id_, text, seed)
    own = docs.select(*([F.struct("*").alias("row")] if keep_row else []), id_.alias("id"), F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"), hashed.alias("hash"))
    small = written(own.drop("row"), "mix-sizes")
    own = own if keep_row else small
    plan = written(targets(small.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs), "mix-targets")
    few = plan.count() <= MAX_BROADCAST
    sized = F.broadcast if few else (lambda df: df)
    plan = plan.withColumn("before0", F.lit(0).cast("long"))
    digits = [F.substring("hash", 1 + DIGITS * i, DIGITS) for i in range(2)]
    for i in range(2):
        rows = small
        if i:
            known = sized(plan.select(F.col("source").alias("of"), "digits1"))
            rows = small.join(known, F.col("source").eqNullSafe(F.col("of")) & (digits[0] == F.col("digits1")))
        sums = rows.groupBy("source", digits[i].alias("digits")).agg(F.sum("size").alias("n"))
        plan = written(_border(sums, plan, f"before{i}", i + 1), "mix-border")
    facts = plan.select(F.col("source").alias("of"), "source_size", "target", "whole", "rest", *(c for c in plan.columns if c[-1] in "12"))
    same = [digits[i] == F.col(f"digits{i + 1}") for i in range(2)]
    joined = small.join(sized(facts), F.col("source").eqNullSafe(F.col("of")) & reduce(Column.__and__, same))
    last = Window.partitionBy("source").orderBy("hash", "size")
    middle = F.col("before2") + F.sum("size").over(last.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    border = joined.select("hash", "source", "size", (middle <= F.col("rest")).alias("extra"))
    border = written(border.groupBy("hash", "source", "size").agg(F.count("*").alias("rows"), F.sum(F.col("extra").cast("long")).alias("extras")), "mix-last")
    out = own.join(sized(facts), F.col("source").eqNullSafe(F.col("of")))
    at = reduce(Column.__and__, same)
    sure = F.when(digits[0] < F.col("digits1"), 1).when(digits[0] > F.col("digits1"), 0).when(digits[1] < F.col("digits2"), 1).when(digits[1] > F.col("digits2"), 0)
    out = out.withColumn("extra", F.coalesce(sure, F.lit(0))).withColumn("at", F.coalesce(at, F.lit(False)))
    edge = out.where("at").drop("extra")
    keys = border.select(F.col("hash").alias("h"), F.col("source").alias("s"), F.col("size").alias("z"), "extras")
    edge = edge.join(keys, (F.col("hash") == F.col("h")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    alike = Window.partitionBy("hash", "source", "size").orderBy("id")
    edge = edge.withColumn("extra", (F.row_number().over(alike) <= F.col("extras")).cast("int")).drop("h", "s", "z", "extras")
    out = out.where("not at").select(*edge.columns).unionByName(edge)
    reps = (F.col("whole") + F.col("extra")).cast("long")
    return out.select(*(["row"] if keep_row else []), F.col("id").alias(id_col), "size", "source_size", "target", reps.alias("reps"), (F.col("size") * reps).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its own columns, whatever they are called.

    Rows of size 0 (null, empty and blank texts) count as taken as often as their source repeats them. Null sources are one
    source. Rows without id are ordered by their text; of rows that are alike, as many are taken as the mix needs. An empty
    table gives no rows.
    """
    out = mix(docs, keep_row=True, **options).where("reps > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("reps").cast("int")))).select("row.*")
