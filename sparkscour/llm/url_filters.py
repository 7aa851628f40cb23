"""URL filters as a temporal list join, in DataFrame functions only.

A list is a log of dated entries: at ``at``, ``action`` ("add" or "remove") for a ``value`` of a ``kind``: "host" (that host),
"domain" (that host and all below it) or "prefix" (URLs on a host whose path begins with these
whole segments, written host/path; one that ends in a slash names what is below it, host/ the whole host). Consecutive
entries of one value become validity intervals [from, until). A capture is looked up by the values that could name it (its
host, the host's parent domains, its host with each leading part of its path) and blocked if one of them was valid when it
was fetched: the as-of join, as an equi-join on the value with the time between the interval's ends. Intervals of one
value never overlap, so a value matches a capture at most once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscour.llm.common import written

#: Most intervals that are sent to every executor; beyond that the join shuffles, and Spark splits a hot host.
MAX_BROADCAST = 100_000
KINDS = ("host", "domain", "prefix")


def host(url: Column) -> Column:
    """Lower-case host of a URL without user, port and a closing dot; empty if there is none."""
    authority = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.rtrim(F.lower(authority), F.lit("."))


def path(url: Column) -> Column:
    """Path of a URL from its first slash, without query and fragment."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, value, from, until) from entries (kind, value, at, action); ``until`` is null while nothing removes the value.

    Values are compared in lower case for hosts and domains, and for the host of a prefix. Of entries for one value at one time, a removal counts; an
    add that follows an add changes nothing. Entries with a null or an unknown kind or action are ignored.
    """
    value = F.when(F.col("kind") == "prefix", F.concat(F.lower(F.substring_index("value", "/", 1)), F.regexp_extract("value", r"^[^/]*((?s:.*))$", 1))).otherwise(F.lower("value"))
    known = entries.where(F.col("kind").isin(*KINDS) & F.col("action").isin("add", "remove") & F.col("value").isNotNull() & F.col("at").isNotNull())
    known = known.groupBy("kind", value.alias("value"), "at").agg(F.max("action").alias("action"))  # "remove" is the greater
    log = Window.partitionBy("kind", "value").orderBy("at")
    turns = known.withColumn("before", F.coalesce(F.lag("action").over(log), F.lit("remove"))).where("action <> before")
    spans = turns.withColumn("until", F.lead("at").over(log)).where("action = 'add'")
    return spans.select("kind", "value", F.col("at").alias("from"), "until")


def names(url: Column, labels: int, steps: int) -> Column:
    """The (kind, value) pairs that an entry of at most ``labels`` labels of a host, or ``steps`` slashes, could name a URL by;
    none without a host."""
    of, parts = host(url), F.split(host(url), r"\.")
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    no_pairs = F.array().cast("array<struct<kind: string, value: string>>")
    first = F.greatest(F.size(parts) - (labels - 1), F.lit(1))
    domains = F.transform(F.sequence(first, F.size(parts)), lambda i: pair("domain", F.array_join(F.slice(parts, i, F.size(parts)), "."))) if labels else no_pairs
    segments = F.split(path(url), "/")
    leading = lambda i: F.concat(of, F.array_join(F.slice(segments, 1, i), "/"))
    last = F.least(F.size(segments), F.lit(steps + 1))
    prefixes = F.when(last > 1, F.transform(F.sequence(F.lit(2), last), lambda i: pair("prefix", leading(i))))
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.size(segments) - 1, F.lit(steps)), F.lit(1))), lambda i: pair("prefix", F.concat(leading(i), F.lit("/"))))
    found = F.concat(above, F.array(pair("host", of)), domains, F.coalesce(prefixes, no_pairs))
    return F.when(of != "", F.array_distinct(found)).otherwise(no_pairs)


def evaluated(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """Per capture: id_col, url_col, time_col, host, n_rules (values valid when it was fetched), rules (kind:value, sorted),
    blocked (n_rules > 0).

    A null URL, one without host or a capture without time is not blocked. URLs of any length are read whole; of their leading
    parts only those are looked up that are no longer than the longest listed one, so a path of many segments costs no more. Captures that repeat an id come back as often as
    they are there, each judged by its own URL and time. Empty tables give no rows, or rows that nothing blocks. Other
    columns are not read.
    """
    valid = written(intervals(entries), "url-intervals")
    # a name with more labels or slashes than any listed one cannot be in the list
    count = lambda kind, sign: F.coalesce(F.max(F.when(F.col("kind") == kind, F.length("value") - F.length(F.replace("value", F.lit(sign))))), F.lit(-1))
    n, dots, slashes = valid.agg(F.count("*"), count("domain", "."), count("prefix", "/")).first()
    valid = F.broadcast(valid) if n <= MAX_BROADCAST else valid
    url = F.col(url_col)
    own = captures.select(F.col(id_col).alias("id"), url.cast("string").alias("url"), F.col(time_col).alias("time"))
    looked = own.select("url", "time").distinct().select("url", "time", F.explode(names(F.col("url"), dots + 1, max(slashes, 0))).alias("n"))
    hit = looked.join(valid, (F.col("n.kind") == valid["kind"]) & (F.col("n.value") == valid["value"]) & (F.col("time") >= F.col("from")) & (F.col("until").isNull() | (F.col("time") < F.col("until"))))
    hit = hit.groupBy("url", "time").agg(F.array_sort(F.collect_set(F.concat_ws(":", "n.kind", "n.value"))).alias("rules")).select(F.col("url").alias("u"), F.col("time").alias("t"), "rules")
    out = own.join(hit, (F.col("url") == F.col("u")) & (F.col("time") == F.col("t")), "left")
    rules = F.coalesce("rules", F.array().cast("array<string>"))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("time").alias(time_col), host(F.col("url")).alias("host"), F.size(rules).cast("long").alias("n_rules"), rules.alias("rules"), (F.size(rules) > 0).alias("blocked"))
