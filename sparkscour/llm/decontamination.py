"""Benchmark decontamination: a prefix-filtered set join of item windows against documents, in DataFrame functions only.

An item's windows are its runs of WINDOW consecutive words (its whole text where it has fewer). A window is the set of
its word shingles; a document contains it only if it has all of them. So the prefix that any match must share is one
shingle, and the rarest one, counted over all documents, gives the fewest candidates. Join steps:

1. one pass over the documents, for shingles of all lengths that items need: keep the places of items' shingles, with the
   words around them that a window could reach;
2. count these places by shingle, order each window's shingles by that rarity and keep the first;
3. join the places of these prefixes with their windows; position and length bounds say where a window would have to lie;
4. verify the candidate window word by word in the words around.

Items' shingles are broadcast, a number each, up to MAX_KEYS. Beyond that, documents' shingles are dealt by their hash, as
numbers without words, and the candidates are joined back to their documents to be verified. Windows that many items share
are verified once, and name one set of items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscour.llm.common import spread, written

WINDOW = 10
SHINGLE = 5
#: Most rows (a hash and at most WINDOW words each) that are sent to every executor.
MAX_BROADCAST = 200_000
#: Most shingles of items, a hash each, that are sent to every executor, and most documents that hold a window, two hashes each.
MAX_KEYS = 2_000_000
#: Parts that the rows of one shingle are dealt to where a join shuffles.
SALTS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words; words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN_ANY_CASE), "")).cast("long")


def placed_shingles(rows: DataFrame, of: str, sizes: list[int]) -> DataFrame:
    """``rows`` once for every run of a number of words in ``sizes`` in the column ``of``: p (its first word is 1), k (the
    number) and gram (its hash)."""
    rows = rows.where(F.size(of) >= min(sizes)).select("*", F.explode(F.sequence(F.lit(1), F.size(of) - min(sizes) + 1)).alias("p"))
    gram = {k: F.xxhash64(*(F.get(of, F.col("p") + (i - 1)) for i in range(k))) for k in sizes}
    if len(sizes) == 1:
        return rows.select("*", F.lit(sizes[0]).alias("k"), gram[sizes[0]].alias("gram"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), gram[k].alias("gram")) for k in sizes))).alias("g")
    return rows.select("*", each).where(F.col("p") + F.col("g.k") - 1 <= F.size(of)).select(*rows.columns, "g.k", "g.gram")


def item_windows(items: DataFrame, item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item_id string, win array<string>, k int): windows of items that have an id and a word."""
    w = F.col("w")
    split = items.select(F.col(item_id).cast("string").alias("item_id"), words(F.col(text_col).cast("string")).alias("w")).where(F.col("item_id").isNotNull() & (F.size("w") > 0))
    length = F.least(F.lit(WINDOW), F.size(w))
    starts = F.sequence(F.lit(1), F.size(w) - length + 1)
    wins = split.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(w, i, length))).alias("win"))
    return wins.distinct().withColumn("k", F.least(F.lit(SHINGLE), F.size("win")))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST else df


def _dealt(rows: DataFrame, facts: DataFrame, key: str, *by: str) -> DataFrame:
    """``rows`` joined to ``facts`` by ``key``; those of one key go to SALTS parts, by the columns ``by``."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    facts = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(facts, [key, "salt"]).drop("salt")


def _named(rows: DataFrame, facts: DataFrame, key: str, few: bool) -> DataFrame:
    return rows.join(F.broadcast(facts), key) if few else _dealt(rows, facts, key, "id", "mark")


def occurrences(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, mark, start, length, win): every place (first word is 1) where an item's window occurs in a document.

    ``mark`` is a hash of the text, so that rows which repeat an id with other texts stay apart. A place of rows that repeat
    id and text may come more than once.
    """
    windows = written(item_windows(items, item_id, item_text), "decon-windows")
    wins = windows.select("win", "k").distinct()
    sizes = sorted(r.k for r in wins.select("k").distinct().collect())  # at most SHINGLE
    text = F.col(text_col).cast("string")
    split = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), words(text).alias("w"))
    if not sizes:
        return split.where("false").select("id", "mark", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), F.col("w").alias("win"))
    mine = placed_shingles(wins.withColumnRenamed("k", "of"), "win", sizes).where("k = of")
    mine = written(mine.groupBy("win", "gram").agg(F.min("p").alias("at")), "decon-grams")
    keys = mine.select("gram").distinct()
    placed = placed_shingles(split, "w", sizes).withColumn("size", F.size("w"))
    around = keys.count() <= MAX_KEYS
    if around:
        reach = F.col("p") - (WINDOW - F.col("k"))
        placed = placed.join(F.broadcast(keys), "gram").withColumn("from", F.greatest(F.lit(1), reach))
        placed = placed.withColumn("words", F.slice("w", F.col("from"), F.col("p") + WINDOW - F.col("from"))).drop("w", "k")
    else:
        placed = _dealt(placed.select("id", "mark", "p", "gram", "size"), keys, "gram", "id", "p")
    placed = written(placed, "decon-places")
    seen = placed.groupBy("gram").agg(F.count("*").alias("n"))
    first = mine.join(_sized(seen, seen.count()), "gram", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "at")).alias("f")).where("f.n > 0")
    prefix = written(first.select(F.col("f.gram").alias("gram"), F.col("f.at").alias("at"), "win"), "decon-prefix")
    hits = placed.join(F.broadcast(prefix), "gram") if prefix.count() <= MAX_BROADCAST else _dealt(placed, prefix, "gram", "id", "p")
    start, length = F.col("p") - F.col("at") + 1, F.size("win")
    hits = hits.where((start >= 1) & (start + length - 1 <= F.col("size"))).withColumn("start", start)
    if around:
        hits = hits.where(F.slice("words", F.greatest(F.col("start") - F.col("from") + 1, F.lit(1)), length) == F.col("win"))
    else:
        hits = written(hits.select("id", "mark", "start", "win"), "decon-candidates")
        of = hits.select(F.col("id").alias("of"), F.col("mark").alias("text_mark")).distinct()
        held = split.join(_few(of), split["id"].eqNullSafe(of["of"]) & (split["mark"] == of["text_mark"]), "left_semi").select(F.col("id").alias("doc"), F.col("mark").alias("m"), "w")
        hits = hits.join(held, hits["id"].eqNullSafe(held["doc"]) & (hits["mark"] == held["m"])).where(F.slice("w", F.col("start"), length) == F.col("win"))
    return hits.select("id", "mark", F.col("start").cast("long").alias("start"), length.cast("long").alias("length"), "win")


def _few(marks: DataFrame) -> DataFrame:
    """Ids and marks of documents, for a join that then moves no text unless they are very many."""
    return F.broadcast(marks) if marks.count() <= MAX_KEYS else marks


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: id_col, n_words, n_hit (words inside any occurrence of a window), n_items, items (sorted ids),
    contaminated (n_hit > 0).

    A null, empty or wordless text has no words and is clean. Items without id or word match nothing; repeated items
    count once. Rows that repeat an id come back as often as they are there, each with the result of its own text; a
    null id is an id like any other. Empty tables give no rows or clean rows. Other columns are not read.
    """
    sets = item_windows(items, item_id, item_text).groupBy("win").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    sets = written(sets.withColumn("set", F.sha2(F.to_json("items"), 256)), "decon-sets")
    found = written(occurrences(docs, items, id_col, text_col, item_id, item_text).distinct(), "decon-found")
    end = F.col("start") + F.col("length")
    order = Window.partitionBy("id", "mark").orderBy("start", "length")
    before = F.coalesce(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = found.select("id", "mark", "start", "length").distinct()
    hit = places.select("id", "mark", F.greatest(F.lit(0), end - F.greatest(before, F.col("start"))).alias("n")).groupBy("id", "mark").agg(F.sum("n").alias("n_hit"))
    few = sets.agg(F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0] <= MAX_BROADCAST
    named = _named(found.select("id", "mark", "win"), sets.select("win", "set"), "win", few).select("id", "mark", "set").distinct()
    items_of = sets.groupBy("set").agg(F.first("items").alias("items"))
    listed = _named(named, items_of, "set", few).groupBy("id", "mark").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    both = hit.join(listed, hit["id"].eqNullSafe(listed["id"]) & (hit["mark"] == listed["mark"])).select(hit["id"], hit["mark"], "n_hit", "items")
    text = F.col(text_col).cast("string")
    all_docs = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("of"), n_words(text).alias("n_words"))
    out = all_docs.join(both, all_docs["doc"].eqNullSafe(both["id"]) & (all_docs["of"] == both["mark"]), "left")
    return out.select(
        F.col("doc").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, with all their columns.

    Rows are told apart by id and text, so a clean row stays although another with its id goes.
    """
    text = F.col(text_col).cast("string")
    bad = written(occurrences(docs, items, id_col, text_col).select("id", "mark").distinct(), "decon-bad")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc"), F.xxhash64(text).alias("of"))
    return rows.join(_few(bad), F.col("doc").eqNullSafe(F.col("id")) & (F.col("of") == F.col("mark")), "left_anti").select("row.*")
