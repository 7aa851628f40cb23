"""Personal data: base patterns, and terms that give a protected entity away by their co-occurrence in the corpus.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers. Each distinct value is an entity. For a
term near an entity (at most NEAR words and REACH characters away), the corpus says how much the term reveals: with n documents that hold the
entity, m that hold the term and k that hold both near each other, the pointwise mutual information
log2(k N / (n m)) reaches the information content of the entity, log2(N / n), where every document with the term has the
entity. A term discloses an entity if this share of the information content is at least DISCLOSURE, however few documents
hold the two. All its occurrences in documents with the entity become spans of kind "term": they are generalised to their
kind of word by ``sanitised``, base spans to their kind. With ``near=None`` the whole document is near.

Counts cover all documents. Copies of a text count once; texts are told apart by their SHA-256. Base spans are found on each
row itself; the places of disclosing terms are kept by text and joined to rows without moving their texts.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from sparkscour.llm.common import joined, ship, spread, written

KINDS = ("email", "ip", "card", "phone")
NEAR = 3
REACH = 200
DISCLOSURE = 0.9
#: Shorter words tell nothing of a person.
LEAST_TERM = 4
#: Most places of disclosing terms (two numbers each) that are broadcast; beyond that the join shuffles.
MAX_BROADCAST = 1_000_000
#: Most hashes of terms that are broadcast, to leave the words out of the counts that none of them can be.
MAX_HASHES = 4_000_000
#: Most marks (a number each) of texts with copies that are broadcast.
MAX_COPIES = 2_000_000
#: Texts whose words a worker holds as objects at once.
AT_ONCE = 32
#: Parts that the rows of one text are dealt to where the terms of texts are too many to broadcast.
SALTS = 16

_BEFORE_AT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A failed or finished match never ends inside a run of digits, so a search may start at runs only.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @: back over the characters of a local part, forward over a domain with a dot."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _BEFORE_AT:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m[0].split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    doubled = "0246813579"
    return sum(int(doubled[int(d)]) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _NO_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                yield m.span()


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in KINDS, then start; code points, end exclusive."""
    return [(kind, a, b) for kind in KINDS for a, b in FINDERS[kind](text or "")]


def _untouched(spans: list[tuple[str, int, int]]) -> Callable[[re.Match], bool]:
    """Whether a word is long enough for a term and touches none of the spans."""
    firsts = sorted(a for _, a, _ in spans)
    lasts = sorted(b for _, _, b in spans)
    # spans that begin before its end less those over by its start
    return lambda m: m.end() - m.start() >= LEAST_TERM and bisect_left(firsts, m.end()) == bisect_right(lasts, m.start())


def neighbours(text: str, spans: list[tuple[str, int, int]], near: int = NEAR) -> list[tuple[str, int, int, int]]:
    """(term, start, end, index of the span) of the words at most ``near`` words and REACH characters before or after a span.

    A word that touches any span, or that the reach cuts, is no term.
    """
    free = _untouched(spans)
    out = []
    for i, (_, a, b) in enumerate(spans):
        low, high = max(0, a - REACH), min(len(text), b + REACH)
        before = [m for m in _WORD.finditer(text, low, a) if m.start() > low or not low][-near:]
        after = [m for m in islice(_WORD.finditer(text, b, high), near) if m.end() < high or high == len(text)]
        out += [(m[0].lower(), m.start(), m.end(), i) for m in before + after if free(m)]
    return out


def words(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of every word of a text that touches no span."""
    free = _untouched(spans)
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text) if free(m)]


def entity(text: str, span: tuple[str, int, int]) -> str:
    """The value that a span names: lower-cased, numbers without separators."""
    kind, a, b = span
    value = text[a:b].lower()
    return f"{kind}:{value if kind in ('email', 'ip') else _NO_DIGIT.sub('', value)}"


_SPAN = "struct<start: long, end: long>"


def _found(text: Column, near: int | None) -> Column:
    """Entities of a text, the words that may be terms with all their places, and the pairs of them that are near each other (no pairs if all are)."""

    kind = DataType.fromDDL(f"struct<entities: array<string>, words: array<struct<term: string, places: array<{_SPAN}>>>, near: array<struct<term: string, entity: string>>>")

    def row(text: str) -> dict:
        spans = base_spans(text)
        named = [entity(text, s) for s in spans]
        pairs = sorted({(t, named[i]) for t, _, _, i in neighbours(text, spans, near)}) if near is not None else []
        wanted = {t for t, _ in pairs}
        places: dict[str, list[dict]] = {}
        for t, a, b in words(text, spans) if spans else ():
            if near is None or t in wanted:
                places.setdefault(t, []).append({"start": a, "end": b})
        return {"entities": sorted(set(named)), "words": [{"term": t, "places": places[t]} for t in sorted(places)], "near": [{"term": t, "entity": e} for t, e in pairs]}

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        made = to_arrow_type(kind)
        # a few texts at a time, so that the words of one batch are not all objects at once
        return pa.concat_arrays([pa.array([row(x.as_py()) for x in texts[i : i + AT_ONCE]], made) for i in range(0, max(1, len(texts)), AT_ONCE)])

    return run.asNondeterministic()(text)  # so that a filter on it doesn't run it again


def _base(text: Column) -> Column:
    @F.pandas_udf("array<struct<kind: string, start: long, end: long>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in base_spans(text)] for text in texts], dtype=object)

    return run(text)


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _documents_with(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, m): of different texts, how many hold each of ``terms``."""
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+(?:['’-][\p{L}]+)*"), F.lit(0)))).alias("term")
    docs = docs.select("text", F.xxhash64("text").alias("mark"))
    copies = written(docs.groupBy("mark").count().where("count > 1").select(F.col("mark").alias("copy")), "pii-copies")
    copies = F.broadcast(copies) if copies.count() <= MAX_COPIES else copies
    # a text whose mark no other row has is no copy and needs no name, so the shuffle takes a number for each term and task, not a row for each text
    name = F.when(F.col("copy").isNotNull(), _digest(F.col("text")))
    found = docs.join(copies, docs["mark"] == copies["copy"], "left").select(name.alias("copy"), word)
    if terms.count() <= MAX_HASHES:
        found = found.join(F.broadcast(terms.select(F.xxhash64("term").alias("hash")).distinct()), F.xxhash64(found["term"]) == F.col("hash"), "left_semi")
    counts = found.groupBy("term", "copy").agg(F.count("*").alias("rows")).groupBy("term").agg(F.sum(F.when(F.col("copy").isNull(), F.col("rows")).otherwise(1)).alias("m"))
    return counts.join(terms, "term")


def _frequency(held: DataFrame) -> DataFrame:
    """(entity, n, rows): in how many different texts each entity is; twice, as ``joined`` takes one of them."""
    return written(held.groupBy("entity").agg(F.count("*").alias("n")), "pii-frequencies").withColumn("rows", F.col("n"))


def disclosing(docs: DataFrame, word: DataFrame, near: DataFrame | None, held: DataFrame) -> DataFrame:
    """(term, entity, share) of the terms that disclose an entity. ``docs``: text, digest; ``word``: digest, term; ``held``:
    digest, entity; ``near``: term, entity for each text that holds the two near each other, None if any two of a text are."""
    seen = written(word.groupBy("term").agg(F.count("*").alias("seen")), "pii-terms").withColumn("rows", F.col("seen"))
    n = _frequency(held)
    n_words, n_held = word.count(), held.count()
    total = F.lit(float(docs.agg(F.count_distinct("digest")).first()[0] or 1))

    def share(m: str) -> Column:
        content = F.log2(total / F.col("n"))
        return F.when(content > 0, F.log2(F.col("k") * total / (F.col("n") * F.col(m))) / content).otherwise(0.0)

    if near is None:
        # the two are together in no more documents than the rarer is in, so pairs beyond this cannot disclose and need not be made
        reach = F.log2(total / F.greatest("n", "seen")) >= DISCLOSURE * F.log2(total / F.col("n")) - 1e-9
        near = joined(word, seen, "term", "rows", n_words).join(joined(held, n, "entity", "rows", n_held), "digest").where(reach).select("term", "entity")
    pairs = written(near.groupBy("term", "entity").agg(F.count("*").alias("k")), "pii-together")
    # a term is in no fewer documents than it was seen in here, so this share is never below the true one
    likely = joined(pairs, seen, "term", "rows", n_words).join(n.drop("rows"), "entity").where(share("seen") >= DISCLOSURE)
    likely = written(likely.select("term", "entity", "k", "n", "seen"), "pii-pairs")
    m = _documents_with(docs, written(likely.select("term").distinct(), "pii-likely"))
    # the two sides may read rare letters differently, but a term is in all documents that it was seen in
    likely = likely.join(m, "term", "left").withColumn("m", F.greatest(F.coalesce("m", F.lit(0)), "seen"))
    return likely.select("term", "entity", share("m").alias("share")).where(F.col("share") >= DISCLOSURE)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int | None = NEAR) -> DataFrame:
    """Per row: id_col, text, spans (array of kind, start, end; base kinds as in KINDS, then "term", each by start).

    ``near``: at most so many words from an entity a term is counted; None for the whole document.

    A null text is empty and has no spans. Repeated rows come back as often as they are there, and count once in the
    statistics; so do other rows with their text. Rows without id are rows like any other. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("id"), text.alias("text"))
    found = rows.select(_digest(F.col("text")).alias("digest"), _found(F.col("text"), near).alias("f")).select("digest", "f.*").where(F.size("entities") > 0)
    hits = written(found.groupBy("digest").agg(*(F.first(c).alias(c) for c in ("entities", "words", "near"))), "pii-hits")
    held = written(hits.select("digest", F.explode("entities").alias("entity")), "pii-entities")
    word = written(hits.select("digest", F.explode("words").alias("w")).select("digest", "w.*"), "pii-words")
    pairs = None if near is None else hits.select(F.explode("near").alias("n")).select("n.*")
    told = written(disclosing(rows.withColumn("digest", _digest(F.col("text"))), word.drop("places"), pairs, held), "pii-disclosing")
    told = written(told.groupBy("entity").agg(F.collect_set("term").alias("terms")).join(_frequency(held).drop("n"), "entity"), "pii-told")
    terms = joined(held, told, "entity", "rows", held.count()).select("digest", F.explode("terms").alias("term")).distinct()
    # by text and term, so that no key is hotter than one word of one text
    places = word.join(terms, ["digest", "term"]).groupBy("digest").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
    places = written(places, "pii-places")
    own = rows.select("id", "text", _digest(F.col("text")).alias("of"), _base(F.col("text")).alias("base"))
    if places.agg(F.coalesce(F.sum(F.size("places") + 4), F.lit(0))).first()[0] <= MAX_BROADCAST:
        out = own.join(F.broadcast(places), own["of"] == places["digest"], "left")
    else:
        own = own.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        places = places.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = own.join(places, (own["of"] == places["digest"]) & (own["salt"] == places["part"]), "left")
    more = F.transform("places", lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return out.select(F.col("id").alias(id_col), "text", F.concat("base", F.coalesce(more, F.array().cast("array<struct<kind: string, start: long, end: long>>"))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] != "term")


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int | None = NEAR) -> DataFrame:
    """``docs``' ids and texts with every span replaced by its kind in angle brackets; overlapping spans become one."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, spans, strict=True):
            parts, done = [], 0
            for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= done:
                    parts += [text[done : s["start"]], f"<{s['kind']}>"]
                done = max(done, s["end"])
            out.append("".join([*parts, text[done:]]))
        return pd.Series(out, dtype=object)

    return spans(docs, id_col, text_col, near).select(id_col, run("text", "spans").alias(text_col))
