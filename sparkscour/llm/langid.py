"""Language identification in two steps: the language family, then one-versus-one linear support vector machines
between the languages of that family. Where more than GROUP languages (or groups) would duel, groups of neighbours by code
duel first, so the duels grow with the number of languages and not with its square.

Features are relative frequencies of hashed character n-grams of the whole text. Models are fitted on the driver from a
bounded, seeded sample of labelled rows (``per_language`` of each language, fewer where that makes more than MOST_ROWS rows or
MOST_BYTES of features); every row is scored on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscour.llm.common import ship, spread, written
from sparkscour.llm.linear import Rows, fit, sigmoid
from sparkscour.llm.ngrams import buckets, counted, letters

UNKNOWN = "und"
SIZES = (1, 2, 3, 4)
BITS = 16
PER_LANGUAGE = 400
#: Rows that are learned, of all languages; each language has LEAST_ROWS at least.
MOST_ROWS, LEAST_ROWS = 80_000, 10
#: Bytes of their features, which the driver holds; rows of long texts are then fewer.
MOST_BYTES = 200 << 20
#: Most names that duel with each other; no family of FAMILIES is larger.
GROUP = 12
#: Frequencies are small; this brings them near 1.
SCALE = 30.0
PENALTY, STEPS = 1e-3, 100

# ISO 639-1 codes by family. A code that is not listed is in the family "other".
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "semitic": "ar he mt am",
    "indic": "hi bn mr ne pa gu ur",
    "iranian": "fa ku ps",
    "dravidian": "ta te kn ml",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(language: str) -> str:
    return _FAMILY.get(language.lower().split("-")[0], "other")


Group = tuple  # of languages and groups of them


def grouped(names: list) -> list:
    """``names``, or where they are more than GROUP, tuples of neighbours, in at most GROUP of them."""
    while len(names) > GROUP:
        n = -(-len(names) // GROUP)
        names = [tuple(names[len(names) * i // n : len(names) * (i + 1) // n]) for i in range(n)]
    return names


def leaves(name: str | Group) -> list[str]:
    return [name] if isinstance(name, str) else [x for part in name for x in leaves(part)]


@dataclass
class Duels:
    """The duels of one family or group: by bucket that occurs in its sample (``place``, else the last row) and column."""

    pairs: dict[tuple, int]
    place: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def margins(self, parts: list[np.ndarray], n: int) -> np.ndarray:
        total = np.zeros(self.weights.shape[1])
        for part in parts:
            total += self.weights.take(self.place[part], axis=0).sum(axis=0, dtype=np.float64)
        return total / n * SCALE + self.bias


@dataclass
class Model:
    """``members``: what duels in each family or group; a positive margin in the ``pairs`` of ``duels`` votes for the first."""

    families: list[str]
    members: dict[str | Group, list]
    duels: dict[str | Group | None, Duels]

    @property
    def pairs(self) -> dict[tuple, int]:
        """All duels, numbered."""
        return {pair: i for i, pair in enumerate(pair for of in self.duels.values() for pair in of.pairs)}

    def choose(self, of: str | Group | None, names: list, parts: list[np.ndarray], n: int) -> tuple[str | Group, float]:
        """The name that wins most of its duels, by their sigmoids, and its mean share of them."""
        if len(names) == 1:
            return names[0], 1.0
        duels = self.duels[of]
        margins = duels.margins(parts, n)
        won = dict.fromkeys(names, 0.0)
        for a, b in combinations(names, 2):
            p = sigmoid(3 * margins[duels.pairs[a, b]])
            won[a] += p
            won[b] += 1 - p
        best = max(names, key=lambda x: (won[x], leaves(x)))
        return best, won[best] / (len(names) - 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not (any(map(str.isalpha, text))) or not self.families:
            return UNKNOWN, 0.0
        data = letters(text)
        if not data.strip():
            return UNKNOWN, 0.0
        parts = list(buckets(data, SIZES, BITS))
        n = sum(map(len, parts))
        kin, score = self.choose(None, self.families, parts, n)
        best = ("family", kin)
        while best in self.members:
            best, p = self.choose(best, self.members[best], parts, n)
            score *= p
        return best, score


def _duel(rows: list[tuple[np.ndarray, np.ndarray]], sides: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    made = Rows([c for c, _ in rows], [n / max(1, n.sum()) * SCALE for _, n in rows], width)
    rows.clear()  # they are in ``made`` now
    return fit(made, sides, "hinge", PENALTY, STEPS)


def train(sample: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """From (language, buckets, counts) of each sampled row."""
    languages = sorted({x for x, _, _ in sample})
    kin = sorted({family(x) for x in languages})
    members: dict = {("family", f): grouped([x for x in languages if family(x) == f]) for f in kin}
    for name in [x for names in members.values() for x in names]:
        _add_groups(name, members)
    duels = {}
    if len(kin) > 1:
        duels[None] = _duels(kin, [(family(x), c, n) for x, c, n in sample])
    for of, names in members.items():
        if len(names) > 1:
            part = {x: name for name in names for x in leaves(name)}
            duels[of] = _duels(names, [(part[x], c, n) for x, c, n in sample if x in part])
    return Model(kin, members, duels)


def _add_groups(name: str | Group, members: dict) -> None:
    if not isinstance(name, str):
        members[name] = list(name)
        for part in name:
            _add_groups(part, members)


def _duels(names: list, sample: list[tuple[str | Group, np.ndarray, np.ndarray]]) -> Duels:
    used = np.unique(np.concatenate([c for _, c, _ in sample]))
    place = np.full(1 << BITS, len(used), np.int32)
    place[used] = np.arange(len(used))
    pairs = {pair: i for i, pair in enumerate(combinations(names, 2))}
    weights, bias = np.zeros((len(used) + 1, len(pairs)), np.float32), np.zeros(len(pairs))
    for (a, b), i in pairs.items():
        mine = [(c, n, x) for x, c, n in sample if x in (a, b)]
        w, bias[i] = _duel([(place[c], n) for c, n, _ in mine], np.array([1.0 if x == a else -1.0 for _, _, x in mine]), len(used))
        weights[:-1, i] = w
    return Duels(pairs, place, weights, bias)


def remainder(id_: Column) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % 4


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & (remainder(F.col("id")) != 2) & F.col("text").rlike(r"\p{L}"))
    # a text has at most one feature for each byte and size, and no more than there are buckets; two numbers of four bytes each
    room = F.least(F.octet_length("text") * len(SIZES), F.lit(1 << BITS)) * 8
    n = rows.groupBy("lang").agg(F.count("*").alias("n"), F.avg(room).alias("bytes")).select(F.col("lang").alias("of"), "n", "bytes")
    n = written(n, "languages")
    per_language = min(per_language, max(LEAST_ROWS, MOST_ROWS // max(1, n.count())))
    rows_of = F.least("n", F.lit(per_language))
    size = n.agg(F.coalesce(F.sum(rows_of * F.col("bytes")), F.lit(0.0))).first()[0]
    wanted = F.greatest(F.lit(LEAST_ROWS), rows_of * min(1.0, MOST_BYTES / max(1.0, size)))
    draw = F.pmod(F.xxhash64(F.lit("language"), "id"), F.lit(1 << 30)) / float(1 << 30)

    @F.pandas_udf("struct<buckets: binary, counts: binary>")
    def featured(texts: pd.Series) -> pd.DataFrame:
        found = [counted(letters(x), SIZES, BITS) for x in texts]
        return pd.DataFrame({"buckets": [a.tobytes() for a, _ in found], "counts": [b.tobytes() for _, b in found]})

    chosen = rows.join(F.broadcast(n), F.col("lang") == F.col("of")).where(draw * F.col("n") < wanted)
    got = chosen.select("lang", "id", featured("text").alias("f")).orderBy("lang", "id").collect()
    return [(x.lang, np.frombuffer(x.f.buckets, np.int32), np.frombuffer(x.f.counts, np.int32)) for x in got]


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model from about ``per_language`` rows of each language, chosen by a hash of the id among the rows that are not
    held out (crc32 of the id as text, modulo 4, is 2), have a language and a letter. The sample's whole texts count."""
    ship(docs.sparkSession)
    return train(_sample(docs, id_col, text_col, lang_col, per_language))


def predicted(spark: SparkSession, model: Model, text: Column) -> Column:
    """struct<lang_pred, score>: und and 0 for a null text or one without a letter."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.predict(x) for x in texts]
        return pd.DataFrame({"lang_pred": [a for a, _ in found], "score": [b for _, b in found]})

    return run.asNondeterministic()(text.cast("string"))  # so that a filter on it doesn't run it again


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id_col, held_out, lang_pred, score.

    Texts that are null or have no letter are ``und``; so is every text if no row has a language to learn from. Rows
    without id are neither learned from nor held out. Repeated rows come back as often as they are there. Texts of any length
    are read whole, in blocks. Of languages that win alike, the last by code is predicted. Other columns are not read,
    whatever they are called. An empty table gives no rows.
    """
    docs = spread(docs.select(id_col, text_col, lang_col))
    model = fitted(docs, id_col, text_col, lang_col)
    found = docs.select(F.col(id_col), F.coalesce(remainder(F.col(id_col)) == 2, F.lit(False)).alias("held_out"), predicted(docs.sparkSession, model, F.col(text_col)).alias("f"))
    return found.select(id_col, "held_out", "f.lang_pred", "f.score")


def recognised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language is ``und``; a row without a language gets the predicted one.

    Null texts and texts without a letter go. Repeated rows and rows without id stay like any other. Columns keep their names,
    order and values, whatever they are called. An empty table gives no rows.
    """
    docs = spread(docs)
    model = fitted(docs, id_col, text_col, lang_col)
    rows = docs.select(F.struct("*").alias("row"), predicted(docs.sparkSession, model, F.col(text_col)).alias("f"))
    rows = rows.where(F.col("f.lang_pred") != UNKNOWN)
    return rows.select(*(F.coalesce("row." + c, "f.lang_pred").alias(c) if c == lang_col else F.col("row." + c) for c in docs.columns))
