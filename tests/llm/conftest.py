from __future__ import annotations

import pytest

#: Columns whose names the operators use inside, to see that they do no harm.
CLASHING = ("id", "mark", "row", "digest", "fp", "w", "hash", "size", "target", "reps", "shard", "slot", "spans", "component_id", "f", "keep_id", "doc", "of")


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a long text, ties, repeated rows and clashing names."""
    long = "word " * 60_000 + "end"
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a"),
        (2, "The quick  brown fox jumps over the\tlazy dog near the old river bank today.", "en", "a"),
        (2, "The quick  brown fox jumps over the\tlazy dog near the old river bank today.", "en", "a"),
        (3, None, "en", "b"),
        (4, "", None, None),
        (5, " \n\t ", "de", "b"),
        (None, "Der schnelle braune Fuchs springt über den faulen Hund und läuft davon.", "de", "c"),
        (None, None, None, None),
        (7, long, "en", "a"),
        (8, "\U0001f600 12 34 ?!", "fr", "c"),
        (9, "Le renard brun saute par-dessus le chien paresseux près de la rivière.", "fr", "c"),
        (9, "Another text with the same id.", "en", None),
    ]
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(rows, schema)
    for name in CLASHING:
        docs = docs.selectExpr("*", f"'x' AS `{name}`")
    return docs


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.where("false")
