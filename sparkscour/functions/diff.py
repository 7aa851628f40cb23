"""Differences between two texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from difflib import SequenceMatcher
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkscour.functions.patterns import js
from sparkscour.operators.engine import Change

#: Texts longer than this together are not compared word by word, one by one; the column compares all.
LONGEST = 800_000
#: Bytes of the places of parts that are held at once, those of the most common parts; the others are made when they are met.
MASKS = 64_000_000
#: Where a walk along two lists meets again: so many parts of the first, and of the second, are passed; the fewest first.
STEPS = sorted(((i, j) for i in range(9) for j in range(9) if i + j), key=lambda x: (sum(x), abs(x[0] - x[1])))


def _shared(a: Sequence[str], b: Sequence[str]) -> tuple[int, int]:
    """How many characters two texts, or parts two lists, share at the start, and then at the end."""
    most = min(len(a), len(b))
    start = next((i for i in range(most) if a[i] != b[i]), most)
    end = next((i for i in range(most - start) if a[-1 - i] != b[-1 - i]), most - start)
    return start, end


def edits(before: str, after: str) -> list[Change]:
    """Changes that make ``after`` of ``before``, at its offsets, in order."""
    start, end = _shared(before, after)
    a, b = before[start : len(before) - end], after[start : len(after) - end]
    found = SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    return [Change(start + i, start + j, b[k:n]) for tag, i, j, k, n in found if tag != "equal"]


def _walked(a: list[str], b: list[str]) -> tuple[Counter, Counter] | None:
    """Parts removed and inserted, by one walk along both lists. What any difference must remove is what ``a`` has more often
    than ``b``, so a walk that removes nothing that it also inserts has found the shortest; None for another."""
    removed, inserted = [], []
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i += 1
            j += 1
            continue
        step = next(((m, n) for m, n in STEPS if i + m < len(a) and j + n < len(b) and a[i + m] == b[j + n]), None)
        if step is None:
            break
        removed += a[i : i + step[0]]
        inserted += b[j : j + step[1]]
        i, j = i + step[0], j + step[1]
    gone, new = Counter(removed + a[i:]), Counter(inserted + b[j:])
    return (gone, new) if gone.keys().isdisjoint(new) else None


def _places(a: list[str], b: list[str]) -> int:
    """Bits, one for each part of ``b``: 0 where one more part of ``b`` makes the longest list that is in both one longer."""
    at: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        at.setdefault(x, []).append(j)

    def places(x: str) -> int:
        mask = bytearray(len(b) // 8 + 1)
        for j in at.get(x, ()):
            mask[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(mask, "little")

    held = {x: places(x) for x, _ in Counter(a).most_common(MASKS // (len(b) // 8 + 1))}
    every = bits = (1 << len(b)) - 1
    for x in a:
        met = bits & (held[x] if x in held else places(x))
        bits = (bits + met | bits - met) & every
    return bits


def _lengths(bits: int, n: int) -> list[int]:
    """How many of the first 0, 1, ..., n bits are 0."""
    return [0, *accumulate(x == "0" for x in reversed(f"{bits:0{n}b}"))]


def _kept(a: list[str], b: list[str]) -> Counter:
    """Parts of a longest list that is in both, in order: all rows of a table at once as bits, by halves of ``a``, so that memory
    grows with the lists and not with their product."""
    kept: Counter = Counter()
    open_pairs = [(a, b)]
    while open_pairs:
        a, b = open_pairs.pop()
        start, end = _shared(a, b)
        kept.update(a[:start])
        kept.update(a[len(a) - end :])
        a, b = a[start : len(a) - end], b[start : len(b) - end]
        both = set(a) & set(b)
        a, b = [x for x in a if x in both], [x for x in b if x in both]
        if len(a) > 1 and len(b) > 1:
            half = len(a) // 2
            first, second = _lengths(_places(a[:half], b), len(b)), _lengths(_places(a[:half - 1 : -1], b[::-1]), len(b))
            cut = max(range(len(b) + 1), key=lambda j: first[j] + second[len(b) - j])
            open_pairs += [(a[:half], b[:cut]), (a[half:], b[cut:])]
        elif a and b:
            kept.update(a if len(a) == 1 else b)
    return kept


def summary(before: str, after: str, longest: int | None = LONGEST) -> tuple[int, int] | None:
    """Characters inserted and removed, by whole words and spaces; None for texts that are too long (``longest``: None for no
    such limit)."""
    if longest is not None and len(before) + len(after) > longest:
        return None
    parts = js(r"\s+|[^\s]+")
    a, b = parts.findall(before), parts.findall(after)
    if walked := _walked(a, b):
        gone, new = walked
        return sum(len(x) * n for x, n in new.items()), sum(len(x) * n for x, n in gone.items())
    kept = sum(len(x) * n for x, n in _kept(a, b).items())
    return len(after) - kept, len(before) - kept


def edits_column(before: Column, after: Column) -> Column:
    @F.pandas_udf("array<struct<start: int, end: int, insert: string>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[c._asdict() for c in edits(x or "", y or "")] for x, y in zip(a, b, strict=True)], dtype=object)

    return run(before, after)


def summary_column(before: Column, after: Column) -> Column:
    """struct<inserted, removed>, of texts of any length."""

    @F.pandas_udf("struct<inserted: int, removed: int>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([summary(x or "", y or "", None) for x, y in zip(a, b, strict=True)], columns=["inserted", "removed"], dtype="Int32")

    return run(before, after)
