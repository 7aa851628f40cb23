"""Hashed character n-grams of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that are hashed in one go; bounds memory for texts of any length.
BLOCK = 1 << 20
#: ASCII bytes that are not letters become spaces.
_LETTERS = bytes(b if chr(b).isalpha() or b >= 0x80 else 0x20 for b in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str | None) -> bytes:
    """Lower-cased words of a text with a space before, between and after them; ASCII other than letters separates."""
    return b" " + b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()) + b" "


def buckets(data: bytes, sizes: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """Bucket numbers below 2**bits of the byte n-grams of every size, in blocks."""
    longest = max(sizes)
    for at in range(0, max(len(data), 1), BLOCK):
        octets = np.frombuffer(data[at : at + BLOCK + longest - 1], np.uint8).astype(np.uint64)
        packed = np.zeros(len(octets), np.uint64)
        for n in range(1, longest + 1):
            room = len(octets) - n + 1
            if room <= 0:
                break
            packed = (packed[:room] << np.uint64(8)) | octets[n - 1 :]
            if n in sizes:
                own = min(room, BLOCK)
                yield ((packed[:own] + np.uint64(n << 56)) * _FACTOR >> np.uint64(64 - bits)).astype(np.int64)


def counted(data: bytes, sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    total: np.ndarray | None = None
    for part in buckets(data, sizes, bits):
        now = np.bincount(part, minlength=1 << bits)
        total = now if total is None else total + now
    if total is None:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    found = np.flatnonzero(total)
    return found.astype(np.int32), total[found].astype(np.int32)
