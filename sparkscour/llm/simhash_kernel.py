"""Word-shingle SimHash of UTF-8 text, vectorised with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE_WORDS = 4
SEED = 42
#: Shingle hashes whose bits are counted in one go; bounds the kernel's memory for texts of any length.
BLOCK = 1 << 16


def shingle_hashes(data: bytes, n_words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of every ``n_words`` consecutive words (all words where there are fewer; none where there is none).

    Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased.
    """
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(n_words, len(words))
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], seed) for a, b in pairs), np.uint64, len(words) - k + 1)


def simhash(data: bytes | None, n_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Fingerprint whose bit i is 1 if bit i is set in over half of the shingle hashes; 0 without words."""
    hashes = shingle_hashes(data or b"", n_words, seed)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        octets = hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])
