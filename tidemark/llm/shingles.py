"""Words and hashed shingles of texts, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from tidemark.llm.common import remembered

_M = np.uint64(0x9E3779B97F4A7C15)
_N = np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """64-bit hash of a word, remembered; the memory starts anew beyond a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 500_000:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


HASHES = WordHashes()
remembered(HASHES.clear, *(f"tidemark.llm.{n}" for n in ("jaccard_join", "importance", "substring_dedup", "anchored")))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _M
    values = (values ^ (values >> np.uint64(29))) * _N
    return values ^ (values >> np.uint64(32))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order; one of all words if there are fewer."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(size, n)
    code = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        code = (code ^ hashes[k : n - size + 1 + k]) * _M
        code ^= code >> np.uint64(31)
    return mix(code)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()
