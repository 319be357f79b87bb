"""Bags of hashed word shingles, computed for many texts at once."""

from __future__ import annotations

import numpy as np

_WORD = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
#: A-Z to lower case; what is neither a digit, a letter nor beyond ASCII to a space.
TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _WORD else 0x20 for c in range(256))
BASE, STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
SLICE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """BASE ** i and its inverse modulo 2 ** 64, for i up to what was asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n >= len(self.up):
            self.up, self.down = (self._powers(x, n) for x in (BASE, pow(BASE, -1, 1 << 64)))
        return self.up, self.down

    @staticmethod
    def _powers(x: int, n: int) -> np.ndarray:
        factors = np.full(n + 1, x, np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)


def word_hashes(texts: list[bytes | None], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of each text, and the number of its text."""
    texts = [t or b"" for t in texts]
    ends = np.cumsum([len(t) + 1 for t in texts])
    data = b"".join(x for t in texts for x in (t, b"\n")).translate(TABLE)
    hashes, places = [], []
    first = 0
    while first < len(data):
        last = len(data) if len(data) - first <= SLICE else data.find(b" ", first + SLICE) + 1 or len(data)
        part = np.frombuffer(data, np.uint8, last - first, first)
        word = np.concatenate(([False], part != 0x20, [False]))
        edges = np.flatnonzero(word[1:] != word[:-1])
        begin, end = edges[::2], edges[1::2]
        up, down = powers.upto(len(part))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * up[: len(part)], dtype=np.uint64)))
        hashes.append(mix((sums[end] - sums[begin]) * down[begin]))
        places.append(begin + first)
        first = last
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.searchsorted(ends, np.concatenate(places), side="right")


def shingle_bags(texts: list[bytes | None], size: int, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count), sorted by both; a text of fewer than `size` words but not none has one shingle, all of it."""
    words, text = word_hashes(texts, powers)
    per_text = np.bincount(text, minlength=len(texts))
    first = np.cumsum(per_text) - per_text
    n = max(0, len(words) - size + 1)
    code = np.zeros(n, np.uint64)
    for k in range(size):
        code = code * np.uint64(STEP) + words[k : k + n]
    whole = text[:n] == text[size - 1 :] if n else np.zeros(0, bool)
    code, of = mix(code[whole]), text[:n][whole]
    short = np.flatnonzero((per_text > 0) & (per_text < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            there = per_text[short] > k
            extra[there] = extra[there] * np.uint64(STEP) + words[first[short[there]] + k]
        code, of = np.concatenate((code, mix(extra))), np.concatenate((of, short))
    order = np.lexsort((code, of))
    code, of = code[order], of[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(code)), bool), (code[1:] != code[:-1]) | (of[1:] != of[:-1]))))
    return of[new], code[new], np.diff(np.concatenate((new, [len(code)])))
