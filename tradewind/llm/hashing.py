"""Vectorised 64-bit hashes of words, character n-grams and word windows over a run of texts."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: An odd base and its inverse modulo 2^64: a substring's hash is a difference of prefix sums, shifted back.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=_U)
    if n:
        out[0] = 1
        done, step = 1, base
        while done < n:
            take = min(done, n - done)
            out[done : done + take] = out[:take] * _U(step)
            done, step = done + take, (step * step) & (2**64 - 1)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all input bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Texts:
    """Texts laid end to end as code points, each closed by a line feed; null counts as empty.

    ``start`` and ``end`` bound each text, ``word_start``, ``word_end`` and ``word_doc`` each word.
    ``fold`` maps A-Z to a-z first.
    """

    def __init__(self, texts: list[str | None], fold: bool = False):
        texts = [t or "" for t in texts]
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.code = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.end = np.cumsum(lengths + 1) - 1
        self.start = self.end - lengths
        self.count = len(texts)
        if fold:
            upper = (self.code >= 65) & (self.code <= 90)
            self.code = self.code + (upper.astype(np.uint32) << np.uint32(5))
        self.space = (self.code == 32) | ((self.code >= 9) & (self.code <= 13))
        edge = np.diff(self.space.astype(np.int8), prepend=np.int8(1))
        self.word_start = np.flatnonzero(edge == -1)
        self.word_end = np.flatnonzero(edge[1:] == 1) + 1
        self.word_doc = np.searchsorted(self.end, self.word_start, side="left")
        self._sums: np.ndarray | None = None

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per code point over each text."""
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[self.end] - sums[self.start]

    def words_per_text(self) -> np.ndarray:
        return np.bincount(self.word_doc, minlength=self.count)

    def substrings(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of code[start:end] for each pair; equal text gives an equal hash."""
        if self._sums is None:
            n = len(self.code)
            self._sums = np.zeros(n + 1, dtype=_U)
            np.cumsum((self.code.astype(_U) + _U(1)) * _powers(BASE, n), out=self._sums[1:])
            self._back = _powers(INVERSE, n + 1)
        return mix64((self._sums[end] - self._sums[start]) * self._back[start] + (end - start).astype(_U))

    def words(self) -> np.ndarray:
        return self.substrings(self.word_start, self.word_end)


def windows(word: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every window of ``width`` words inside one text."""
    if len(word) < width:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=_U)
    n = len(word) - width + 1
    h = np.zeros(n, dtype=_U)
    for j in range(width):
        h = h * _U(BASE) + word[j : j + n]
    first = np.flatnonzero(doc[:n] == doc[width - 1 :])
    return first, mix64(h[first])


def hash_text(text: str) -> int:
    """The hash ``Texts.substrings`` gives this whole text."""
    t = Texts([text])
    return int(t.substrings(t.start, t.end)[0])
