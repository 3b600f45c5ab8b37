"""A bidirectional FM-index over a delimited vocabulary, searched for many words at once."""

from __future__ import annotations

import numpy as np

#: Words searched together, so the open branches of a search stay bounded.
TOGETHER = 4000


class Ranks:
    """Occurrences of symbols in a sequence up to a place: a wavelet matrix, one row of counts a bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.zeros, self.rows = bits, [], []
        left = symbols
        for level in reversed(range(bits)):
            clear = (left >> level & 1) == 0
            self.rows.append(np.concatenate(([0], np.cumsum(clear))).astype(np.int32))
            self.zeros.append(int(self.rows[-1][-1]))
            left = np.concatenate((left[clear], left[~clear]))
        self.first = np.zeros(1 << bits, dtype=np.int64)
        for symbol in range(1 << bits):
            at = 0
            for level, (row, zeros) in enumerate(zip(self.rows, self.zeros)):
                at = int(row[at]) if not symbol >> (bits - 1 - level) & 1 else zeros + at - int(row[at])
            self.first[symbol] = at

    def of(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of ``symbol`` before ``low`` and before ``high``, and of lesser symbols between them."""
        less = np.zeros(len(low), dtype=np.int64)
        for level, (row, zeros) in enumerate(zip(self.rows, self.zeros)):
            one = symbol >> (self.bits - 1 - level) & 1 == 1
            zl, zh = row[low].astype(np.int64), row[high].astype(np.int64)
            less += np.where(one, zh - zl, 0)
            low, high = np.where(one, zeros + low - zl, zl), np.where(one, zeros + high - zh, zh)
        return low - self.first[symbol], high - self.first[symbol], less

    def within(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """Every symbol of each range once: (range, symbol, before low, before high, lesser symbols between)."""
        of, symbol, less = np.arange(len(low)), np.zeros(len(low), dtype=np.int64), np.zeros(len(low), dtype=np.int64)
        for row, zeros in zip(self.rows, self.zeros):
            zl, zh = row[low].astype(np.int64), row[high].astype(np.int64)
            a, b = zh > zl, high - zh > low - zl
            of, symbol = np.concatenate((of[a], of[b])), np.concatenate((symbol[a] << 1, symbol[b] << 1 | 1))
            less = np.concatenate((less[a], less[b] + (zh - zl)[b]))
            low, high = np.concatenate((zl[a], zeros + (low - zl)[b])), np.concatenate((zh[a], zeros + (high - zh)[b]))
        return of, symbol, low - self.first[symbol], high - self.first[symbol], less


def _suffix_order(text: np.ndarray, words: int) -> np.ndarray:
    """Places of ``text`` by the order of what follows. Its words are sorted and each stands between zeros.

    A delimiter ranks by the word after it, so doubling the compared length ends at the longest word.
    """
    n = len(text)
    rank = text.astype(np.int64) + words
    gaps = np.flatnonzero(text == 0)
    rank[gaps] = np.append(np.arange(1, words + 1), 0)
    width = 1
    while True:
        after = np.full(n, -1, dtype=np.int64)
        after[:-width] = rank[width:]
        key = rank * (int(rank.max()) + 2) + after + 1
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.concatenate(([0], np.diff(key[order]) != 0)))
        if rank[order[-1]] == n - 1 or 2 * width >= n:
            return order
        width *= 2


class Index:
    """Intervals of suffix ranks over distinct words, read forward and backward in step.

    An interval is (rank in the text, rank in the reversed text, size). A delimiter opens and closes every
    word, so the interval of a whole delimited word has one row, whose rank in the text gives the word.
    """

    def __init__(self, words: list[str]):
        self.words = sorted(words)
        self.code, self.start, self.end = self._laid(self.words)
        self.letters = np.unique(self.code)
        self.code = np.searchsorted(self.letters, self.code) + 1
        bits = max(1, int(len(self.letters)).bit_length())
        self.forward = self._half(self.code, self.start, self.end, bits)
        backward = sorted(w[::-1] for w in self.words)
        code, start, end = self._laid(backward)
        self.backward = self._half(np.searchsorted(self.letters, code) + 1, start, end, bits)

    @staticmethod
    def _laid(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        end = np.cumsum(lengths)
        return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64), end - lengths, end

    def _half(self, code: np.ndarray, start: np.ndarray, end: np.ndarray, bits: int) -> tuple[Ranks, np.ndarray]:
        text = np.zeros(len(code) + len(start) + 1, dtype=np.int64)
        text[np.arange(len(code)) + np.repeat(np.arange(1, len(start) + 1), end - start)] = code
        order = _suffix_order(text, len(start))
        below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=1 << bits))))
        return Ranks(text[order - 1], bits), below

    def near(self, asked: np.ndarray, from_start: bool) -> tuple[np.ndarray, np.ndarray]:
        """(asked word, other word) with one letter replaced or one more letter, as numbers into ``words``.

        ``from_start``: the first half agrees and the rest is read to the right with one error; else the
        last half agrees and the rest is read to the left. A pair agrees in one half at least.
        """
        found = [self._near(asked[i : i + TOGETHER], from_start) for i in range(0, len(asked), TOGETHER)]
        return tuple(np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in zip(*found)) if found else (np.empty(0, dtype=np.int64),) * 2

    def _near(self, asked: np.ndarray, from_start: bool) -> tuple[np.ndarray, np.ndarray]:
        ranks, below = self.backward if from_start else self.forward
        length = (self.end - self.start)[asked]
        exact = length // 2 if from_start else length - length // 2
        begin, way = (self.start[asked], 1) if from_start else (self.end[asked] - 1, -1)
        none = np.empty(0, dtype=np.int64)
        got: list[tuple[np.ndarray, np.ndarray]] = []
        # Open branches: word, letters read, rank on the side read from, rank on the other, size. First those without error.
        zero = np.zeros(len(asked), dtype=np.int64)
        clean = [np.arange(len(asked)), zero, zero, zero, zero + len(self.words) + 1]
        wrong = [none] * 5

        def stepped(branch: list[np.ndarray], symbol: np.ndarray) -> list[np.ndarray]:
            who, read, near, far, size = branch
            low, high, less = ranks.of(symbol, near, near + size)
            on = high > low
            return [who[on], read[on] + 1, (below[symbol] + low)[on], (far + less)[on], (high - low)[on]]

        def letter(branch: list[np.ndarray]) -> np.ndarray:
            who, read = branch[0], branch[1]
            inside = read < length[who]
            return np.where(inside, self.code[np.where(inside, begin[who] + way * read, 0)], 0)

        while len(clean[0]) or len(wrong[0]):
            # With the error behind them, branches follow the word; the one after its end must be a delimiter.
            done = wrong[1] > length[wrong[0]]
            got.append((wrong[0][done], (wrong[3] if from_start else wrong[2])[done] - 1))
            wrong = [x[~done] for x in wrong]
            wrong = stepped(wrong, letter(wrong)) if len(wrong[0]) else wrong
            if not len(clean[0]):
                continue
            free = clean[1] >= exact[clean[0]]
            held, loose = [x[~free] for x in clean], [x[free] for x in clean]
            clean = stepped(held, letter(held))
            if len(loose[0]):
                who, read, near, far, size = loose
                of, symbol, low, high, less = ranks.within(near, near + size)
                want = letter(loose)[of]
                child = lambda at, more: [who[of[at]], read[of[at]] + more, (below[symbol] + low)[at], (far[of] + less)[at], (high - low)[at]]
                match = child((symbol == want) & (want > 0), 1)
                clean = [np.concatenate(x) for x in zip(clean, match)]
                # One more letter in the other word, or another one in place of this word's. A letter added before
                # an equal one is the same as one added after it, so it waits for the end of their run.
                other = (symbol > 0) & (symbol != want)
                for branch in (child(other, 0), child(other & (want > 0), 1)):
                    wrong = [np.concatenate(x) for x in zip(wrong, branch)]
        pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*got)], axis=1), axis=0) if got else np.empty((0, 2), dtype=np.int64)
        return asked[pairs[:, 0]], pairs[:, 1]
