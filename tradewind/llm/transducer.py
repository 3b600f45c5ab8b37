"""Minimal acyclic transducers from sorted terms to their ordinals, walked by many terms of a text at once."""

from __future__ import annotations

import io
from collections.abc import Iterable

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)


def build(terms: Iterable[bytes]) -> bytes:
    """The transducer of strictly ascending byte strings, as stored bytes.

    Terms are added in order; a state is finished when the next term leaves it, and states with the same
    finality and edges become one. An edge carries how many terms of its state come before it, so the
    sum along a term is its ordinal.
    """
    register: dict[tuple, int] = {}
    edges: list[tuple[int, int, int, int]] = []
    final: list[bool] = []
    below: list[int] = []
    # The states of the last term that are still open: [is final, edges as byte, state, byte, state, ...].
    path: list[list] = [[False, []]]

    def close(node: list) -> int:
        key = (node[0], *node[1])
        state = register.get(key)
        if state is None:
            state = register[key] = len(final)
            final.append(node[0])
            count = int(node[0])
            for byte, to in zip(node[1][::2], node[1][1::2]):
                edges.append((state, byte, to, count))
                count += below[to]
            below.append(count)
        return state

    last = b""
    for number, term in enumerate(terms):
        if number and term <= last:
            raise ValueError("terms must be strictly ascending")
        same = 0
        while same < len(last) and same < len(term) and last[same] == term[same]:
            same += 1
        for at in range(len(last), same, -1):
            node = path.pop()
            path[-1][1] += (last[at - 1], close(node))
        for _ in range(len(term) - same):
            path.append([False, []])
        path[-1][0] = True
        last = term
    for at in range(len(last), 0, -1):
        node = path.pop()
        path[-1][1] += (last[at - 1], close(node))
    root = close(path[0])
    table = np.array(edges, dtype=np.int64).reshape(-1, 4)
    out = io.BytesIO()
    np.savez(out, edges=table.astype(np.int32), final=np.array(final), root=np.array(root), terms=np.array(below[root]))
    return out.getvalue()


class Transducer:
    """A stored transducer, its edges in an open hash table."""

    def __init__(self, stored: bytes):
        with np.load(io.BytesIO(stored)) as parts:
            edges, self.final, self.root, self.terms = parts["edges"], parts["final"], int(parts["root"]), int(parts["terms"])
        self.states = len(self.final)
        bits = max(4, int(2 * len(edges)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._key = np.full(1 << bits, -1, dtype=np.int64)
        self._to, self._skip = np.zeros(1 << bits, dtype=np.int32), np.zeros(1 << bits, dtype=np.int32)
        keys = edges[:, 0].astype(np.int64) << 8 | edges[:, 1]
        slot, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = left[self._key[slot[left]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self._key[slot[put]], self._to[slot[put]], self._skip[slot[put]] = keys[put], edges[put, 2], edges[put, 3]
            left = left[self._key[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self._mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _ODD) >> self._shift).astype(np.int64)

    def _edge(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each (state, byte) edge; -1 where there is none."""
        slot = self._home(keys)
        there = self._key[slot]
        open_ = np.flatnonzero((there != keys) & (there != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self._mask
            there[open_] = self._key[slot[open_]]
            open_ = open_[(there[open_] != keys[open_]) & (there[open_] != -1)]
        slot[there == -1] = -1
        return slot

    def walk(self, code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Ordinal of ``code[start:end]`` for each pair, -1 if it is no term; all take one byte a step."""
        found = np.full(len(start), -1, dtype=np.int64)
        who, at, stop = np.arange(len(start)), start.astype(np.int64), end.astype(np.int64)
        state, sum_ = np.full(len(start), self.root, dtype=np.int64), np.zeros(len(start), dtype=np.int64)
        while len(who):
            over = at == stop
            if over.any():
                ended = over & self.final[state]
                found[who[ended]] = sum_[ended]
                who, at, stop, state, sum_ = (x[~over] for x in (who, at, stop, state, sum_))
            slot = self._edge(state << 8 | code[at])
            on = slot >= 0
            who, at, stop, slot = who[on], at[on] + 1, stop[on], slot[on]
            state, sum_ = self._to[slot].astype(np.int64), sum_[on] + self._skip[slot]
        return found
