"""MD5 of many short texts at once: numbers from 0 on behind one head, as numpy arrays of the digests' words.

A digest by itself costs a call; the 64 steps on arrays of tens of thousands of texts cost a few
nanoseconds each. Only texts of one 64-byte block are made here, which is all that numbered heads need.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np

#: Texts that are digested one by one where there are no more, and texts in one array.
FEW, CHUNK = 256, 1 << 15
TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _digest(words: list, n: int) -> list[np.ndarray]:
    """The four words of the digests of ``n`` blocks; each of their 16 words is one number for all, or an array."""
    a, b, c, d = (np.full(n, s, dtype=np.uint32) for s in START)
    f, turned = np.empty(n, dtype=np.uint32), np.empty(n, dtype=np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
            word = words[i]
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
            word = words[(5 * i + 1) % 16]
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
            word = words[(3 * i + 5) % 16]
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
            word = words[7 * i % 16]
        np.add(a, f, out=a)
        alike = isinstance(word, int)
        if not alike:
            np.add(a, word, out=a)
        np.add(a, np.uint32((SINES[i] + (word if alike else 0)) % 2**32), out=a)
        turn = TURNS[i // 16][i % 4]
        np.left_shift(a, np.uint32(turn), out=turned)
        np.right_shift(a, np.uint32(32 - turn), out=a)
        np.bitwise_or(a, turned, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return [v + np.uint32(s) for v, s in zip((a, b, c, d), START)]


def _chunks(count: int, begin: int) -> Iterator[tuple[int, int, int, dict[int, np.ndarray]]]:
    """(first number, count, digits, words of a block that the digits fill) when the digits start at byte ``begin``."""
    low, digits = 0, 1
    while low < count:
        high = min(count, low + CHUNK, 10**digits)
        number, filled = np.arange(low, high), {}
        for at in range(begin + digits - 1, begin - 1, -1):
            filled[at // 4] = filled.get(at // 4, np.uint32(0)) | (number % 10 + 48).astype(np.uint32) << np.uint32(8 * (at % 4))
            number = number // 10
        yield low, high - low, digits, filled
        low, digits = high, digits + (high == 10**digits)


def numbered_digests(heads: Iterable[bytes], count: int) -> Iterator[list[np.ndarray]]:
    """For each head: the four 32-bit words, highest byte first, of md5(head + number) for the numbers 0 up to ``count``."""
    begin, chunks = -1, []
    for head in heads:
        if len(head) + len(str(count)) > 55:
            raise ValueError("head and number must fit one block")
        if count <= FEW:
            digests = b"".join(hashlib.md5(head + b"%d" % q).digest() for q in range(count))
            yield list(np.frombuffer(digests, dtype=">u4").reshape(-1, 4).T.astype(np.uint32))
            continue
        if len(head) != begin:
            begin, chunks = len(head), list(_chunks(count, len(head)))
        out = [np.empty(count, dtype=np.uint32) for _ in range(4)]
        for low, n, digits, filled in chunks:
            size = begin + digits
            block = np.frombuffer(head + bytes(digits) + b"\x80" + bytes(55 - size) + (8 * size).to_bytes(8, "little"), dtype="<u4")
            words = [filled[i] | block[i] if i in filled else int(block[i]) for i in range(16)]
            for o, v in zip(out, _digest(words, n)):
                o[low : low + n] = v.byteswap()
        yield out
