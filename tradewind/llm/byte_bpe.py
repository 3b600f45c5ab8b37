"""Byte-level BPE: tasks fold ranked merges over their distinct words, all words of one length at a time; decoding joins the bytes of the pieces."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import slices

#: Ids lie below this; as the rank of a pair it says that the pair does not merge.
NO_RANK = 1 << 16
#: Bytes of words of one length that are folded at once.
FOLD_BYTES = 1 << 20
#: Frequent words kept ready in every task, and the documents (by hash) they are counted on. Both only save time.
READY_WORDS, READY_DOCUMENTS = 200_000, 20_000
#: Words of the sample that a task counts before it passes its counts on.
COUNTED_WORDS = 300_000
#: Text of one block, whose new words are folded together, and new words after which it ends sooner.
BLOCK_BYTES, BLOCK_WORDS = 16 << 20, 40_000
#: Folded words that a task remembers for its next blocks; beyond, it starts anew, which costs time only.
TASK_WORDS = 400_000
# The letters of ASCII and U+00C0 to U+00FF, as a class of characters.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _finder(pattern: str) -> Callable[[str], list[str]]:
    """All matches of ``pattern`` in a text. Texts of ASCII and ``LETTERS`` alone take an equal pattern of plain classes, which is faster."""
    find = regex.compile(pattern).findall
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{LETTERS}0-9]").replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", "[0-9]")
    if r"\p" in plain:
        return find
    simple, fast = re.compile(rf"[\x00-\x7f{LETTERS}]*").fullmatch, re.compile(plain, re.ASCII).findall
    return lambda text: fast(text) if simple(text) else find(text)


class Merges:
    """Which pairs of pieces merge, and into which rank (the piece's id)."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= NO_RANK:
            raise ValueError(f"ids must be below {NO_RANK}")
        found = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    found[left * NO_RANK + right] = rank
        self.keys = np.array(sorted(found), dtype=np.int64)
        self.ranks = np.array([found[k] for k in self.keys.tolist()], dtype=np.int32)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.starts = self.rank(np.repeat(self.bytes, 256), np.tile(self.bytes, 256)).reshape(256, 256)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, ``NO_RANK`` if it does not merge."""
        if not len(self.keys):
            return np.full(len(left), NO_RANK, dtype=np.int32)
        key = left.astype(np.int64) * NO_RANK + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.int32(NO_RANK))

    def fold(self, words: list[str]) -> list[bytes]:
        """Ids of each word (none empty) as little-endian 32-bit integers."""
        data = [w.encode() for w in words]
        sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        order, out = np.argsort(sizes, kind="stable"), [b""] * len(data)
        for of in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(data) else []:
            step = max(1, FOLD_BYTES // int(sizes[of[0]]))
            for start in range(0, len(of), step):
                self._fold(data, of[start : start + step], out)
        return out

    def _fold(self, data: list[bytes], of: np.ndarray, out: list[bytes]) -> None:
        """The words ``of``, of equal length: in each step the adjacent pair of least rank (leftmost first) of every word merges, until none can."""
        flat = np.frombuffer(b"".join([data[i] for i in of.tolist()]), dtype=np.uint8).reshape(len(of), -1)
        ids, pair = self.bytes[flat], self.starts[flat[:, :-1], flat[:, 1:]]

        def done(rows: np.ndarray, ids: np.ndarray) -> None:
            whole, size = ids.astype("<u4").tobytes(), 4 * ids.shape[1]
            for k, i in enumerate(rows.tolist()):
                out[i] = whole[k * size : (k + 1) * size]

        while pair.shape[1]:
            at = pair.argmin(axis=1)
            least = pair[np.arange(len(of)), at]
            live = least < NO_RANK
            if not live.all():
                done(of[~live], ids[~live])
                of, ids, pair, at, least = of[live], ids[live], pair[live], at[live], least[live]
            if not len(of):
                return
            one, width = np.arange(len(of)), ids.shape[1]
            ids[one, at] = least
            keep = np.ones(ids.shape, dtype=bool)
            keep[one, at + 1] = False
            ids = ids[keep].reshape(len(of), width - 1)
            # Without the pair that merged; only those beside the new piece get new ranks.
            pair = pair[keep[:, 1:]].reshape(len(of), width - 2)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            pair[before, at[before] - 1] = self.rank(ids[before, at[before] - 1], least[before])
            pair[after, at[after]] = self.rank(least[after], ids[after, at[after] + 1])
        done(of, ids)


def _ready(documents: DataFrame, text: str, pattern: str, merges: Merges, words: int, sample: int) -> pa.Table:
    """Frequent words of a hash sample and their ids: word, ids."""
    rows = documents.select(F.col(text).alias("text"))
    share = min(1.0, sample / max(1, rows.count()))
    draw = F.pmod(F.xxhash64(F.lit("ready"), "text"), F.lit(1 << 30)) / float(1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = _finder(pattern), Counter()

        def often() -> pa.RecordBatch:
            # A word seen once in a piece of text is hardly frequent; leaving it out only costs time.
            kept = {w: n for w, n in seen.items() if n > 1}
            return pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.string()), pa.array(kept.values(), pa.int64())], names=["word", "n"])

        for batch in slices(batches):
            for t in batch.column("text").to_pylist():
                seen.update(find(t or ""))
            if len(seen) >= COUNTED_WORDS:
                yield often()
                seen.clear()
        yield often()

    counted = rows.where(draw < share).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(words).select("word").repartition(48)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(merges.fold(batch.column("word").to_pylist()), pa.binary())], names=["word", "ids"])

    return top.mapInArrow(fold, "word string, ids binary").toArrow()


class _Codes(dict):
    """Word to code; a new word gets the next code."""

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        return code


RESULT = "doc_id long, ids binary, text_bytes binary"


def encode(documents: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text", digests: bool = False, ready_words: int = READY_WORDS, ready_documents: int = READY_DOCUMENTS) -> DataFrame:
    """One row per row of ``documents``: doc_id, ids (little-endian unsigned 32-bit) and their decoded bytes.

    With ``digests``: doc_id, n_tokens, and the SHA-256 of both as hex instead. Every match of
    ``pattern`` is encoded by itself, as ranked byte pairs merge. A task splits a block of texts into
    words; words that are pieces, among the frequent ones, or met before in the task have their ids at
    hand, all other distinct words of the block are folded together; then each text's ids are put together.
    Nothing is shuffled, so no word or text is hot. Null and empty texts give no ids; repeated rows stay; an empty
    table gives an empty result; extra columns are not read. Folding is quadratic in the length of one
    word (one match of the pattern).
    """
    spark, merges = documents.sparkSession, Merges(ranks)
    whole = {t: r for p, r in ranks.items() if (t := p.decode("utf-8", "ignore")).encode() == p}
    ready = pa.table({"word": pa.array(whole.keys(), pa.string()), "ids": pa.array([r.to_bytes(4, "little") for r in whole.values()], pa.binary())})
    # A word that is a piece has that id, whatever its bytes would merge into.
    found = _ready(documents, text, pattern, merges, ready_words, ready_documents).cast(ready.schema)
    ready = pa.concat_tables([ready, found.filter(pc.invert(pc.is_in(found.column("word"), value_set=ready.column("word").combine_chunks())))])
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    # Arrow arrays, so that neither the driver nor a worker holds more objects than it looks up.
    shared = spark.sparkContext.broadcast((*(c.combine_chunks() for c in ready.columns), pa.array(pieces, pa.binary()), merges))
    del ready, found, whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids, pieces, merges = shared.value
        find, known, table, pieces = _finder(pattern), {w: i for i, w in enumerate(words.to_pylist())}, ids.to_pylist(), pieces.to_pylist()
        codes, rows, size, told = _Codes(known), [], 0, len(known)

        def block() -> Iterator[pa.RecordBatch]:
            table.extend(merges.fold(list(islice(codes, told, None))))
            for first in range(0, len(rows), 2000):
                part = rows[first : first + 2000]
                encoded = [b"".join(map(table.__getitem__, c.tolist())) for _, c in part]
                decoded = [b"".join(map(pieces.__getitem__, np.frombuffer(e, dtype="<u4").tolist())) for e in encoded]
                numbers = pa.array([i for i, _ in part], pa.int64())
                if digests:
                    yield pa.RecordBatch.from_arrays(
                        [numbers, pa.array([len(e) // 4 for e in encoded], pa.int64()), *(pa.array([hashlib.sha256(x).hexdigest() for x in xs]) for xs in (encoded, decoded))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                    )
                else:
                    yield pa.RecordBatch.from_arrays([numbers, pa.array(encoded, pa.binary()), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "text_bytes"])

        for batch in slices(batches):
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = find(t or "")
                rows.append((i, np.fromiter(map(codes.__getitem__, found), dtype=np.uint32, count=len(found))))
                size += len(t or "")
                if size >= BLOCK_BYTES or len(codes) - told >= BLOCK_WORDS:
                    yield from block()
                    rows, size, told = [], 0, len(codes)
                    if told - len(known) >= TASK_WORDS:
                        del table[len(known) :]
                        codes, told = _Codes(known), len(known)
        yield from block()

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else RESULT)


def decode(tokens: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """``tokens`` with ``text_bytes``: the binary pieces of its ids (an array) joined by Spark; null ids give null."""
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    table = F.from_json(F.lit(json.dumps([base64.b64encode(p).decode() for p in pieces])), "array<binary>")
    return tokens.withColumn("text_bytes", F.aggregate(ids, F.lit(b""), lambda done, i: F.concat(done, F.get(table, i.cast("int")))))
