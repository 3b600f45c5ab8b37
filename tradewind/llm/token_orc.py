"""Token ids of a corpus as ORC files in id order: range-dealt texts, run-length ids, bloom filters on the id."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from .text import slices

#: Pieces of text whose ids a worker keeps; when full they start anew, which costs time only.
CACHE = 1_000_000
#: Bytes of text cut and looked up at once.
SLICE = 8 << 20
#: A control character that stands between words given to the library together. Words that hold it are given alone.
BREAK = "\x01"
# How the tokenizer's pattern parts lower-case text of ASCII and the letters U+00C0 to U+00FF, byte by byte.
SPACE, OTHER, DIGIT, LETTER = range(4)
LOWER = bytes(b + 32 if 65 <= b <= 90 or 0x80 <= b <= 0x9E else b for b in range(256))
KIND = bytes(SPACE if b in b" \t\n\v\f\r" else DIGIT if 48 <= b <= 57 else LETTER if 97 <= b <= 122 or b > 127 else OTHER for b in LOWER)
QUOTE, ONE, TWO = ord("'"), np.frombuffer(b"stmd", dtype=np.uint8), [b"re", b"ve", b"ll"]

COLUMNS = "doc_id long, part int, before long, n_tokens int, ids array<int>"


def _odd(text: np.ndarray) -> np.ndarray:
    """True for the bytes of characters other than ASCII and the letters U+00C0 to U+00FF."""
    tail = (text[:-1] == 0xC3) & (text[1:] >= 0x80) & (text[1:] <= 0xBF) & (text[1:] != 0x97) & (text[1:] != 0xB7)
    odd = text >= 0x80
    odd[1:] &= ~tail
    odd[:-1] &= ~tail
    return odd


def _whole_words(text: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the words that are not plain, and a mask of all their bytes."""
    blanks = np.flatnonzero(kind == SPACE)
    stop = np.unique(np.searchsorted(blanks, np.flatnonzero(_odd(text))))
    start = np.where(stop > 0, blanks[stop - 1] + 1, 0)
    edges = np.zeros(len(text), dtype=np.int8)
    edges[start] += 1
    edges[blanks[stop]] -= 1
    return start, np.cumsum(edges, dtype=np.int8).view(bool)


def cut(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """The pieces of a text that ends in white space, and the byte each begins at.

    Plain words are parted as the tokenizer parts them: runs of letters, single digits, the endings 's 't 're 've 'm
    'll 'd where no other sign stands before the quote, runs of other signs; in lower case. Other words go whole.
    """
    low = np.frombuffer(text.translate(LOWER), dtype=np.uint8)
    kind = np.frombuffer(text.translate(KIND), dtype=np.uint8)
    begins = kind == DIGIT
    begins[0] = True
    begins[1:] |= kind[1:] != kind[:-1]
    quotes = np.flatnonzero((low == QUOTE) & begins)
    first, second = low[quotes + 1], low.take(quotes + 2, mode="clip")
    one = quotes[np.isin(first, ONE)]
    two = quotes[np.any([(first == a) & (second == b) for a, b in TWO], axis=0)]
    begins[one + 1] = begins[two + 1] = False
    begins[one + 2] = begins[two + 3] = True
    if not text.isascii():
        raw = np.frombuffer(text, dtype=np.uint8)
        start, inside = _whole_words(raw, kind)
        low = np.where(inside, raw, low)
        begins &= ~inside
        begins[start] = True
    solid = kind != SPACE
    begins &= solid
    ends = np.append(np.flatnonzero(begins[solid]), np.count_nonzero(solid)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(low[solid])]), np.flatnonzero(begins)


class PieceIds(dict):
    """Pieces of text to their ids as little-endian 32-bit integers.

    The tokenizer normalises character by character, drops white space and never joins what white space
    parts, so a text's ids are those of its words in order. Plain words, of ASCII and the letters U+00C0 to
    U+00FF, no character of which combines with its neighbours, are parted further, as the tokenizer parts
    them; each part ends with the one id that ends a word. Ids always come from the library, many pieces a
    call; plain pieces, in lower case and parted already, skip its normaliser and pattern. ``check`` confirms
    these properties for a tokenizer, and every call the number of pieces.
    """

    def __init__(self, model: str):
        super().__init__()
        self.library = Tokenizer.from_str(model)
        self.library.encode_special_tokens = True
        self.bare = Tokenizer(self.library.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.library.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closing[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.mark = self._ids(BREAK)

    def _ids(self, text: str, library: Tokenizer | None = None) -> list[int]:
        return (library or self.library).encode_batch_fast([text], add_special_tokens=False)[0].ids

    @staticmethod
    def split(text: bytes) -> list[str]:
        """The pieces of a text in order: parts of plain words, other words whole."""
        return [p.decode() for p in cut(text + b"\n")[0].to_pylist()]

    def check(self) -> None:
        """Raises if this tokenizer joins what white space parts, parts words otherwise, or has no single id for the break."""
        parted = ["don't", "\u0301a", "a\u00a0b", "12", "!?", "\u1100", "\u1161", "It's", "\x1c", "e", "\u0327"]
        for space in " \t\n\v\f\r":
            if self._ids(space.join(parted)) != [i for w in parted for i in self._ids(w)]:
                raise ValueError("this tokenizer does not treat words apart; encode whole texts instead")
        tried = "don't 'stuff I'LL'd x1y22 a--b 'RE'x \x1ca\x7f $5,00 _a_ ''s the_end. \u00c0\u00ff\u00df'M,\u00e9"
        if len(self.mark) != 1 or self._ids(tried) != self.of(cut(tried.encode() + b"\n")[0])[0].tolist():
            raise ValueError("this tokenizer parts words in another way; encode whole texts instead")

    def of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces in order and how many each has, in two calls of the library and one for each piece that holds the break."""
        if not len(pieces):
            return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)
        odd = _odd(np.frombuffer(b"".join(pieces.to_pylist()), dtype=np.uint8))
        lengths = pc.binary_length(pieces).to_numpy()
        whole = np.logical_or.reduceat(odd, np.cumsum(lengths) - lengths)
        plain = pieces.filter(pa.array(~whole))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain), b" ")[0].as_py()
        flat = np.array(self._ids(joined.decode(), self.bare), dtype=np.int32)
        last = np.flatnonzero(self.closing[flat])
        if len(last) != len(pieces) - np.count_nonzero(whole):
            raise ValueError("the tokenizer parted words in another way")
        sizes = np.zeros(len(pieces), dtype=np.int64)
        sizes[~whole] = np.diff(last, prepend=-1)
        if not whole.any():
            return flat, sizes
        lists = self._whole([p.decode() for p in pieces.filter(pa.array(whole)).to_pylist()])
        sizes[whole] = list(map(len, lists))
        ids, theirs = np.empty(int(sizes.sum()), dtype=np.int32), np.repeat(whole, sizes)
        ids[~theirs], ids[theirs] = flat, np.concatenate(lists)
        return ids, sizes

    def _whole(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word, from whole words given together where none holds the break."""
        together = [w for w in words if BREAK not in w]
        flat = np.array(self._ids("".join(f"{w} {BREAK} " for w in together)), dtype=np.int32)
        parts = np.split(flat, np.flatnonzero(flat == self.mark[0]) + 1)[:-1]
        if len(parts) != len(together):
            raise ValueError("the tokenizer parted words in another way")
        given = iter(parts)
        return [np.array(self._ids(w), dtype=np.int32) if BREAK in w else next(given)[:-1] for w in words]

    def learn(self, pieces: set[str]) -> None:
        """Adds the pieces not known yet."""
        new = list(pieces.difference(self))
        ids, sizes = self.of(pa.array([p.encode() for p in new], pa.binary()))
        self.update(zip(new, (x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1]))))


class TextIds:
    """Ids of texts put together from numbered pieces: the distinct pieces of a call are looked up, all ids are copied by number.

    Number 0 stands for the end of a text. Pieces and their ids stay until there are more than ``CACHE``.
    """

    def __init__(self, model: str, end_id: int):
        self.pieces, self.end = PieceIds(model), end_id
        self._anew()

    def _anew(self) -> None:
        self.known = pa.array([b"\n"], pa.binary())
        self.ids, self.sizes = np.array([self.end], dtype=np.int32), np.array([1], dtype=np.int64)
        self.starts = np.array([0], dtype=np.int64)

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """The number of each of these distinct pieces; new ones are learned and get the next ones."""
        found = pc.index_in(pieces, value_set=self.known)
        unknown = found.is_null()
        new = pieces.filter(unknown)
        numbers = found.fill_null(0).to_numpy().astype(np.int64)
        if len(new):
            ids, sizes = self.pieces.of(new)
            numbers[unknown.to_numpy(zero_copy_only=False)] = np.arange(len(self.known), len(self.known) + len(new))
            self.known = pa.concat_arrays([self.known, new])
            self.ids, self.sizes = np.concatenate((self.ids, ids)), np.concatenate((self.sizes, sizes))
            self.starts = np.cumsum(self.sizes) - self.sizes
        return numbers

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, each with the end id, and how many each text has."""
        if not texts:
            return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)
        if len(self.known) > CACHE:
            self._anew()
        texts = [t or b"" for t in texts]
        pieces, begins = cut(b"\n".join(texts) + b"\n")
        before = np.searchsorted(begins, np.cumsum([len(t) + 1 for t in texts]))
        coded = pieces.dictionary_encode()
        codes = np.insert(self._numbers(coded.dictionary)[coded.indices.to_numpy()], before, 0)
        sizes = self.sizes[codes]
        to = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[codes] - to + sizes, sizes) + np.arange(to[-1])]
        first = np.concatenate(([0], before[:-1] + np.arange(1, len(before))))
        return ids, np.add.reduceat(sizes, first)


#: The pieces a Python worker has learned, by tokenizer and end id, for its next task.
_LEARNED: dict[tuple[str, int], TextIds] = {}


def write(documents: DataFrame, folder: str, model_path: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", stripe_mb: int = 16, index_rows: int = 1000) -> None:
    """Write the ids of every whole text to ORC files under ``folder``, in ascending order of ``doc_id``.

    Texts are dealt to files by ranges of (doc_id, place in the input), so a third of all rows under one
    id still spreads over many files, and encoded after that shuffle, once. File and row order together
    are the order of ids; ``part`` numbers the files, ``before`` counts the ids before a row in its file.
    Integers are run-length encoded by the format; each file has row indexes every ``index_rows`` rows and
    bloom filters on doc_id, and stripes of about ``stripe_mb`` that readers take in parallel.

    Null or empty text gives the end id alone. Null ids come first, rows of equal id in input order; repeated
    rows all stay. An empty table writes no rows. Very long texts pass whole (one text is in memory at a time
    beside its batch). Extra columns, whatever their names, are not read. ``folder`` must be new.
    """
    model, rows = Path(model_path).read_text(encoding="utf-8"), documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    PieceIds(model).check()
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        slot = (shared.value, end_id)
        if slot not in _LEARNED:
            _LEARNED.clear()
            _LEARNED[slot] = TextIds(*slot)
        known = _LEARNED[slot]
        for batch in slices(batches, max_bytes=SLICE):
            ids, counts = known.encode(batch.column("text").to_pylist())
            ends = np.concatenate(([0], np.cumsum(counts)))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(counts), part, dtype=np.int32)), pa.array(before + ends[:-1]), pa.array(counts.astype(np.int32)), lists],
                names=["doc_id", "part", "before", "n_tokens", "ids"],
            )
            before += int(ends[-1])

    placed = rows.withColumn("_row", F.monotonically_increasing_id())
    dealt = placed.repartitionByRange("doc_id", "_row").sortWithinPartitions("doc_id", "_row")
    settings = {
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
        "orc.row.index.stride": str(index_rows), "orc.stripe.size": str(stripe_mb << 20), "compression": "zstd",
    }
    dealt.drop("_row").mapInArrow(encode, COLUMNS).write.mode("errorifexists").options(**settings).orc(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the files, with ``start``: the ids of all documents before each one.

    A filter on doc_id reaches the files' indexes and bloom filters. Starts add one number a file to the
    stored place within the file; that table is read from the narrow columns alone.
    """
    rows = spark.read.schema(COLUMNS).orc(folder)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("_in"))
    # One row a file: the running sum over the files is small however many documents there are.
    earlier = F.sum("_in").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(earlier, F.lit(0)).alias("_base"))
    return rows.join(bases, "part").select("doc_id", (F.col("_base") + F.col("before")).alias("start"), "ids")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian 32-bit integers) of each row of ``read``."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(counts)
            crc = [zlib.crc32(flat[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(sums, "doc_id long, start long, n_tokens long, ids_crc32 long")
