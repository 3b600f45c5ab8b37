"""Grouping of spelling variants: words one letter apart, found in FM-indexes of the vocabulary dealt by word halves."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .fm_index import Index
from .text import slices

# A run of letters A-Z, a-z and U+00C0 to U+00FF (in UTF-8: C3 and a byte from 80 to BF).
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")

#: Words a task counts before it hands them on, rows of one index, rows of one half-word above which it is split again.
HELD, SLOT_ROWS, HOT_ROWS = 1 << 20, 40_000, 20_000


def vocabulary(documents: DataFrame, min_length: int = 7, min_count: int = 2, drop_every: int | None = 31, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of at least ``min_length`` code points found ``min_count`` times.

    With ``drop_every``, a run loses one code point in the documents where the crc32 h of ``doc_id:run`` is a
    multiple of it: the one at h modulo its length.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
        for batch in slices(batches):
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                begun = zlib.crc32(b"%s:" % (i or "").encode())
                for run, n in Counter(RUN.findall((t or b"").lower())).items():
                    if len(run) < min_length:
                        continue
                    if drop_every and (h := zlib.crc32(run, begun)) % drop_every == 0:
                        letters = run.decode()
                        at = h % len(letters)
                        run = (letters[:at] + letters[at + 1 :]).encode()
                    if len(run) - run.count(b"\xc3") >= min_length:
                        seen[run] += n
            if len(seen) > HELD:
                yield flush()
                seen.clear()
        yield flush()

    rows = documents.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    counted = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return written(counted.where(F.col("n") >= min_count), "vocabulary")


def _dealt(words: DataFrame, path: str) -> DataFrame:
    """``words`` (word, n, l) with a key of what a pair at query length ``l`` shares along ``path``.

    Each step halves the part that holds the one error: ``p`` takes its first half as equal, ``s`` its last.
    """
    first, last, rest, add, by = "0", "0", "l", 0, 1
    for step in path:
        # What is left after k halvings is (l + add) div 2^k; the lesser half is the first.
        if step == "p":
            first, add = f"{first} + (l + {add}) div {2 * by}", add + by
        else:
            last = f"{last} + (l + {add + by}) div {2 * by}"
        by *= 2
        rest = f"(l + {add}) div {by}"
    key = F.xxhash64(F.expr(first), F.expr(last), F.expr(f"substring(word, 1, cast({first} as int))"), F.expr(f"right(word, cast({last} as int))"))
    return words.select("word", "n", "l", key.alias("key"), F.expr(f"{rest} > 1").alias("splits"))


def _search(from_start: bool):
    def search(group: pd.DataFrame) -> pd.DataFrame:
        counts = group.drop_duplicates("word").set_index("word")["n"]
        index = Index(counts.index.tolist())
        n = counts.loc[index.words].to_numpy(dtype=np.int64)
        asks = set(group["word"][group["asks"]])
        asked = np.array([i for i, w in enumerate(index.words) if w in asks], dtype=np.int64)
        a, b = index.near(asked, from_start)
        a, b = np.concatenate((a, b)), np.concatenate((b, a))
        words = np.array(index.words, dtype=object)
        return pd.DataFrame({"word": words[a], "near": words[b], "near_n": n[b]})

    return search


def near_pairs(words: DataFrame, slot_rows: int = SLOT_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(word, near, near_n): all pairs of words that differ by one inserted, deleted or replaced code point, both ways.

    The shorter word (either, if equal) asks. One of its halves stands unchanged in the other, so words are
    dealt by a hash of that half, for their own length and as the longer of a pair. Every slot of half-words
    becomes one bidirectional FM-index; its asking words are matched exactly in the half and with one error
    in the rest. A half-word held by more than ``hot_rows`` rows is dealt again by halves of its other part,
    until only one code point is left to differ.
    """
    lengths = words.select("word", "n", F.explode(F.expr("array(length(word), length(word) - 1)")).alias("l")).where(F.col("l") > 0)
    found: list[DataFrame] = []
    todo = [("p", lengths), ("s", lengths)]
    while todo:
        path, rows = todo.pop()
        rows = _dealt(rows, path)
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.bool_or("splits").alias("splits"))
        hot = written(sizes.where((F.col("held") > hot_rows) & F.col("splits")).select("key"), "hot-halves")
        if not hot.isEmpty():
            again = written(rows.join(hot, "key", "left_semi").select("word", "n", "l"), "hot-words")
            rows = rows.join(hot, "key", "left_anti")
            todo += [(path + "p", again), (path + "s", again)]
        slots = max(1, -(-rows.count() // slot_rows))
        placed = rows.select("word", "n", (F.col("l") == F.length("word")).alias("asks"), F.expr(f"pmod(key, {slots})").alias("slot"))
        # The first step of a path says which half of the word is equal; later ones only part hot halves.
        found.append(placed.repartition(slots, "slot").groupBy("slot").applyInPandas(_search(path[0] == "p"), "word string, near string, near_n long"))
    for more in found[1:]:
        found[0] = found[0].unionAll(more)
    return found[0].distinct()


def group_variants(documents: DataFrame, ratio: int = 10, min_length: int = 7, min_count: int = 2, drop_every: int | None = 31, doc_id: str = "doc_id", text: str = "text", slot_rows: int = SLOT_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts' vocabulary.

    ``form`` is the most frequent word one edit away (ties: first in code-point order) if it is at least
    ``ratio`` times as frequent; ``root`` is where following forms ends, the word itself if it has none.
    Counts rise along forms, so chains are short and end.

    Null and empty texts have no words, a null doc_id counts as empty text; very long texts and runs are
    read whole, repeated rows count again; an empty table gives an empty result; extra columns are not read.
    """
    words = vocabulary(documents, min_length, min_count, drop_every, doc_id, text)
    best = near_pairs(words, slot_rows, hot_rows).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("w"))).alias("best"))
    joined = words.join(best, "word", "left")
    strong = -F.col("best.k") >= ratio * F.col("n")
    formed = written(joined.select("word", F.when(strong, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, -F.col("best.k")).alias("form_n")), "forms")
    roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        jump = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(roots.join(jump, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = after.select("word", "root")
        if after.where("moved").isEmpty():
            break
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
