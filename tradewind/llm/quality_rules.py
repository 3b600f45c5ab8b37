"""Quality rules: counted defects, and divergence from histograms of the document's language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Texts, hash_text, windows
from .text import slices

# Common words of four languages; all other words share one further cell.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be on not he by are this at from or have an they which had".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha".split(),
}
VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words})

# The symbol characters of the contract.
SYMBOLS = "#*$%&|<>"

#: Lower case, upper case, digit, blank, line end, mark between words, symbol, other letter, anything else.
CLASSES = 9
POOLED = ""  # the key of the reference over all languages

RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"


def _class_table() -> np.ndarray:
    table = np.full(0x10000, 8, dtype=np.int8)
    for c in range(0x10000):
        x = chr(c)
        table[c] = 2 if "0" <= x <= "9" else 4 if x in "\n\r" else 3 if x.isspace() else 6 if x in SYMBOLS else 5 if x in ".,;:!?'\"()-" else 1 if x.isupper() else 0 if x.islower() else 7 if x.isalpha() else 8
    return table


def _histograms(t: Texts, table: np.ndarray, vocabulary: np.ndarray, order: np.ndarray, lower: Texts) -> np.ndarray:
    """Per text: counts of the character classes, then of the common words and of all other words."""
    kind = table[np.minimum(t.code, 0xFFFF)].astype(np.int64)
    kind[t.code > 0xFFFF] = 8
    doc = np.repeat(np.arange(t.count), t.end - t.start + 1)
    inside = np.ones(len(kind), dtype=bool)
    inside[t.end] = False
    classes = np.bincount(doc[inside] * CLASSES + kind[inside], minlength=t.count * CLASSES).reshape(t.count, CLASSES)
    end = lower.word_end - ((kind[lower.word_end - 1] == 5) & (lower.word_end - lower.word_start > 1))
    found = np.minimum(np.searchsorted(vocabulary, h := lower.substrings(lower.word_start, end)), len(vocabulary) - 1)
    cell = np.where(vocabulary[found] == h, order[found], len(vocabulary))
    width = len(vocabulary) + 1
    words = np.bincount(lower.word_doc * width + cell, minlength=t.count * width).reshape(t.count, width)
    return np.hstack([classes, words])


def _vocabulary() -> tuple[np.ndarray, np.ndarray]:
    hashes = np.array([hash_text(w) for w in VOCABULARY], dtype=np.uint64)
    order = np.argsort(hashes)
    return hashes[order], order


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of counts ``p`` to the same row of ``q``; 0 for empty rows."""
    p, q = p / np.maximum(p.sum(axis=1, keepdims=True), 1), q / np.maximum(q.sum(axis=1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda x: np.where(x > 0, x * np.log2(x / m), 0.0).sum(axis=1)
        d = np.sqrt(np.clip((part(p) + part(q)) / 2, 0.0, 1.0))
    return np.where((p.sum(axis=1) > 0) & (q.sum(axis=1) > 0), d, 0.0)


def chance_limits(counts: np.ndarray, limit: float, share: float, draws: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Sizes, and per size the limit of the distance of a text of that many items to the histogram ``counts``.

    It is the distance that a share of ``share`` of texts drawn at random from the histogram itself stays
    under (estimated from seeded draws), and at least ``limit``; larger texts than listed have ``limit``.
    """
    sizes, limits = [], []
    if counts.sum():
        p = counts / counts.sum()
        for n in sorted({round(2 ** (k / 2)) for k in range(28)}):
            x = np.random.default_rng(n).multinomial(n, p, size=draws)
            sizes.append(n)
            limits.append(max(limit, float(np.quantile(js_distance(x, np.broadcast_to(counts, x.shape)), share))))
            if limits[-1] == limit:
                break
    return np.array(sizes or [1], dtype=np.int64), np.array(limits or [limit])


def references(documents: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Summed histograms of every language over all documents, and of all together under ``POOLED``.

    Null languages count only in the pooled one. One row per language reaches the driver.
    """
    width = CLASSES + len(VOCABULARY) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (vocabulary, order), sums = _class_table(), _vocabulary(), {}
        for batch in slices(batches, max_bytes=1 << 20):
            texts = batch.column("text").to_pylist()
            h = _histograms(Texts(texts), table, vocabulary, order, Texts(texts, fold=True))
            langs = np.array([x or POOLED for x in batch.column("lang").to_pylist()], dtype=object)
            for x in set(langs.tolist()):
                sums[x] = sums.get(x, 0) + h[langs == x].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "counts"])

    counted = documents.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(count, "lang string, counts array<long>")
    summed = counted.groupBy("lang").agg(*[F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(width)])
    out = {r["lang"]: np.array(r[1:], dtype=np.int64) for r in summed.collect()}
    return out | {POOLED: sum(out.values(), np.zeros(width, dtype=np.int64))}


def rate(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_class: float = 0.3, max_word: float = 0.33, chance: float = 0.99) -> DataFrame:
    """One row per row of ``documents`` with counted defects, distances and ``kept``.

    ``base_failed``: under 20 words, or over 30 % of the words in repeated 8-word windows. Else the
    method decides: the text goes when its character classes lie further than ``max_class``, or its
    common words further than ``max_word``, from its language's histogram (Jensen-Shannon distance).
    Short texts stray by chance: where ``chance`` of the texts drawn from the histogram with as many
    characters, respectively words, only stay under a larger distance, that one is the limit. A null or
    unseen language uses the histogram of all documents. Null texts have no words. Repeated rows stay; an empty table gives an empty result; extra columns are not read.
    """
    reference = references(documents, text, lang)
    limits = {x: (chance_limits(c[:CLASSES], max_class, chance), chance_limits(c[CLASSES:], max_word, chance)) for x, c in reference.items()}
    shared = documents.sparkSession.sparkContext.broadcast((reference, limits))
    symbols = np.array(sorted(map(ord, SYMBOLS)), dtype=np.uint32)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (vocabulary, order), (known, limits) = _class_table(), _vocabulary(), shared.value
        for batch in slices(batches, max_bytes=1 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            t, low = Texts(texts), Texts(texts, fold=True)
            n_words = t.words_per_text()
            lines = [[x for x in s.split("\n") if x.strip(" \t\n\v\f\r")] for s in texts]
            first, window = windows(t.words(), t.word_doc, 8)
            doc = t.word_doc[first]
            by = np.lexsort((window, doc))
            same = (window[by][1:] == window[by][:-1]) & (doc[by][1:] == doc[by][:-1])
            twice = np.zeros(len(first), dtype=bool)
            twice[by[1:][same]] = twice[by[:-1][same]] = True
            cover = np.zeros(len(t.word_doc) + 1, dtype=np.int64)
            np.add.at(cover, first[twice], 1)
            np.add.at(cover, first[twice] + 8, -1)
            repeated = np.bincount(t.word_doc[np.cumsum(cover)[:-1] > 0], minlength=t.count)
            h = _histograms(t, table, vocabulary, order, low)
            langs = np.array([x if x and x in known else POOLED for x in batch.column("lang").to_pylist()], dtype=object)
            ref = np.array([known[x] for x in langs])
            by_class, by_word = js_distance(h[:, :CLASSES], ref[:, :CLASSES]), js_distance(h[:, CLASSES:], ref[:, CLASSES:])
            near = np.ones(t.count, dtype=bool)
            for x in set(langs.tolist()):
                at = langs == x
                for d, n, (sizes, most) in zip((by_class, by_word), (t.end - t.start, n_words), limits[x]):
                    near[at] &= d[at] <= np.interp(n[at], sizes, most)
            failed = (n_words < 20) | (100 * repeated > 30 * n_words)
            columns = [
                n_words, t.per_text(~t.space), t.per_text(np.isin(t.code, symbols)), np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64), repeated,
                failed, by_class, by_word, ~failed & near,
            ]
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], names=["doc_id", *names])

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return rows.mapInArrow(judge, RESULT)
