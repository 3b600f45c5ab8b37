"""Language identification by unigram pieces summed over all segmentations."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import held_out, slices

#: A maximal run of letters; digits, marks and white space carry no language here.
LETTERS = re.compile(r"[^\W\d_]+")
#: Longer runs of letters are scored in parts of this many, so that one endless word costs linear time.
PART = 48
#: Training documents drawn of each language (in expectation).
SAMPLE_PER_LANGUAGE = 300
#: Words a task remembers the scores of before it starts afresh.
CACHE_WORDS = 200_000


def load_pieces(path: str, most: int = 8) -> list[str]:
    """Pieces of letters, with or without the word-start mark, of a sentencepiece model, lower case and short enough."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in found if len(p) <= most and (rest := p.removeprefix("▁")) and rest.isalpha())


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, each with the word-start mark, cut into parts of ``PART``."""
    # The class also matches numerals such as fractions; a word needs a letter.
    words = ["▁" + w for w in LETTERS.findall((text or "").lower()) if w.isalpha() or any(map(str.isalpha, w))]
    if any(len(w) > PART for w in words):
        words = [w[i : i + PART] for w in words for i in range(0, len(w), PART)]
    return words


@dataclass
class Model:
    languages: list[str]
    table: dict[str, tuple[float, ...]]
    unknown: tuple[float, ...]
    most: int


class Scorer:
    """Log-probabilities of words under each language: sums over all their segmentations into pieces.

    A single character that is no piece is a piece of probability ``unknown``. Words have at most
    ``PART`` characters, so the products stay within doubles.
    """

    def __init__(self, model: Model):
        self.most = model.most
        self.index = {piece: i for i, piece in enumerate(model.table)}
        self.zero = len(self.index)
        rows = [*model.table.values(), (0.0,) * len(model.languages), model.unknown]
        self.p = np.array(rows, dtype=float).reshape(len(rows), len(model.languages))

    def spans(self, length: int) -> list[tuple[int, int]]:
        return [(start, end) for end in range(1, length + 1) for start in range(max(0, end - self.most), end)]

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """One row per word. The forward algorithm runs over all words of one length at a time."""
        out = np.zeros((len(words), self.p.shape[1]))
        groups: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            groups.setdefault(len(word), []).append(i)
        find = self.index.get
        for length, members in groups.items():
            spans = self.spans(length)
            missing = [self.zero + (end - start == 1) for start, end in spans]
            looked = [(start, end, m) for (start, end), m in zip(spans, missing)]
            for first in range(0, len(members), 20_000):
                part = members[first : first + 20_000]
                ids = np.array([[find(w[s:e], m) for s, e, m in looked] for w in (words[i] for i in part)])
                alpha = [np.ones((len(part), self.p.shape[1]))] + [np.zeros((len(part), self.p.shape[1])) for _ in range(length)]
                for k, (start, end) in enumerate(spans):
                    alpha[end] += alpha[start] * self.p[ids[:, k]]
                out[part] = np.log(np.maximum(alpha[length], 1e-300))
        return out


def expected_counts(words: Counter, table: dict[str, float], unknown: float, most: int) -> Counter:
    """Expected piece counts of weighted words over all segmentations (forward-backward)."""
    out: Counter = Counter()
    for word, weight in words.items():
        n = len(word)
        alpha, beta, arcs = [1.0] + [0.0] * n, [0.0] * n + [1.0], []
        for end in range(1, n + 1):
            for start in range(max(0, end - most), end):
                p = table.get(word[start:end], unknown if start == end - 1 else None)
                if p is not None:
                    arcs.append((start, end, p))
                    alpha[end] += alpha[start] * p
        for start, end, p in reversed(arcs):
            beta[start] += p * beta[end]
        scale = weight / alpha[n]
        for start, end, p in arcs:
            piece = word[start:end]
            if piece in table:
                out[piece] += alpha[start] * p * beta[end] * scale
    return out


def train(documents: DataFrame, pieces: list[str], doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, rounds: int = 2, smooth: float = 0.05) -> Model:
    """Piece probabilities of every language by expectation maximisation over segmentations.

    Fits on a hash sample of about ``per_language`` documents of each language (all, if fewer) among
    rows that are not held out and whose lang is not null; languages are fitted in parallel tasks.
    The model is bounded by pieces x languages. Without such rows the model knows no language.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model([], {}, (), 1)
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    draw = F.pmod(F.xxhash64(F.lit("fit"), "doc_id", F.xxhash64("text")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < share[F.col("lang")]).select("lang", "text")
    most, start = max(map(len, pieces), default=1), {p: 1.0 / len(pieces) for p in pieces}

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        words = Counter(w for t in group["text"] for w in words_of(t))
        table, unknown = start, 0.01 / len(start)
        for _ in range(rounds):
            got = expected_counts(words, table, unknown, most)
            total = sum(got.values()) + smooth * len(start)
            table, unknown = {p: (got[p] + smooth) / total for p in start}, 0.1 * smooth / total
        return pd.DataFrame({"lang": group["lang"].iloc[0], "piece": [*table, ""], "p": [*table.values(), unknown]})

    languages, fitted = sorted(counts), {}
    for r in sample.groupBy("lang").applyInPandas(fit, "lang string, piece string, p double").collect():
        fitted.setdefault(r["lang"], {})[r["piece"]] = r["p"]
    languages = [x for x in languages if x in fitted]
    table = {p: tuple(fitted[x][p] for x in languages) for p in pieces}
    return Model(languages, table, tuple(fitted[x][""] for x in languages), most)


RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``documents``: doc_id, held_out, lang_pred, score (its posterior, equal priors).

    The log-likelihood of a text is the sum over its words, each summed over all segmentations. Null
    texts and texts without a letter, or a model without languages, give ``und`` with score 0. Equal
    scores go to the language first in code point order. Whole texts are read, of any length;
    repeated rows stay, an empty table gives an empty result, extra columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, scorer = shared.value, Scorer(shared.value)
        place: dict[str, int] = {}
        logs = np.empty((0, len(model.languages)))
        for batch in slices(batches, max_bytes=1 << 20):
            texts = [words_of(t) if model.languages else [] for t in batch.column("text").to_pylist()]
            if len(place) >= CACHE_WORDS:
                place, logs = {}, logs[:0]
            new = list({w for words in texts for w in words if w not in place})
            place.update(zip(new, range(len(place), len(place) + len(new))))
            logs = np.concatenate((logs, scorer.log_probabilities(new)))
            at = np.fromiter((place[w] for words in texts for w in words), dtype=np.int64)
            doc = np.repeat(np.arange(len(texts)), [len(words) for words in texts])
            total = np.array([np.bincount(doc, weights=logs[at, k], minlength=len(texts)) for k in range(len(model.languages))]).T
            guesses, scores = [], []
            for words, sums in zip(texts, total if len(total) else [None] * len(texts)):
                if not words:
                    guesses.append("und")
                    scores.append(0.0)
                    continue
                best = int(np.argmax(sums))
                guesses.append(model.languages[best])
                scores.append(1.0 / np.exp(sums - sums[best]).sum())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(guesses, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, RESULT)
