"""Quality classifier: averaged embeddings of hashed words and character n-grams, softmax, plain SGD."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Texts
from .text import held_out, slices

#: Labelled rows drawn of each class to fit on (the bound on what reaches the driver).
SAMPLE_PER_CLASS = 1500


@dataclass
class Model:
    """``vectors``: bucket x dimension, ``out``: dimension x 2, ``bias``: 2."""

    vectors: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    bits: int
    grams: tuple[int, ...]

    def bucket_scores(self) -> np.ndarray:
        """What one occurrence of each bucket adds to log-odds of label 1: the output layer is linear in the mean vector."""
        return self.vectors @ (self.out[:, 1] - self.out[:, 0])


def features(texts: list[str | None], bits: int, grams: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """(text index, bucket) of every word and every n-gram that has white space at its ends only."""
    t = Texts(texts, fold=False)
    shift = np.uint64(64 - bits)
    docs, buckets = [t.word_doc], [t.words() >> shift]
    doc = np.repeat(np.arange(t.count, dtype=np.int64), t.end - t.start + 1)
    spaces = np.concatenate(([0], np.cumsum(t.space, dtype=np.int32)))
    for n in grams:
        start = np.arange(max(0, len(t.code) - n + 1))
        start = start[(spaces[start + n - 1] == spaces[start + 1]) & (doc[start] == doc[start + n - 1])]
        docs.append(doc[start])
        buckets.append(t.substrings(start, start + n) >> shift)
    return np.concatenate(docs), np.concatenate(buckets).astype(np.int64), t.count


def fit(texts: list[str | None], labels: np.ndarray, dim: int = 8, bits: int = 17, grams: tuple[int, ...] = (3, 4), epochs: int = 4, rate: float = 0.4, seed: int = 7) -> Model:
    """Stochastic gradient descent on the cross-entropy of single documents in a fixed random order."""
    rng = np.random.default_rng(seed)
    bags = []
    for text in texts:
        _, bucket, _ = features([text], bits, grams)
        ids, counts = np.unique(bucket, return_counts=True)
        bags.append((ids.astype(np.int32), counts.astype(np.float32)))
    vectors = rng.uniform(-1.0 / dim, 1.0 / dim, (1 << bits, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2)), np.zeros(2)
    steps, done = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, counts = bags[i]
            lr = rate * (1.0 - done / steps)
            done += 1
            if not len(ids):
                continue
            share = counts / counts.sum()
            mean = share @ vectors[ids]
            z = mean @ out + bias
            e = np.exp(z - z.max())
            gap = e / e.sum()
            gap[labels[i]] -= 1.0
            back = (out @ gap).astype(np.float32)
            out -= lr * np.outer(mean, gap)
            bias -= lr * 0.1 * gap
            # The mean spreads a gradient over many rows; scaling by the bag's spread keeps steps of long texts alive.
            vectors[ids] -= np.float32(lr / np.sqrt((share * share).sum())) * share[:, None] * back
    return Model(vectors, out, bias, bits, grams)


def train(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = SAMPLE_PER_CLASS, **options) -> Model:
    """Fit on at most ``per_class`` labelled rows of each class, chosen by a hash of the id.

    Held-out rows (crc32 of the id as text, mod 3, is 1) and null labels never enter. A missing class
    or an empty table leaves the vectors as drawn and the scores near 0.5.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).where(F.col("label").isin(0, 1)).dropDuplicates(["doc_id"])
    order = F.xxhash64(F.lit("fit"), "doc_id")
    chosen = None
    for value in (0, 1):
        part = marks.where(F.col("label") == value).orderBy(order, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = sorted((r["doc_id"], r["label"], r["text"] or "") for r in rows.join(chosen, "doc_id").collect())
    return fit([r[2] for r in sample], np.array([r[1] for r in sample], dtype=int), **options)


RESULT = "doc_id long, held_out boolean, score double, predicted int"


def score(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``documents``: doc_id, held_out, score (probability of label 1), predicted.

    The score reads the whole text and nothing else; null and empty texts have no features and get
    the score of the bias. Repeated rows stay, an empty table gives an empty result, extra columns
    are not read, null ids pass through. Each batch is summed with one weight per bucket: the model's
    output is linear in the averaged vectors.
    """
    weight = model.bucket_scores().astype(np.float64)
    shared = documents.sparkSession.sparkContext.broadcast((weight, float(model.bias[1] - model.bias[0]), model.bits, model.grams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias, bits, grams = shared.value
        for batch in slices(batches, max_bytes=1 << 20):
            doc, bucket, n = features(batch.column("text").to_pylist(), bits, grams)
            total = np.bincount(doc, weights=weight[bucket], minlength=n)
            z = total / np.maximum(np.bincount(doc, minlength=n), 1) + bias
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, RESULT)


def keep_good(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", at_least: float = 0.5) -> DataFrame:
    """The rows of ``documents`` whose text scores ``at_least``; all columns, in one pass without a join."""
    weight = model.bucket_scores().astype(np.float64)
    shared = documents.sparkSession.sparkContext.broadcast((weight, float(model.bias[1] - model.bias[0]), model.bits, model.grams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias, bits, grams = shared.value
        for batch in slices(batches, text, max_bytes=1 << 20):
            doc, bucket, n = features(batch.column(text).to_pylist(), bits, grams)
            total = np.bincount(doc, weights=weight[bucket], minlength=n)
            z = total / np.maximum(np.bincount(doc, minlength=n), 1) + bias
            yield batch.filter(pa.array(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))) >= at_least))

    return documents.mapInArrow(run, documents.schema)
