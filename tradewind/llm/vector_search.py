"""Exact top-k inner products: term-at-a-time accumulation into dense score arrays, then a merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query rows of one pass: what is broadcast at a time. Candidates scored against them at a time.
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 4096
#: Scaled components stay below this, so that sums of products stay exact in 64 bits.
LARGEST = 1 << 26


def scaled(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(vec_id, terms): components as floor(scale * x); rows null or with null or non-finite components go."""
    x = F.col("x")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    terms = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))))
    return vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("x")).where(x.isNotNull() & ~bad).select("vec_id", terms.alias("terms"))


def matrix(column: pa.Array) -> np.ndarray:
    """Ragged lists of integers as rows of one matrix; missing last components are 0."""
    lengths = np.array([len(v) for v in column], dtype=np.int64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), dtype=np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) and max(int(flat.max()), -int(flat.min())) >= LARGEST:
        raise ValueError(f"a scaled component is not below {LARGEST}")
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of all queries: each term's weights of the queries that have it times that term's postings."""
    scores = np.zeros((len(queries), len(candidates)), dtype=np.int64)
    for term in range(min(queries.shape[1], candidates.shape[1])):
        having = np.flatnonzero(queries[:, term])
        postings = np.flatnonzero(candidates[:, term])
        if len(having) and len(postings):
            weights, values = queries[having, term], candidates[postings, term]
            if len(having) == len(queries) and len(postings) == len(candidates):
                scores += weights[:, None] * values
            else:
                scores[np.ix_(having, postings)] += weights[:, None] * values
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= floor)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """The k highest integer inner products of every query: query_id, rank, vec_id, score.

    Candidates are all rows of ``vectors`` with another id than the query; ties go to the smaller id,
    and a query with fewer candidates returns them all. Components are floor(scale * x). Vectors that
    are null or hold null or non-finite components take no part, nor do null ids; a component whose
    scaled size reaches ``LARGEST`` raises an error. Missing last components of shorter vectors count
    as 0. A repeated candidate row is a candidate each time; a repeated query id is answered once, by
    its least vector. Empty tables give an empty result; extra columns are not read.

    Queries go in passes of about ``QUERY_BLOCK`` rows, dealt by a hash of the id, so one broadcast
    has a fixed size; candidates never move, and only k rows per query and task are merged.
    """
    spark = vectors.sparkSession
    asked = scaled(queries, vec_id, embedding, scale).where("vec_id is not null").groupBy("vec_id").agg(F.min("terms").alias("terms"))
    rows = scaled(vectors, vec_id, embedding, scale).where("vec_id is not null").withColumn("vec_id", F.col("vec_id").cast("long"))
    passes = max(1, -(-asked.count() // QUERY_BLOCK))
    found = None
    for number in range(passes):
        block = sorted((r["vec_id"], r["terms"]) for r in asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == number).collect())
        shared = spark.sparkContext.broadcast((np.array([b[0] for b in block], dtype=np.int64), matrix(pa.array([b[1] for b in block], pa.list_(pa.int64())))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            query_ids, weights = shared.value
            kept = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))] * len(query_ids)
            for batch in batches:
                for at in range(0, len(batch), CANDIDATE_BLOCK):
                    part = batch.slice(at, CANDIDATE_BLOCK)
                    ids = part.column("vec_id").to_numpy()
                    scores = accumulate(weights, matrix(part.column("terms")))
                    for i, q in enumerate(query_ids):
                        other = ids != q
                        s, v = np.concatenate((kept[i][0], scores[i][other])), np.concatenate((kept[i][1], ids[other]))
                        top = best(s, v, k)
                        kept[i] = (s[top], v[top])
            lengths = [len(s) for s, _ in kept]
            columns = [np.repeat(query_ids, lengths), *(np.concatenate([x[j] for x in kept] or [np.empty(0, dtype=np.int64)]) for j in (1, 0))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

        part = rows.mapInArrow(run, "query_id long, vec_id long, score long")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
