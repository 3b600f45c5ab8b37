"""Mixing sources to target weights by pivotal dependent rounding on a reduction tree."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .text import word_count

#: Rows that one leaf of the tree rounds, and residuals that one inner node combines.
LEAF_ROWS, FAN_IN = 512, 256

_STATE = "source string, row_key long, doc_id long, size long, base long, p double, node long, extra long"


def targets(totals: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> dict[str | None, Fraction]:
    """Words wanted from each source: all words shared by weight, at most ``most`` times a source's own.

    Weights repeat over the sources in code point order, null last. What a capped source cannot take
    is reshared by weight among the others until no target is above its cap.
    """
    order = sorted((s for s in totals if s is not None)) + [s for s in totals if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = Fraction(sum(totals.values())), set(order), {}
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > most * totals[s]]
        for s in over or free:
            out[s] = Fraction(most * totals[s]) if over else share * weight[s]
        left -= sum(out[s] for s in over)
        free = free - set(over) if over else set()
    return out


def _uniform(keys: np.ndarray, level: int) -> np.ndarray:
    """Repeatable draws in [0, 1) from row keys, positions and the level of the tree."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.arange(1, len(keys) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level * 0x632BE5AB)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def pivot(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Round probabilities pairwise; returns them and the index of the one still fractional, or -1.

    Each step moves words between two fractional rows so that the expected copies of each row and
    the words of the pair stay the same, until one of the two is 0 or 1.
    """
    p, size, draw = p.tolist(), size.tolist(), draw.tolist()
    open_ = -1
    for j in range(len(p)):
        if not 0.0 < p[j] < 1.0:
            continue
        if open_ < 0:
            open_ = j
            continue
        i = open_
        wi, wj = size[i], size[j]
        up, down = min((1.0 - p[i]) * wi, p[j] * wj), min(p[i] * wi, (1.0 - p[j]) * wj)
        move = up if draw[j] * (up + down) < down else -down
        p[i], p[j] = p[i] + move / wi, p[j] - move / wj
        for k in (i, j):
            if p[k] < 1e-9:
                p[k] = 0.0
            elif p[k] > 1.0 - 1e-9:
                p[k] = 1.0
        open_ = next((k for k in (i, j) if 0.0 < p[k] < 1.0), -1)
    return np.array(p), open_


def _node(level: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["row_key", "doc_id", "size"], kind="stable", na_position="last").reset_index(drop=True)
        draw = _uniform(rows["row_key"].to_numpy(dtype=np.int64), level)
        p, open_ = pivot(rows["p"].to_numpy(dtype=float), rows["size"].to_numpy(), draw)
        if last and open_ >= 0:
            p[open_], open_ = float(draw[open_] < p[open_]), -1
        extra = pd.array(np.round(p).astype(np.int64), dtype="Int64")
        if open_ >= 0:
            extra[open_] = pd.NA
        return rows.assign(p=p, extra=extra)

    return run


def mix(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """How often the mix takes each row: doc_id, source, row_key, size, source_size, target, copies, taken.

    One row per row of ``documents``. The ratio of a source's target to its size is split into whole
    copies, which every row gets, and a fraction, the row's probability of one more. Leaves of about
    ``LEAF_ROWS`` rows, dealt by a hash of the row so that no source or leaf is hot, round their
    fractions pairwise; each passes one unfinished row up a tree of ``FAN_IN``, whose root settles the
    last. Words taken from a source thus miss its target by less than one document. Draws depend on
    row hashes alone, so reruns agree whatever the partitioning.

    Null texts and texts without words have size 0 and take 0 words. A null source is a source of its
    own, last in order; null ids are allowed. Repeated rows are rounded one by one; rows equal in all
    of id, source and text are interchangeable. An empty table gives an empty result. Only per-source
    totals, one row per source, reach the driver. Extra columns are not read.
    """
    spark = documents.sparkSession
    sized = written(
        documents.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            F.xxhash64(F.col(doc_id), F.col(source), F.col(text)).alias("row_key"),
            word_count(F.col(text)).alias("size"),
        ),
        "mix-sizes",
    )
    sums = {r["source"]: (r["size"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.when(F.col("size") > 0, 1)).alias("n")).collect()}
    wanted = targets({s: n for s, (n, _) in sums.items()}, weights, most)
    rows, leaves = [], 1
    for s, (size, n) in sums.items():
        ratio = wanted[s] / size if size else Fraction(0)
        base, blocks = math.floor(ratio), max(1, -(-n // LEAF_ROWS))
        leaves = max(leaves, blocks)
        rows.append((s, size, float(wanted[s]), base, float(ratio - base), blocks))
    plan = spark.createDataFrame(rows, "source string, source_size long, target double, base long, p double, blocks long")
    state = (
        sized.join(plan, sized["source"].eqNullSafe(plan["source"]))
        .select(sized["source"], "row_key", "doc_id", "size", "base", "p", "source_size", "target", F.pmod(F.xxhash64("row_key", "doc_id"), "blocks").alias("node"))
    )
    whole = (F.col("size") == 0) | (F.col("p") == 0.0)
    decided = [state.where(whole).withColumn("extra", F.lit(0).cast("long"))]
    waiting, level = state.where(~whole), 0
    schema = _STATE + ", source_size double, target double"
    waiting = waiting.select("source", "row_key", "doc_id", "size", "base", "p", "node", F.lit(None).cast("long").alias("extra"), F.col("source_size").cast("double").alias("source_size"), "target")
    while True:
        out = written(waiting.groupBy("source", "node").applyInPandas(_node(level, leaves == 1), schema), f"mix-level{level}")
        decided.append(out.where(F.col("extra").isNotNull()))
        if leaves == 1:
            break
        # Blocks of a source fall together by FAN_IN, so the tree has about log(rows) levels.
        leaves, level = -(-leaves // FAN_IN), level + 1
        waiting = out.where(F.col("extra").isNull()).withColumn("node", F.pmod("node", F.lit(leaves)))
    columns = ["doc_id", "source", "row_key", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("base") + F.col("extra")).alias("copies")]
    result = decided[0].select(*columns)
    for part in decided[1:]:
        result = result.unionByName(part.select(*columns))
    return result.withColumn("taken", F.col("size") * F.col("copies"))


def apply_mix(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with each row repeated as often as ``mix`` takes it; rows taken 0 times go.

    The decision meets its row by id and a hash of id, source and text, so the texts are shuffled
    once. Rows equal in all three share their decisions in any order.
    """
    names = {k: options.get(k, k) for k in ("doc_id", "text", "source")}
    taken = mix(documents, **options).groupBy("row_key").agg(F.sort_array(F.collect_list("copies")).alias("_copies"))
    keyed = documents.withColumn("_key", F.xxhash64(*[F.col(names[k]) for k in ("doc_id", "source", "text")]))
    joined = keyed.join(taken, keyed["_key"] == taken["row_key"])
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    counted = joined.withColumn("_n", F.element_at("_copies", nth))
    return counted.where("_n > 0").withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select(*documents.columns)
