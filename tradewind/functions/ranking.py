"""Exact global ranks and exact quantiles that never sort a whole table or group in one task."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .scalars import hash_number

#: Rows of one slice, roughly.
SLICE_ROWS = 250_000


def _position(df: DataFrame, key: str) -> Column:
    """A double that never falls as ``key`` rises, for cutting: text by its first six bytes, NaN as the greatest number."""
    if isinstance(df.schema[key].dataType, T.StringType):
        return F.conv(F.rpad(F.substring(F.hex(F.col(key).cast("binary")), 1, 12), 12, "0"), 16, 10).cast("double")
    number = F.col(key).cast("double")
    return F.when(F.isnan(number), F.lit(float("inf"))).otherwise(number)


def dense_index(df: DataFrame, key: str, tiebreak: str, name: str, buckets: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Add the 0-based rank of every row under the order (key, hash of tiebreak, tiebreak).

    Null keys come first, NaN after all numbers, as Spark sorts; text keys go by their bytes. With
    ``by`` the ranks start anew in each group; the slices are the same for all groups.

    Approximate quantiles only choose where to cut the key range; ranks are exact: row_number in a
    slice plus the number of rows in earlier slices. Rows that share a cut value, which may be a
    third of the table, are sliced again by their hash, as are nulls, so no task sees a whole hot
    key; only infinite, NaN and long equal text keys are not. Slices grow with the table
    (``SLICE_ROWS``).
    """
    by = by or []
    placed = df.withColumn("_k", _position(df, key)).withColumn("_h", hash_number(F.col(tiebreak)))
    if buckets is None:
        buckets = max(64, -(-df.count() // SLICE_ROWS))
    probs = [i / buckets for i in range(1, buckets)]
    cuts = placed.select(F.percentile_approx("_k", probs, 20 * buckets).alias("c")).first()["c"] if probs else []
    # At least one cut, also for an empty table or one of nulls.
    cuts = sorted({float(c) for c in cuts or [] if math.isfinite(c)}) or [0.0]
    splits = [float("-inf"), *cuts, float("inf")]
    sliced = Bucketizer(splits=splits, inputCol="_at", outputCol="_b").transform(placed.withColumn("_at", F.coalesce("_k", F.lit(0.0))))
    # Equal finite numbers at a cut, and nulls, are sliced again by hash. Text that shares six bytes need not be equal.
    ties, hot = max(16, buckets // 4), F.floor(F.col("_h") * max(16, buckets // 4) / F.lit(2**32))
    at_cut = F.lit(False) if isinstance(df.schema[key].dataType, T.StringType) else F.col("_k") == F.element_at(F.array(*map(F.lit, splits[:-1])), F.col("_b").cast("int") + 1)
    finite = F.coalesce(F.abs("_k") != float("inf"), F.lit(False))
    sliced = sliced.withColumn("_s", F.when(F.col("_k").isNull() | at_cut & finite, hot).otherwise(F.lit(ties)).cast("int"))
    sliced = sliced.withColumn("_b", F.when(F.col("_k").isNull(), F.lit(-1)).otherwise(F.col("_b").cast("int")))
    sizes = sliced.groupBy(*by, "_b", "_s").agg(F.count(F.lit(1)).alias("_n"))
    # A few rows per slice and group: the un-partitioned case runs over this bounded table.
    earlier = (W.partitionBy(*by) if by else W.partitionBy()).orderBy("_b", "_s").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select(*by, "_b", "_s", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inner = W.partitionBy(*by, "_b", "_s").orderBy(key, "_h", tiebreak)
    joined = _null_safe_join(sliced, before if by else F.broadcast(before), [*by, "_b", "_s"])
    return joined.withColumn(name, F.col("_before") + F.row_number().over(inner) - 1).drop("_k", "_at", "_b", "_h", "_s", "_before")


def exact_quantiles(
    df: DataFrame,
    by: list[str],
    value: str,
    probs: dict[str, float],
    accuracy: int = 10_000,
    nearest: bool = False,
) -> DataFrame:
    """Exact quantiles per group without holding a group in memory.

    A quantile sketch brackets every wanted rank; one more pass counts the rows below the bracket
    and keeps the distinct values inside it (about 8/accuracy of the group); the order statistics
    are then picked by cumulative count. A rank outside its bracket raises, it is never guessed.
    ``nearest`` picks round(p*(n-1)) with halves to even; otherwise values are interpolated linearly.
    """
    # One part for the sketch's error, one for a rank's distance from p * n, two in reserve. Groups of
    # at most ``accuracy`` rows skip the sketch: their bracket is the whole group.
    eps = 4.0 / accuracy
    names = list(probs)
    rows = df.filter(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    whole = not by
    if whole:
        by, rows = ["_all"], rows.withColumn("_all", F.lit(1))
    low = [max(0.0, probs[n] - eps) for n in names]
    high = [min(1.0, probs[n] + eps) for n in names]
    group = list(by)
    bracket = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", low + high, accuracy).alias("_cuts"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
    )
    wanted = F.array(*[
        F.struct(
            F.lit(n).alias("q"),
            F.lit(probs[n]).alias("p"),
            (F.lit(probs[n]) * (F.col("_n") - 1)).alias("at"),
            F.when(F.lit(low[i] <= 0) | (F.col("_n") <= accuracy), F.col("_min")).otherwise(F.col("_cuts")[i]).alias("lo"),
            F.when(F.lit(high[i] >= 1) | (F.col("_n") <= accuracy), F.col("_max")).otherwise(F.col("_cuts")[len(names) + i]).alias("hi"),
        )
        for i, n in enumerate(names)
    ])
    plan = bracket.select(*group, F.explode(wanted).alias("w"))
    plan = plan.select(*group, "w.*")
    rank_low, rank_high = (F.rint("at"), F.rint("at")) if nearest else (F.floor("at"), F.ceil("at"))
    plan = plan.withColumn("r0", rank_low.cast("bigint")).withColumn("r1", rank_high.cast("bigint"))
    packed = plan.groupBy(*group).agg(F.collect_list(F.struct("q", "at", "lo", "hi", "r0", "r1")).alias("_w"))
    # Without groups the bracket table has one row, so it is broadcast; with groups Spark decides by its size,
    # which is known once it is written. Otherwise the rows would be shuffled to meet a handful of brackets.
    packed = F.broadcast(packed) if whole else written(packed, "brackets")
    joined = _null_safe_join(rows.select(*group, "_v"), packed, group)
    near = joined.select(*group, "_v", F.explode("_w").alias("w")).filter(F.col("_v") <= F.col("w.hi"))
    # Values below a bracket collapse to one counted row per bracket, those inside stay distinct.
    counted = near.groupBy(
        *group, F.col("w.q").alias("q"), F.col("w.at").alias("at"), F.col("w.r0").alias("r0"), F.col("w.r1").alias("r1"),
        F.when(F.col("_v") >= F.col("w.lo"), F.col("_v")).alias("v"),
    ).agg(F.count(F.lit(1)).alias("c"))
    upto = W.partitionBy(*group, "q").orderBy(F.col("v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    placed = counted.withColumn("_to", F.sum("c").over(upto)).withColumn("_from", F.col("_to") - F.col("c"))
    pick = lambda r: F.max(F.when((F.col(r) >= F.col("_from")) & (F.col(r) < F.col("_to")), F.col("v")))
    chosen = placed.groupBy(*group, "q", "at", "r0", "r1").agg(pick("r0").alias("v0"), pick("r1").alias("v1"))
    lost = F.col("v0").isNull() | F.col("v1").isNull()
    between = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("at") - F.col("r0"))
    result = F.when(lost, F.raise_error(F.lit("quantile bracket missed its rank; raise accuracy")).cast("double")).otherwise(
        F.col("v0") if nearest else between
    )
    out = chosen.select(*group, "q", result.alias("x"))
    picked = out.groupBy(*group).agg(*[F.max(F.when(F.col("q") == n, F.col("x"))).alias(n) for n in names])
    return picked.drop("_all") if whole else picked


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_r_{k}")
    cond = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, cond).drop(*[f"_r_{k}" for k in keys])
