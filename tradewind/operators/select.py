"""Selection over score tables: pooling, tie rules, blend weights, transfer and change reports.

A score table holds one row per (fold, candidate); its size is the grid, not the data. Windows and
grouped pandas below therefore see at most a grid's worth of rows per group.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

TOLERANCE = 1e-12


def pool(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Pooled error over folds; a candidate invalid in any fold is invalid and has no score."""
    p = scores.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("sse").alias("_s"), F.bool_and("valid").alias("valid"), F.count(F.lit(1)).alias("folds"))
    return p.withColumn("mse", F.when(F.col("valid"), F.col("_s") / F.col("n"))).drop("_s")


def compare_fits(a: DataFrame, b: DataFrame, keys: list[str], fold: str) -> DataFrame:
    """Pooled squared error of two fits of the same cases, their difference, and joint validity."""
    left = a.select(*keys, fold, "n", F.col("rmse").alias("ra"), F.col("valid").alias("va"))
    right = b.select(*keys, fold, F.col("rmse").alias("rb"), F.col("valid").alias("vb"))
    pooled = lambda r: F.sum(F.col(r) * F.col(r) * F.col("n")) / F.sum("n")
    return left.join(right, [*keys, fold]).groupBy(*keys).agg(
        pooled("ra").alias("mse_a"), pooled("rb").alias("mse_b"), (pooled("rb") - pooled("ra")).alias("difference"), F.bool_and(F.col("va") & F.col("vb")).alias("all_valid")
    )


def best(scores: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group under an explicit total order; exact, no tolerance."""
    keys = [F.struct(*order).alias("_o")]
    rest = [c for c in scores.columns if c not in by]
    top = scores.withColumn("_o", keys[0]).groupBy(*by).agg(F.min_by(F.struct(*rest), F.col("_o")).alias("_b"))
    return top.select(*by, "_b.*")


def ordered_choices(scores: DataFrame, by: list[str], mse: str, simplicity: list[str]) -> DataFrame:
    """Fall-through order of the valid candidates of each group, as a 1-based ``rank``.

    Place k goes to the simplest of those not yet placed whose error is at most 1e-12 over the least
    error not yet placed. Candidates without an error (null or NaN: a fit failed) have no place and
    are left out. ``simplicity`` columns are compared ascending, smaller is simpler.

    Errors only move up as places are given, so one pass over the candidates in order of error with
    a heap of those within tolerance, keyed by simplicity, is enough.
    """
    schema = T.StructType([*scores.schema.fields, T.StructField("rank", T.LongType())])

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(mse, kind="stable").reset_index(drop=True)
        error = rows[mse].tolist()
        simple = list(rows[simplicity].itertuples(index=False, name=None))
        placed = [False] * len(rows)
        open_, result, low, high = [], [], 0, 0
        while low < len(rows):
            while high < len(rows) and error[high] <= error[low] + TOLERANCE:
                heapq.heappush(open_, (simple[high], high))
                high += 1
            _, i = heapq.heappop(open_)
            placed[i] = True
            result.append(i)
            while low < len(rows) and placed[low]:
                low += 1
        return rows.iloc[result].assign(rank=range(1, len(result) + 1))

    valid = scores.filter(F.col(mse).isNotNull() & ~F.isnan(mse))
    return valid.groupBy(*by).applyInPandas(order, schema)


def grid_rounded_choices(scores: DataFrame, by: list[str], mse: str, simplicity: list[str]) -> DataFrame:
    """Order by the error on a 1e-12 grid, then simplicity: ties are fixed, not sequential."""
    w = W.partitionBy(*by).orderBy(F.rint(F.col(mse) / F.lit(TOLERANCE)), *simplicity)
    return scores.withColumn("rank", F.row_number().over(w).cast("bigint"))


def first_within(scores: DataFrame, by: list[str], mse: str, order: str) -> DataFrame:
    """First candidate in the fixed order whose error is within 1e-12 of the best."""
    low = scores.groupBy(*by).agg(F.min(mse).alias("_low"))
    near = scores.join(low, by).filter(F.col(mse) <= F.col("_low") + F.lit(TOLERANCE)).drop("_low")
    return best(near, by, [F.col(order)])


def blend_sums(df: DataFrame, by: list[str], y: str, a: str, b: str) -> DataFrame:
    """The three error sums from which every blend weight can be scored."""
    ea, eb = F.col(y) - F.col(a), F.col(y) - F.col(b)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(ea * ea).alias("aa"), F.sum(ea * eb).alias("ab"), F.sum(eb * eb).alias("bb"))


def blend_scores(sums: DataFrame, weights: list[float], digits: int | None = None) -> DataFrame:
    """Error of (1-w)*a + w*b for each weight: the error is quadratic in w, so no second pass."""
    w = F.col("weight")
    mse = ((1 - w) * (1 - w) * F.col("aa") + 2 * w * (1 - w) * F.col("ab") + w * w * F.col("bb")) / F.col("n")
    mse = mse if digits is None else F.round(mse, digits)
    return sums.withColumn("weight", F.explode(F.array(*[F.lit(float(x)) for x in weights]))).withColumn("mse", mse)


def late_weight(grid: DataFrame, by: list[str], rule: str = "exact") -> DataFrame:
    """Chosen weight: exact (mse, weight) order, or the smallest weight within 1e-12 of the best."""
    if rule == "exact":
        return best(grid, by, [F.col("mse"), F.col("weight")])
    return first_within(grid, by, "mse", "weight")


def next_quarter(scores: DataFrame, by: list[str], fold: str) -> DataFrame:
    """Pairs of successive folds per group."""
    w = W.partitionBy(*by).orderBy(fold)
    return scores.select(*by, fold).distinct().withColumn("next_fold", F.lead(fold).over(w)).filter("next_fold IS NOT NULL")


def forward_transfer(scores: DataFrame, by: list[str], fold: str, candidate: list[str], mse: str) -> DataFrame:
    """Each fold's winner scored in the following fold, next to that fold's own winner."""
    winner = best(scores.select(*by, fold, *candidate, mse), [*by, fold], [F.col(mse), *[F.col(c) for c in candidate]])
    pairs = next_quarter(scores, by, fold)
    carried = winner.join(pairs, [*by, fold])
    later = scores.select(*by, F.col(fold).alias("next_fold"), *candidate, F.col(mse).alias("transfer_mse"))
    own = winner.select(*by, F.col(fold).alias("next_fold"), F.col(mse).alias("best_mse"))
    return carried.join(later, [*by, "next_fold", *candidate]).join(own, [*by, "next_fold"])


def fold_roles(ts, folds) -> "F.Column":
    """Array of (fold, role) a moment belongs to; ``folds`` holds (name, start, origin, end) texts.

    Folds are time predicates, so assigning them is a projection: no join and no id lists.
    """
    from ..functions.scalars import in_window, those_where

    return those_where([
        (in_window(ts, a, b), F.struct(F.lit(name).alias("fold"), F.lit(role).alias("role")))
        for name, start, origin, end in folds
        for role, a, b in (("train", start, origin), ("valid", origin, end))
    ], "struct<fold:string,role:string>")


def inner_quarters(name: str, start: str, origin: str, k: int = 3) -> list[tuple[str, str, str, str]]:
    """The last ``k`` quarters before ``origin`` as folds named '<name>/<i>'."""
    marks = [str(d.date()) for d in pd.date_range(end=origin, periods=k + 1, freq=pd.DateOffset(months=3))]
    return [(f"{name}/{i}", start, marks[i], marks[i + 1]) for i in range(k)]


def fold_support(rows: DataFrame, fold: str, role: str, entity: str, us: str, min_rows: int, min_entities: int) -> DataFrame:
    """Row and entity support on both sides of each fold, and that training ends first."""
    train = F.col(role) == "train"
    per = rows.groupBy(fold, entity).agg(
        F.count_if(train).alias("a"), F.count_if(~train).alias("b"), F.max(F.when(train, F.col(us))).alias("la"), F.min(F.when(~train, F.col(us))).alias("fb")
    )
    out = per.groupBy(fold).agg(
        F.sum("a").alias("n_train"), F.sum("b").alias("n_valid"), F.count_if(F.col("a") > 0).alias("_ka"), F.count_if(F.col("b") > 0).alias("_kb"), F.max("la").alias("_l"), F.min("fb").alias("_f")
    )
    enough = (F.col("n_train") >= min_rows) & (F.col("n_valid") >= min_rows) & (F.col("_ka") >= min_entities) & (F.col("_kb") >= min_entities)
    return out.select(fold, "n_train", "n_valid", enough.alias("supported"), (F.col("_l") < F.col("_f")).alias("ordered"))


def first_valid(ranked: DataFrame, by: list[str]) -> DataFrame:
    """Best-ranked candidate that is valid."""
    return best(ranked.filter("valid"), by, [F.col("rank")])


class NotFrozen(RuntimeError):
    """Choices were not recorded, or are no longer those recorded."""


def digest(table: DataFrame) -> DataFrame:
    """One row (n, digest) that tells tables of different rows apart, in any order of rows and columns."""
    sha = F.sha2(F.to_json(F.struct(*sorted(table.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.sum(F.conv(F.substring(sha, at, 15), 16, 10).cast("decimal(38,0)"))
    return table.agg(F.count(F.lit(1)).alias("n"), F.concat_ws("-", part(1), part(16), part(31)).alias("digest"))


def freeze(choices: DataFrame, path: str) -> DataFrame:
    """Record the choices in a write-once table with a manifest beside it, and hand back the recorded ones."""
    choices.write.mode("errorifexists").parquet(path)
    stored = choices.sparkSession.read.schema(choices.schema).parquet(path)
    digest(stored).write.mode("errorifexists").parquet(f"{path}-manifest")
    return stored


def read_frozen(spark: SparkSession, path: str) -> DataFrame:
    """The choices frozen at ``path``; ``NotFrozen`` if there is no manifest or the table differs from it."""
    try:
        manifest = spark.read.parquet(f"{path}-manifest").collect()
        stored = spark.read.parquet(path)
        found = digest(stored).collect()
    except AnalysisException as missing:
        raise NotFrozen(f"nothing is frozen at {path}") from missing
    if [r.asDict() for r in manifest] != [r.asDict() for r in found]:
        raise NotFrozen(f"the choices at {path} are not those that were frozen")
    return stored


def read_after_freeze(spark: SparkSession, path: str, read: Callable[[], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The frozen choices and the evaluation rows; ``read`` is not called unless the choices are frozen and unchanged."""
    choices = read_frozen(spark, path)
    return choices, read()


def fall_through(ranked: DataFrame, by: list[str], candidate: str, refit: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The best-ranked candidate of each group whose final fit is valid: by, candidate, rank and the columns of its fit.

    ``ranked`` is a frozen ranking with ``rank`` 1, 2, ... in each group. ``refit`` gets the rows of it that
    are to be fitted and returns by, candidate, ``valid`` and columns of its own. Each round refits
    only the groups whose last candidate failed, at their next rank. Groups without a valid candidate,
    and those with a null key, are left out. There are as many rounds as the longest run of failures has
    fits; each writes its fits, and whether any group is still open is all that reaches the driver.
    """
    rank, found = 1, None
    turn = ranked.filter("rank = 1")
    while True:
        fits = written(refit(turn).join(turn.select(*by, candidate, "rank"), [*by, candidate]), "fall-through")
        good = fits.filter("valid").drop("valid")
        found = good if found is None else found.unionByName(good)
        failed = fits.filter("NOT valid").select(*by)
        if failed.isEmpty():
            return found
        rank += 1
        turn = ranked.filter(F.col("rank") == rank).join(failed, by, "left_semi")
