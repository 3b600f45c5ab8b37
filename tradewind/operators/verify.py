"""Result verification: contracts, named checks, identities, coverage, gaps and stage order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def contract(actual: DataFrame, expected: DataFrame, keys: list[str], atol: float) -> DataFrame:
    """Every expected cell with the recomputed value; a missing value fails, null equals null."""
    j = expected.join(actual.withColumn("_present", F.lit(True)), keys, "left")
    close = F.abs(F.col("actual") - F.col("expected")) <= F.lit(atol)
    both_null = F.col("actual").isNull() & F.col("expected").isNull()
    return j.withColumn("passed", F.coalesce(F.col("_present") & (close | both_null), both_null & F.col("_present"), F.lit(False))).drop("_present")


def checks(*parts: tuple[str, DataFrame, str]) -> DataFrame:
    """Named checks as rows: ``(name, one-row table, boolean expression over it)``."""
    out = None
    for name, table, rule in parts:
        row = table.select(F.lit(name).alias("check"), F.coalesce(F.expr(rule), F.lit(False)).alias("passed"), F.to_json(F.struct("*")).alias("detail"))
        out = row if out is None else out.unionByName(row)
    return out


def require(checked: DataFrame) -> DataFrame:
    """The same rows, but the job fails on the first check that did not pass."""
    fail = F.raise_error(F.concat(F.lit("failed check: "), F.col("check"))).cast("boolean")
    return checked.filter(F.when(F.col("passed"), F.lit(True)).otherwise(fail))


def broken_identities(results: DataFrame, rules: dict[str, str], keep: list[str]) -> DataFrame:
    """Rows violating named arithmetic identities, one row per violation."""
    names = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(r), F.lit(False)), F.lit(n)) for n, r in rules.items()]))
    return results.select(*keep, F.explode(names).alias("broken"))


def uncovered(rows: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(listed, keys, "left_anti")


def gap(a: DataFrame, b: DataFrame, keys: list[str], value: str, by: list[str], limit: float) -> DataFrame:
    """Largest and root-mean-square gap of two versions of a column, and whether it stays in limit."""
    j = a.select(*keys, *by, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full_outer")
    d = F.col("_a") - F.col("_b")
    return j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(d.isNull()).alias("unmatched"),
        F.max(F.abs(d)).alias("max_gap"), F.sqrt(F.avg(d * d)).alias("rmse_gap"),
    ).withColumn("passed", (F.col("unmatched") == 0) & (F.col("max_gap") <= F.lit(limit)))


def stage_order(events: DataFrame, scope: list[str], at: str, step: str) -> DataFrame:
    """Per scope: steps never go back in time. Scopes are runs, each with a handful of steps."""
    w = W.partitionBy(*scope).orderBy(step)
    lagged = events.withColumn("_prev", F.lag(at).over(w))
    return lagged.groupBy(*scope).agg(F.bool_and(F.coalesce(F.col("_prev") <= F.col(at), F.lit(True))).alias("ordered"), F.count(F.lit(1)).alias("n_steps"))
