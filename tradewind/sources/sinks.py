"""Sinks: write-once tables, ordered-union CSV, split partitions, wide and fixed-decimal exports."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_once(df: DataFrame, path: str) -> None:
    """Write a table that must not exist yet."""
    df.write.mode("errorifexists").parquet(path)


def refuses_overwrite(df: DataFrame, path: str) -> bool:
    try:
        df.limit(0).write.mode("errorifexists").parquet(path)
    except AnalysisException:
        return True
    return False


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Concatenate tables whose columns differ: header is the ordered union, gaps are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder per split, so a reader of the development split never opens evaluation labels."""
    df.write.mode("errorifexists").partitionBy(split).parquet(path)


def widen_predictions(long: DataFrame, keys: list[str], model: str, value: str, models: list[str]) -> DataFrame:
    """One row per key with a ``prediction__<model>`` column each; the model list fixes the plan."""
    picked = [F.max(F.when(F.col(model) == m, F.col(value))).alias(f"prediction__{m}") for m in models]
    return long.groupBy(*keys).agg(*picked)


def fixed_decimals(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.select(*[
        F.format_string(f"%.{digits[c]}f", F.col(c)).alias(c) if c in digits else F.col(c) for c in df.columns
    ])


def parameter_rows(df: DataFrame, model: str, feature: str, kind: str, value: str) -> DataFrame:
    """Fitted parameters in the common (model, feature, kind, value) form."""
    return df.select(F.lit(model).alias("model"), F.col(feature).cast("string").alias("feature"), F.lit(kind).alias("kind"), F.col(value).cast("double").alias("value"))
