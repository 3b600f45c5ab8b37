"""Joins with the guards that make them safe: missing keys, alignment, range look-back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import DAY_US


def lookup(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Inner lookup whose missing keys are an error instead of lost rows."""
    marked = df.join(table.withColumn("_found", F.lit(True)), keys, "left")
    missing = F.raise_error(F.concat(F.lit("no entry for "), F.to_json(F.struct(*keys)))).cast("boolean")
    return marked.filter(F.coalesce("_found", missing)).drop("_found")


def alignment(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row: keys on one side only, shared keys, and shared keys whose fields disagree."""
    a = left.select(key, F.struct(*fields).alias("a"))
    b = right.select(key, F.struct(*fields).alias("b"))
    j = a.join(b, key, "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return j.agg(
        F.count_if(F.col("b").isNull()).alias("only_left"),
        F.count_if(F.col("a").isNull()).alias("only_right"),
        F.count_if(both).alias("shared"),
        *[F.count_if(both & ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))).alias(f"differs_{f}") for f in fields],
    )


def score_once(rows: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """Attach per-entity scores to every trade of the entity: score first, expand last."""
    return rows.join(scored, key)


def membership(rows: DataFrame, members: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Boolean column telling whether the row's key occurs in ``members``."""
    known = members.select(*keys).distinct().withColumn(name, F.lit(True))
    return rows.join(known, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def manifest(traded: DataFrame, described: DataFrame, key: str) -> DataFrame:
    """Keys traded or described, with the number of rows on each side."""
    a = traded.groupBy(key).agg(F.count(F.lit(1)).alias("n_trades"))
    b = described.groupBy(key).agg(F.count(F.lit(1)).alias("n_described"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(b, key, "full_outer").select(key, zero("n_trades"), zero("n_described"))


def range_lookback(probes: DataFrame, past: DataFrame, market: str, us: str, window: int, keep: list[str]) -> DataFrame:
    """Past rows in ``[t - window, t)`` of each probe, by an equi-join on (market, day) buckets.

    A probe is copied once per day its window touches; ``probe_us`` is its moment.
    """
    day = lambda c: F.floor(c / F.lit(DAY_US)).cast("bigint")
    spread = probes.select(
        F.col(market).alias("_m"), F.col(us).alias("probe_us"), "probe",
        F.explode(F.sequence(day(F.col(us) - F.lit(window)), day(F.col(us)))).alias("_day"),
    )
    rows = past.select(market, us, *keep).withColumn("_d", day(F.col(us)))
    near = (F.col(market) == F.col("_m")) & (F.col("_d") == F.col("_day"))
    exact = (F.col(us) < F.col("probe_us")) & (F.col(us) >= F.col("probe_us") - F.lit(window))
    return rows.join(spread, near & exact).drop("_m", "_d", "_day")
