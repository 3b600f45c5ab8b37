"""Raw log to metrics in one plan: waterfall, past-only features, target, zero-baseline scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import log_relative, tidy
from ..operators import temporal
from ..operators.metrics import score
from ..sources.tables import RAW, WINDOW_US, Tables
from .cleaning import CLEAN, clean_ledger
from .registry import query


def clean_to_metrics(spark: SparkSession, sf_dir: str, min_n: int = 20, min_entities: int = 10) -> DataFrame:
    return metrics_from(Tables(spark, sf_dir), min_n, min_entities)


def metrics_from(t: Tables, min_n: int, min_entities: int) -> DataFrame:
    """Zero-baseline metrics per market over the supported clean trades of the raw log."""
    ledger = t.stage("ledger", lambda: clean_ledger(t).select("line_no", "market", "entity", "us", "price", "base_clean"))
    clean = ledger.filter("base_clean")
    support = temporal.past_only_support(clean, "market", "us", "entity", WINDOW_US)
    median = temporal.past_only_stat(clean, "market", "us", "price", WINDOW_US)
    features = support.join(median, ["market", "us"]).filter((F.col("prior_n") >= min_n) & (F.col("prior_entities") >= min_entities))
    rows = temporal.attach(clean, features, "market", "us").filter("baseline IS NOT NULL")
    rows = rows.withColumn("y", log_relative(F.col("price"), F.col("baseline"))).withColumn("p_zero", F.lit(0.0))
    scored = score(rows, ["market"], "entity", "y", ["zero"])
    return scored.select("market", "model", "n", "n_entities", *[tidy(F.col(c)).alias(c) for c in ("rmse", "mae", "r2", "entity_rmse")])


FLAGSHIP_SQL = f"""
WITH {CLEAN},
framed AS (
  SELECT *, count(*) OVER w AS pn, count(DISTINCT entity) OVER w AS pe, quantile_cont(price, 0.5) OVER w AS b
  FROM ledger WHERE base_clean
  WINDOW w AS (PARTITION BY market ORDER BY us RANGE BETWEEN 1728000000000 PRECEDING AND 1 PRECEDING)),
y AS (SELECT market, entity, ln(price / b) AS y FROM framed WHERE pn >= 20 AND pe >= 10),
ent AS (SELECT market, entity, avg(y * y) AS m FROM y GROUP BY 1, 2),
tot AS (SELECT market, count(*) AS n, count(DISTINCT entity) AS n_entities, sqrt(avg(y * y)) AS rmse, avg(abs(y)) AS mae,
          1 - sum(y * y) / (count(*) * var_pop(y)) AS r2 FROM y GROUP BY 1)
SELECT t.market, 'zero' AS model, n, n_entities, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r2, 6) AS r2,
  round((SELECT sqrt(avg(m)) FROM ent e WHERE e.market = t.market), 6) AS entity_rmse
FROM tot t"""


@query("flagship", FLAGSHIP_SQL)
def flagship(t):
    return metrics_from(t, t.min_n, t.min_entities)
