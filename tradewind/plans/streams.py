"""Streaming queries, each drained over the given tables and equal to its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import epoch_us, tidy
from ..session import fresh_path
from ..sources.tables import EVAL_ANCHOR_US, PREDS
from ..streaming.past_only import OUTPUT, block_metrics_stream, past_only_stream, run_available
from .registry import query

HOURS6 = 6 * 3600 * 1_000_000


@query("str1", """WITH e AS (SELECT event_id AS id, event_type AS market, user_id, value, epoch_us(ts) AS us FROM events),
f AS (SELECT *, quantile_cont(value, 0.5) OVER w AS m, count(*) OVER w AS prior_n, count(DISTINCT user_id) OVER w AS prior_entities FROM e WINDOW w AS (PARTITION BY market ORDER BY us RANGE BETWEEN 21600000000 PRECEDING AND 1 PRECEDING))
SELECT id, market, us, prior_n, prior_entities, round(m, 6) AS median FROM f WHERE us // 1000 < (SELECT max(us) // 1000 FROM e) - 600000""")
def str1(t):
    """Past-only median and support as a stateful stream over the events table."""
    src = fresh_path(t.spark, "events")
    t.read("events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("market"), F.col("user_id").alias("entity"), "value", F.col("ts").cast("timestamp").alias("ts"), epoch_us(F.col("ts")).alias("us")
    ).write.parquet(src)
    stream = t.spark.readStream.schema(t.spark.read.parquet(src).schema).parquet(src)
    out = fresh_path(t.spark, "str1")
    run_available(past_only_stream(stream, HOURS6, "10 minutes"), out, fresh_path(t.spark, "checkpoint"))
    return t.spark.read.schema(OUTPUT).parquet(out).select("id", "market", "us", "prior_n", "prior_entities", F.round("median", 6).alias("median"))


@query("str2", f"""WITH {PREDS}, b AS (SELECT block, count(*) AS n, sum(power(y - p_brand, 2)) AS sse FROM preds GROUP BY 1)
SELECT block, n, round(sqrt(sse / n), 6) AS rmse FROM b WHERE 946684800000000 + (block + 1) * 1209600000000 <= (SELECT max(us) FROM preds)""")
def str2(t):
    """14-day block RMSE as a windowed streaming aggregate; only blocks the watermark closed."""
    src = fresh_path(t.spark, "scored")
    t.preds.select(F.col("ts").cast("timestamp").alias("ts"), "y", "p_brand").write.parquet(src)
    stream = t.spark.readStream.schema(t.spark.read.parquet(src).schema).parquet(src)
    out = fresh_path(t.spark, "str2")
    run_available(block_metrics_stream(stream, "0 seconds", EVAL_ANCHOR_US, "y", "p_brand"), out, fresh_path(t.spark, "checkpoint"))
    rows = t.spark.read.schema("start timestamp, n bigint, sse double").parquet(out)
    block = F.floor((F.unix_micros("start") - F.lit(EVAL_ANCHOR_US)) / F.lit(14 * 86_400_000_000)).cast("bigint")
    return rows.select(block.alias("block"), "n", tidy(F.sqrt(F.col("sse") / F.col("n"))).alias("rmse"))
