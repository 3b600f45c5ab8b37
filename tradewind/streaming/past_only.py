"""Structured Streaming forms of the past-only features and of the block metrics.

Past-only values need every trade before a moment and none at it. A trade therefore waits until the
watermark has passed its millisecond; then all its same-time peers are known, and all of them are
answered from strictly earlier trades. Trades behind the watermark are dropped by Spark, and
``run_available`` returns how many. State is keyed by (market, time shard) with halo copies, so a
market's history is spread over shards; a timer at a shard's end clears all its state.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from ..operators.temporal import halo_shards, sliding_distinct, sliding_medians

OUTPUT = "id bigint, market string, us bigint, prior_n bigint, prior_entities bigint, median double"
_ROW = StructType([
    StructField("us", LongType()), StructField("id", LongType()), StructField("entity", LongType()), StructField("value", DoubleType()), StructField("core", BooleanType()),
])


class PastOnlyProcessor(StatefulProcessor):
    """Buffers a shard's trades in time order and releases those the watermark has passed."""

    def __init__(self, window: int, shard: int):
        self.window, self.shard = window, shard

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _ROW)
        self.history = handle.getListState("history", _ROW)

    def handleInputRows(self, key, rows, timerValues):
        fresh, first = [], None
        for pdf in rows:
            for r in pdf[["us", "id", "entity", "value", "core"]].itertuples(index=False, name=None):
                fresh.append((int(r[0]), int(r[1]), int(r[2]), float(r[3]), bool(r[4])))
        if fresh:
            first = min(r[0] for r in fresh)
            self.pending.appendList(fresh)
            self.handle.registerTimer(first // 1000 + 1)
            self.handle.registerTimer(self._end(key))
        return iter([])

    def _end(self, key) -> int:
        """The millisecond after which a shard can neither get nor answer a trade."""
        return (int(key[1]) + 1) * self.shard // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        limit = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.pending.get()) if self.pending.exists() else []
        done = [r for r in waiting if r[0] // 1000 < limit]
        left = waiting[len(done):]
        if not done:
            if limit >= self._end(key):
                self.history.clear()
                self.pending.clear()
            return iter([])
        past = list(self.history.get()) if self.history.exists() else []
        known = past + done
        times = np.array([r[0] for r in known])
        moments = np.unique(times[len(past):])
        first, last = np.searchsorted(times, moments - self.window), np.searchsorted(times, moments)
        spans = first.tolist(), last.tolist()
        medians, entities = sliding_medians([r[3] for r in known], *spans), sliding_distinct([r[2] for r in known], *spans)
        at = {int(us): (int(b - a), int(k), float(m) if b > a else None) for us, a, b, m, k in zip(moments, first, last, medians, entities)}
        out = [(r[1], key[0], r[0], *at[r[0]]) for r in done if r[4]]
        keep = [r for r in known if r[0] >= done[-1][0] - self.window]
        if limit >= self._end(key):
            self.history.clear()
        else:
            self.history.put(keep)
        if left:
            self.pending.put(left)
            self.handle.registerTimer(left[0][0] // 1000 + 1)
        else:
            self.pending.clear()
        return iter([pd.DataFrame(out, columns=["id", "market", "us", "prior_n", "prior_entities", "median"])])

    def close(self) -> None:
        pass


def past_only_stream(stream: DataFrame, window: int, delay: str, shard: int | None = None) -> DataFrame:
    """Past-only median and support of a stream with columns id, market, entity, value, ts, us."""
    shard = shard or 3 * window
    spread = halo_shards(stream.withWatermark("ts", delay), "us", window, shard)
    slim = spread.select("market", F.col("_shard").alias("shard"), "ts", "us", "id", "entity", F.col("value").cast("double").alias("value"), F.col("_core").alias("core"))
    return slim.groupBy("market", "shard").transformWithStateInPandas(
        statefulProcessor=PastOnlyProcessor(window, shard), outputStructType=StructType.fromDDL(OUTPUT), outputMode="Append", timeMode="EventTime"
    )


def block_metrics_stream(stream: DataFrame, delay: str, anchor_us: int, y: str, p: str) -> DataFrame:
    """Squared-error sums per 14-day block, emitted when the watermark closes the block."""
    offset = f"{anchor_us // 1_000_000 % (14 * 86_400)} seconds"
    e = F.col(y) - F.col(p)
    w = F.window("ts", "14 days", startTime=offset)
    return stream.withWatermark("ts", delay).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse")).select(
        F.col("w.start").alias("start"), "n", "sse"
    )


def run_available(stream: DataFrame, out: str, checkpoint: str) -> int:
    """Drain what the source holds into a file sink, exactly once per checkpoint, then stop.

    Returns how many rows came too late for a stateful operator and were dropped.
    """
    spark = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return sum(op.numRowsDroppedByWatermark for p in q.recentProgress for op in p.stateOperators)
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
