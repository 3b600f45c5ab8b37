"""The streaming form over several micro-batches: equal to batch, late rows counted, state cleared."""

import random
import time
from bisect import bisect_left
from statistics import median
from types import SimpleNamespace

from pyspark.sql import functions as F

from tradewind.streaming.past_only import OUTPUT, PastOnlyProcessor, past_only_stream, run_available

MINUTE = 60_000_000
SCHEMA = "id bigint, market string, entity bigint, value double, us bigint, ts timestamp"


def drain(spark, tmp_path, rows, name):
    src = f"{tmp_path}/in-{name}"
    spark.createDataFrame(rows, "id bigint, market string, entity bigint, value double, us bigint").withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    late = run_available(past_only_stream(stream, 30 * MINUTE, "10 minutes"), f"{tmp_path}/out-{name}", f"{tmp_path}/checkpoint-{name}")
    return late, {r["id"]: (r["prior_n"], r["prior_entities"], r["median"]) for r in spark.read.schema(OUTPUT).parquet(f"{tmp_path}/out-{name}").collect()}


def test_batches_agree_with_plain_code_and_late_rows_are_counted(spark, tmp_path):
    rows = [(i, "m", i % 4, float(i * 7 % 11), (i + 20) * 3 * MINUTE) for i in range(120)]
    for part in (rows[:50], rows[50:90], rows[90:]):
        late, got = drain(spark, tmp_path, part, "a")
        assert late == 0
    times = [r[4] for r in rows]
    closed = max(times) - 10 * MINUTE
    for i, _, _, _, us in rows:
        if us < closed - 3 * MINUTE:
            seen = rows[bisect_left(times, us - 30 * MINUTE) : bisect_left(times, us)]
            assert got[i] == (len(seen), len({r[2] for r in seen}), median(r[3] for r in seen) if seen else None)
    late, _ = drain(spark, tmp_path, [(999, "m", 1, 1.0, 5 * MINUTE)], "a")
    assert late >= 1


def test_state_of_finished_shards_is_gone(spark, tmp_path):
    drain(spark, tmp_path, [(i, "m", 1, 1.0, (i + 60) * MINUTE) for i in range(200)], "b")
    drain(spark, tmp_path, [(1000, "z", 1, 1.0, 10_000 * MINUTE)], "b")
    drain(spark, tmp_path, [(1001, "z", 1, 1.0, 20_000 * MINUTE)], "b")
    state = spark.read.format("statestore").option("stateVarName", "history").load(f"{tmp_path}/checkpoint-b")
    assert {r["key"]["market"] for r in state.select("key").collect()} <= {"z"}


class Listed:
    """A list state held in memory."""

    def __init__(self, rows=()):
        self.rows = list(rows)

    def get(self):
        return iter(self.rows)

    def exists(self):
        return bool(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []


def test_a_release_of_many_moments_is_not_quadratic():
    rng = random.Random(5)
    rows = [(1000 * i + rng.randrange(1000), i, rng.randrange(50), rng.random(), True) for i in range(40_000)]
    p = PastOnlyProcessor(window=10_000_000, shard=10**12)
    p.handle, p.pending, p.history = SimpleNamespace(registerTimer=lambda ms: None), Listed(rows[5_000:]), Listed(rows[:5_000])
    start = time.process_time()
    (out,) = p.handleExpiredTimer(("m", 0), SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**9), None)
    assert time.process_time() - start < 20
    times = [r[0] for r in rows]
    assert out["id"].tolist() == list(range(5_000, 40_000))
    for r in out.iloc[::3_500].itertuples(index=False):
        seen = rows[bisect_left(times, r.us - 10_000_000) : bisect_left(times, r.us)]
        assert (r.prior_n, r.prior_entities, r.median) == (len(seen), len({s[2] for s in seen}), median(s[3] for s in seen))
