import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tradewind.functions.ranking import dense_index, exact_quantiles

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SLOW
@given(st.lists(st.sampled_from([0.0, 1.0, 1.5, 2.0, 3.25, -4.0, 100.0]), min_size=1, max_size=60))
def test_quantiles_with_ties(spark, values):
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    row = exact_quantiles(df, ["g"], "v", {"a": 0.01, "m": 0.5, "z": 0.975}).first()
    assert np.allclose([row["a"], row["m"], row["z"]], np.percentile(values, [1, 50, 97.5]))


def test_quantiles_coarse_sketch_stays_exact(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([np.repeat(5.0, 1500), rng.lognormal(size=3000)])
    df = spark.createDataFrame([(float(v),) for v in rng.permutation(values)], "v double").repartition(7)
    row = exact_quantiles(df, [], "v", {"lo": 0.02, "m": 0.5, "hi": 0.99}, accuracy=100).first()
    assert np.allclose([row["lo"], row["m"], row["hi"]], np.percentile(values, [2, 50, 99]), rtol=1e-12)


def test_nearest_rank_rounds_half_to_even(spark):
    df = spark.createDataFrame([(float(v),) for v in range(6)], "v double")
    assert exact_quantiles(df, [], "v", {"m": 0.5}, nearest=True).first()["m"] == 2.0


@pytest.mark.parametrize("hot", [False, True])
def test_dense_index_is_a_rank(spark, hot):
    rng = np.random.default_rng(1)
    keys = [7 if hot and i % 3 else int(k) for i, k in enumerate(rng.integers(0, 50, 400))]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k bigint, id bigint").repartition(5)
    got = dense_index(df, "k", "id", "r", buckets=8).collect()
    assert sorted(x["r"] for x in got) == list(range(400))
    ordered = [x["k"] for x in sorted(got, key=lambda x: x["r"])]
    assert ordered == sorted(keys)


def test_dense_index_restarts_per_group(spark):
    df = spark.createDataFrame([(g, i) for g in "ab" for i in range(9)], "g string, id bigint")
    got = dense_index(df, "id", "id", "r", by=["g"]).collect()
    assert all(x["r"] == x["id"] for x in got)


@pytest.mark.parametrize("kind, keys", [("double", [2.5, None, float("nan"), float("inf"), -1.0, float("-inf"), 2.5, None, 0.0] * 5), ("string", ["b", None, "a", "aaaaaaab", "aaaaaaaa", "", "é", "z"] * 5)])
def test_dense_index_orders_nulls_nan_and_text(spark, kind, keys):
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"k {kind}, id bigint").repartition(3)
    got = [r["k"] for r in sorted(dense_index(df, "k", "id", "r", buckets=6).collect(), key=lambda r: r["r"])]
    assert list(map(repr, got)) == [repr(r["k"]) for r in df.orderBy("k").collect()]


def test_rows_are_not_shuffled_to_meet_few_brackets(spark):
    rows = spark.range(3000).select(F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("g"), (F.col("id") * 37 % 1000).cast("double").alias("v"))
    found = exact_quantiles(rows, ["g"], "v", {"low": 0.1, "mid": 0.5}, accuracy=100)
    joins = [line for line in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins)
    got = {r["g"]: (r["low"], r["mid"]) for r in found.collect()}
    for k in range(3):
        values = np.array([i * 37 % 1000 for i in range(3000) if i % 3 == k], dtype=float)
        assert np.allclose(got[f"g{k}"], np.percentile(values, [10, 50]))


def test_those_where_keeps_order_and_leaves_out_nulls(spark):
    from tradewind.functions.scalars import names_where

    rows = spark.sql("SELECT * FROM VALUES (1), (2), (CAST(NULL AS INT)) v(x)")
    got = {r["x"]: r["n"] for r in rows.select("x", names_where({"all": F.lit(True), "big": F.col("x") > 1, "known": F.col("x").isNotNull()}).alias("n")).collect()}
    assert got == {1: ["all", "known"], 2: ["all", "big", "known"], None: ["all"]}
