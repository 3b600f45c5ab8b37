import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.operators import metrics as M
from tradewind.operators import resample as B
from tradewind.operators import select as S

RNG = np.random.default_rng(4)
ENT = RNG.choice(37, 500, p=np.r_[0.34, np.repeat(0.66 / 36, 36)])
Y = RNG.normal(size=500)
PA, PB = Y * 0.5 + RNG.normal(size=500) * 0.2, np.zeros(500)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(int(e), float(y), float(a), float(b)) for e, y, a, b in zip(ENT, Y, PA, PB)], "entity bigint, y double, p_a double, p_b double").repartition(5)


def picks(seed, draw, g):
    out = []
    for s in range(g):
        h = hashlib.md5(f"{seed}:{draw}:{s // 4}".encode()).hexdigest()
        out.append(int(h[8 * (s % 4):8 * (s % 4) + 8], 16) % g)
    return out


def test_replicates_match_row_expansion(spark, rows):
    s = B.cluster_stats(rows, [], "entity", "y", ["a", "b"])
    slots = B.draw_slots(s, [], 5, 9)
    got = {r["draw"]: r for r in B.replicates(s, slots, [], ["a", "b"]).collect()}
    ids = sorted(set(ENT.tolist()))
    for d in range(5):
        chosen = picks(9, d, len(ids))
        rowsel = np.concatenate([np.flatnonzero(ENT == ids[i]) for i in chosen])
        assert np.isclose(got[d]["rmse_a"], np.sqrt(np.mean((Y[rowsel] - PA[rowsel]) ** 2)), atol=1e-12)
        means = [np.mean((Y[ENT == ids[i]] - PA[ENT == ids[i]]) ** 2) for i in chosen]
        assert np.isclose(got[d]["entity_rmse_a"], np.sqrt(np.mean(means)), atol=1e-12)
    direct = {r["draw"]: r["direct_b"] for r in B.row_expansion(rows, s, slots, [], "entity", "y", ["b"], 3).collect()}
    assert set(direct) == {0, 1, 2} and all(np.isclose(direct[d], got[d]["rmse_b"], atol=1e-12) for d in direct)


def test_intervals_and_p_values(spark):
    delta = RNG.normal(size=200) - 0.5
    df = spark.createDataFrame([(i, float(v), float(-100 * v)) for i, v in enumerate(delta)], "draw bigint, delta double, improvement double").withColumn("k", F.lit("x"))
    iv = B.intervals(df, ["k"], {"95": 95.0, "99375": 99.375}).first()
    assert np.allclose([iv["ci95_low"], iv["ci95_high"]], np.percentile(delta, [2.5, 97.5]))
    assert np.allclose([iv["ci99375_low"], iv["ci99375_high"]], np.percentile(delta, [0.3125, 99.6875]))
    assert np.isclose(iv["share_better"], (delta < 0).mean())
    p = B.empirical_p(df, ["k"]).first()
    want = min(1.0, 2 * (min((delta <= 0).sum(), (delta >= 0).sum()) + 1) / 201)
    assert np.isclose(p["p_value"], want) and np.isclose(p["p_adjusted"], min(1, 2 * want))


def test_scores_and_recombination(spark, rows):
    got = {r["model"]: r for r in M.score(rows, [], "entity", "y", ["a", "b"]).collect()}
    for m, p in (("a", PA), ("b", PB)):
        e = Y - p
        assert np.isclose(got[m]["rmse"], np.sqrt(np.mean(e**2))) and np.isclose(got[m]["mae"], np.mean(np.abs(e)))
        assert np.isclose(got[m]["r2"], 1 - (e**2).sum() / ((Y - Y.mean()) ** 2).sum())
        assert np.isclose(got[m]["entity_rmse"], np.sqrt(np.mean([np.mean(e[ENT == k] ** 2) for k in set(ENT.tolist())])))
    flat = rows.withColumn("y", F.lit(2.0))
    assert all(r["r2"] is None for r in M.score(flat, [], "entity", "y", ["a"]).collect())


def test_sequential_tolerance(spark):
    # b ties with a within 1e-12 and is simpler, c ties with b's error but not with a's.
    scores = [("f", "a", 1.0, 3.0), ("f", "b", 1.0 + 8e-13, 2.0), ("f", "c", 1.0 + 16e-13, 1.0), ("f", "d", 2.0, 0.0)]
    df = spark.createDataFrame(scores, "family string, name string, mse double, simple double")
    got = {r["name"]: r["rank"] for r in S.ordered_choices(df, ["family"], "mse", ["simple"]).collect()}
    assert got == {"b": 1, "a": 2, "c": 3, "d": 4}


def test_failed_fits_have_no_place(spark):
    scores = [("f", "a", None, 0.0), ("f", "b", 2.0, 1.0), ("f", "c", float("nan"), 0.0), ("f", "d", 1.0, 5.0), ("g", "e", None, 0.0)]
    df = spark.createDataFrame(scores, "family string, name string, mse double, simple double")
    got = {r["name"]: r["rank"] for r in S.ordered_choices(df, ["family"], "mse", ["simple"]).collect()}
    assert got == {"d": 1, "b": 2}


def test_order_follows_the_rule_step_by_step(spark):
    rng = np.random.default_rng(4)
    rows = [("f", str(i), 1.0 + int(rng.integers(0, 12)) * 4e-13, float(rng.integers(0, 5)) + i / 1000) for i in range(60)]
    df = spark.createDataFrame(rows, "family string, name string, mse double, simple double")
    left, want = list(rows), []
    while left:
        least = min(r[2] for r in left)
        want.append(min((r for r in left if r[2] <= least + 1e-12), key=lambda r: r[3]))
        left.remove(want[-1])
    got = sorted(S.ordered_choices(df, ["family"], "mse", ["simple"]).collect(), key=lambda r: r["rank"])
    assert [r["name"] for r in got] == [r[1] for r in want]


def test_zero_reference_gives_no_improvement(spark):
    reps = spark.createDataFrame([(0, 0.0, 1.0)], "draw bigint, rmse_a double, rmse_b double")
    row = B.deltas(reps, [], [("k", "b", "a")], ["rmse"]).first()
    assert row["delta"] == 1.0 and row["improvement"] is None


def test_late_weight_rules(spark):
    y, a, b = Y, PA, Y * 0.9
    df = spark.createDataFrame([("m", float(u), float(v), float(w)) for u, v, w in zip(y, a, b)], "g string, y double, a double, b double")
    grid = S.blend_scores(S.blend_sums(df, ["g"], "y", "a", "b"), [i / 10 for i in range(11)])
    direct = [np.mean((y - ((1 - w / 10) * a + w / 10 * b)) ** 2) for w in range(11)]
    got = {round(r["weight"], 1): r["mse"] for r in grid.collect()}
    assert np.allclose([got[w / 10] for w in range(11)], direct)
    assert S.late_weight(grid, ["g"]).first()["weight"] == int(np.argmin(direct)) / 10


def test_fold_roles_are_half_open(spark):
    df = spark.createDataFrame([("1999-03-31",), ("1999-04-01",), ("1999-07-01",)], "d string").withColumn("ts", F.col("d").cast("timestamp_ntz"))
    got = {r["d"]: [(x["fold"], x["role"]) for x in r["f"]] for r in df.withColumn("f", S.fold_roles(F.col("ts"), [("q", "1999-01-01", "1999-04-01", "1999-07-01")])).collect()}
    assert got == {"1999-03-31": [("q", "train")], "1999-04-01": [("q", "valid")], "1999-07-01": []}
    assert S.inner_quarters("D", "1997-01-01", "2000-01-01")[-1] == ("D/2", "1997-01-01", "1999-10-01", "2000-01-01")


def test_bootstrap_equals_slot_rows_in_any_blocks(spark, rows):
    grouped = rows.withColumn("half", F.col("entity") % 2)
    stats = B.cluster_stats(grouped, ["half"], "entity", "y", ["a", "b"])
    stats = stats.withColumn("sse_b", F.when(F.col("idx") != 1, F.col("sse_b")))
    want = {(r["half"], r["draw"]): r for r in B.replicates(stats, B.draw_slots(stats, ["half"], 7, 5), ["half"], ["a", "b"]).collect()}
    for limits in ({}, {"block_clusters": 3, "task_slots": 1}):
        got = {(r["half"], r["draw"]): r for r in B.bootstrap(stats, ["half"], ["a", "b"], 7, 5, **limits).collect()}
        assert set(got) == set(want) and len(want) == 14
        for k, r in want.items():
            for c in ("rmse_a", "rmse_b", "entity_rmse_a", "entity_rmse_b"):
                assert (r[c] is None and got[k][c] is None) or abs(r[c] - got[k][c]) < 1e-12
    assert B.bootstrap(stats.limit(0), ["half"], ["a"], 3, 5).count() == 0


def test_bootstrap_hands_no_arrow_batch_of_blocks_to_a_worker(spark, rows):
    stats = B.cluster_stats(rows, [], "entity", "y", ["a", "b"])
    plan = B.bootstrap(stats, [], ["a", "b"], 7, 5, block_clusters=4)._jdf.queryExecution().optimizedPlan().toString()
    assert "InPandas" not in plan and "InArrow" not in plan


@pytest.mark.parametrize("count", [1, 6, 256, 257, 1003, 10_007, 40_000])
def test_numbered_digests_are_md5(count):
    from tradewind.functions.md5 import numbered_digests

    heads = [b"1729:%d:" % d for d in (0, 7, 10, 1999)] + [b"-3:123456:", b""]
    for head, words in zip(heads, numbered_digests(heads, count), strict=True):
        want = b"".join(hashlib.md5(head + b"%d" % i).digest() for i in range(count))
        assert np.stack(words, axis=1).astype(">u4").tobytes() == want


def test_a_draw_is_made_once_however_many_blocks(spark, rows, monkeypatch):
    times = [t.tolist() for t in B.times_drawn(1030, 3, 5, 9)]
    assert times == [np.bincount(picks(9, d, 1030), minlength=1030).tolist() for d in (3, 4)]
    heads = spark.sparkContext.accumulator(0)
    made = B.times_drawn

    def counted(g, low, high, seed):
        heads.add(high - low)
        return made(g, low, high, seed)

    monkeypatch.setattr(B, "times_drawn", counted)
    stats = B.cluster_stats(rows, [], "entity", "y", ["a", "b"])
    assert B.bootstrap(stats, [], ["a", "b"], 30, 5, block_clusters=2).count() == 30 and heads.value == 30


def test_sums_are_not_shuffled_for_the_draws(spark, rows):
    stats = B.cluster_stats(rows, [], "entity", "y", ["a", "b"])
    found = B.bootstrap(stats, [], ["a", "b"], 30, 5)
    assert "shuffle" not in found.rdd.toDebugString().decode().lower()
