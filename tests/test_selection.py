import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.operators import gram as G
from tradewind.operators import models as L
from tradewind.operators import select as S
from tradewind.session import fresh_path

RANKING = "g string, candidate bigint, rank bigint"


def ranking(spark, lengths):
    return spark.createDataFrame([(g, 10 * r, r) for g, n in lengths.items() for r in range(1, n + 1)], RANKING)


def test_only_groups_whose_rank_failed_are_fitted_again(spark):
    """Group a takes its first, b its third; c has no valid candidate and is left out."""
    first_valid, asked = {"a": 1, "b": 3, "c": 99}, []

    def refit(turn):
        rows = turn.collect()
        asked.append(sorted((r.g, r["rank"]) for r in rows))
        return spark.createDataFrame([(r.g, r.candidate, r["rank"] >= first_valid[r.g], f"fit {r.candidate}") for r in rows], "g string, candidate bigint, valid boolean, fit string")

    got = S.fall_through(ranking(spark, {"a": 4, "b": 4, "c": 2}), ["g"], "candidate", refit).collect()
    assert sorted((r.g, r.candidate, r["rank"], r.fit) for r in got) == [("a", 10, 1, "fit 10"), ("b", 30, 3, "fit 30")]
    assert asked == [[("a", 1), ("b", 1), ("c", 1)], [("b", 2), ("c", 2)], [("b", 3)]]


def test_fall_through_of_nothing_is_nothing(spark):
    refit = lambda turn: turn.select("g", "candidate", F.lit(True).alias("valid"))
    assert S.fall_through(spark.createDataFrame([], RANKING), ["g"], "candidate", refit).collect() == []


def test_planted_deficient_candidate_falls_through(spark):
    """Two components of the columns (x1, 2 * x1) do not exist, so the fit of both columns is taken, with the coefficients of least squares."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 2))
    y = x @ [0.4, -0.7] + rng.normal(size=50) * 0.1
    rows = spark.createDataFrame([("m", [float(a), float(b), float(2 * a)], 1.0, float(v), float(v * v)) for (a, b), v in zip(x, y)], "market string, x array<double>, n double, sy double, syy double")
    grams = G.accumulate(rows, ["market"])
    offered = {1: [0, 2], 2: [0, 1]}
    ranked = spark.createDataFrame([("m", c, c) for c in offered], "market string, candidate bigint, rank bigint")
    choice = spark.createDataFrame([("m", c, "pls", '{"components": 2}', use) for c, use in offered.items()], "market string, candidate bigint, family string, config string, columns array<int>")
    refit = lambda turn: L.fit_choices(grams, choice.join(turn.select("market", "candidate"), ["market", "candidate"], "left_semi"), ["market"])
    assert [r.reason for r in refit(ranked.filter("rank = 1")).collect()] == ["1 of 2 components"]
    (got,) = S.fall_through(ranked, ["market"], "candidate", refit).collect()
    plain = np.linalg.lstsq(np.column_stack([np.ones(50), x]), y, rcond=None)[0]
    assert got["rank"] == 2
    np.testing.assert_allclose([got.intercept, *got.coef], [*plain, 0.0], atol=1e-9)


def test_evaluation_is_not_read_before_the_freeze_or_after_an_edit(spark):
    choices = spark.createDataFrame([("a", 1), ("b", None)], "market string, config int")
    path, reads = fresh_path(spark, "frozen"), []

    def read():
        reads.append(1)
        return spark.range(3)

    with pytest.raises(S.NotFrozen):
        S.read_after_freeze(spark, path, read)
    # A table without a manifest was written by hand, not frozen.
    loose = fresh_path(spark, "loose")
    choices.write.parquet(loose)
    with pytest.raises(S.NotFrozen):
        S.read_after_freeze(spark, loose, read)
    S.freeze(choices, path)
    frozen, rows = S.read_after_freeze(spark, path, read)
    assert (sorted(map(tuple, frozen.collect())), rows.count(), len(reads)) == ([("a", 1), ("b", None)], 3, 1)
    spark.createDataFrame([("c", 1)], "market string, config int").write.mode("append").parquet(path)
    with pytest.raises(S.NotFrozen):
        S.read_after_freeze(spark, path, read)
    assert len(reads) == 1


def test_digest_sees_values_and_repeats_but_no_order(spark):
    one = lambda rows: tuple(S.digest(spark.createDataFrame(rows, "a int, b string")).first())
    assert one([(1, "x"), (2, None)]) == one([(2, None), (1, "x")])
    assert len({one([(1, "x"), (2, None)]), one([(1, "x"), (2, "")]), one([(1, "x"), (2, None), (2, None)]), one([(1, "x")])}) == 4
    assert one([])[0] == 0


def test_grams_before_each_quarter_are_those_of_its_earlier_rows(spark):
    rng = np.random.default_rng(8)
    data = [(k, f"Q{q}", [float(v) for v in rng.normal(size=3)], 1.0, float(y := rng.normal()), float(y * y)) for k in ("a", "b") for q in (1, 2, 4) for _ in range(6)]
    rows = spark.createDataFrame(data, "k string, quarter string, x array<double>, n double, sy double, syy double")
    got = {(r.k, r.quarter, r.i): r for r in G.before(G.accumulate(rows, ["k", "quarter"]), ["k"], "quarter").collect()}
    assert {(k, q) for k, q, _ in got} == {(k, q) for k in ("a", "b") for q in ("Q2", "Q4")}
    for (k, q) in {(k, q) for k, q, _ in got}:
        plain = G.accumulate(rows.filter((F.col("k") == k) & (F.col("quarter") < q)), ["k"]).collect()
        for r in plain:
            np.testing.assert_allclose([*got[k, q, r.i].g, got[k, q, r.i].b, got[k, q, r.i].c], [*r.g, r.b, r.c], atol=1e-12)
