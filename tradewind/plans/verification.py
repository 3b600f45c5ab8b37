"""Result-verification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import epoch_us, tidy
from ..operators import metrics as M
from ..operators import resample as B
from ..operators import temporal as T
from ..operators import verify as V
from ..sources.tables import MODELS, PREDS, TARGETS
from .registry import query
from .resampling import CONTRASTS, SEED, L95, reps, sql_deltas, sql_reps
from .scans import long_preds

t6 = lambda *names: [tidy(F.col(n)).alias(n) for n in names]


def point_table(t):
    return M.score(t.preds, [], "entity", "y", MODELS)


@query("vf1", f"""WITH {PREDS}, {sql_reps('preds', 'entity')}, {sql_deltas('reps', metrics=('rmse',))}, tot AS (SELECT model, count(*) AS n, sqrt(avg(power(y - p, 2))) AS rmse FROM long GROUP BY 1),
c(kind, candidate, reference) AS (VALUES {", ".join(f"('{k}', '{a}', '{b}')" for k, a, b in CONTRASTS)}), j AS (SELECT c.*, a.n, a.rmse AS ra, b.rmse AS rb FROM c JOIN tot a ON a.model = candidate JOIN tot b ON b.model = reference),
i AS (SELECT candidate, reference, quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi FROM deltas GROUP BY ALL),
r AS (SELECT 'count' AS operation, candidate, reference, CAST(n AS DOUBLE) AS v FROM j UNION ALL SELECT 'point', candidate, reference, ra FROM j UNION ALL SELECT 'delta', candidate, reference, ra - rb FROM j
  UNION ALL SELECT 'utility', candidate, reference, 100 * (rb - ra) / rb FROM j UNION ALL SELECT 'interval_low', candidate, reference, lo FROM i UNION ALL SELECT 'interval_high', candidate, reference, hi FROM i)
SELECT operation, candidate, reference, round(v, 6) + 0.0 AS expected, true AS passed FROM r""")
def vf1(t):
    """Count, point, delta, utility and interval cells against expectations from a second route."""
    cells = lambda df, prefix: df.select("candidate", "reference", F.inline(F.array(*[
        F.struct(F.lit(n).alias("operation"), F.col(c).cast("double").alias(prefix)) for n, c in
        [("count", "n"), ("point", "ra"), ("delta", "delta"), ("utility", "utility"), ("interval_low", "lo"), ("interval_high", "hi")]
    ])))
    contrasts = t.spark.createDataFrame([(a, b) for _, a, b in CONTRASTS], "candidate string, reference string")

    def table(point, iv):
        a = point.select(F.col("model").alias("candidate"), "n", F.col("rmse").alias("ra"))
        b = point.select(F.col("model").alias("reference"), F.col("rmse").alias("rb"))
        j = contrasts.join(a, "candidate").join(b, "reference").join(iv, ["candidate", "reference"])
        return j.withColumn("delta", F.col("ra") - F.col("rb")).withColumn("utility", 100 * (F.col("rb") - F.col("ra")) / F.col("rb"))

    changes = B.deltas(reps(t), [], CONTRASTS, ["rmse"])
    iv = B.intervals(changes, ["candidate", "reference"], L95).select("candidate", "reference", F.col("ci95_low").alias("lo"), F.col("ci95_high").alias("hi"))
    # Second route: plain averages over long rows, and order statistics of the sorted replicates.
    sq = (F.col("y") - F.col("p")) ** 2
    point2 = long_preds(t).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(sq)).alias("rmse"))
    ordered = changes.groupBy("candidate", "reference").agg(F.sort_array(F.collect_list("delta")).alias("s"), F.count(F.lit(1)).alias("k"))

    def at(p):
        pos = F.lit(p) * (F.col("k") - 1)
        lo = F.floor(pos).cast("int")
        a, b = F.get("s", lo), F.get("s", F.ceil(pos).cast("int"))
        return a + (b - a) * (pos - lo)

    iv2 = ordered.select("candidate", "reference", at(0.025).alias("lo"), at(0.975).alias("hi"))
    out = V.contract(cells(table(point_table(t), iv), "actual"), cells(table(point2, iv2), "expected"), ["operation", "candidate", "reference"], 1e-10)
    return out.select("operation", "candidate", "reference", tidy(F.col("expected")).alias("expected"), "passed")


@query("vf2", f"""WITH {PREDS} SELECT 'ids_unique' AS "check", count(*) = count(DISTINCT source_row) AS passed FROM preds UNION ALL SELECT 'targets_finite', bool_and(isfinite(y)) FROM preds
UNION ALL SELECT 'baselines_positive', min(baseline) > 0 FROM preds UNION ALL SELECT 'labels_cover_documents', (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) = 0""")
def vf2(t):
    """Named checks as rows; ``require`` turns the first failed one into an error."""
    rows = t.preds
    ids = rows.groupBy("source_row").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("worst"))
    y = F.col("y")
    finite = rows.agg(F.count_if(y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))).alias("bad"))
    positive = t.targets.agg(F.min("baseline").alias("low"))
    uncovered = V.uncovered(t.read("documents"), t.read("labels"), ["doc_id"]).agg(F.count(F.lit(1)).alias("n"))
    return V.checks(("ids_unique", ids, "worst = 1"), ("targets_finite", finite, "bad = 0"), ("baselines_positive", positive, "low > 0"), ("labels_cover_documents", uncovered, "n = 0")).select("check", "passed")


@query("vf3", f"""WITH {PREDS}, tot AS (SELECT market, model, sqrt(avg(power(y - p, 2))) AS rmse FROM long GROUP BY 1, 2)
SELECT a.market, a.model AS candidate, 'delta_is_difference' AS broken FROM tot a JOIN tot b ON b.market = a.market AND b.model = 'zero' WHERE a.model = 'late'""")
def vf3(t):
    """Arithmetic identities on a result table; the late rows carry a planted error and must show."""
    s = M.score(t.preds, ["market"], "entity", "y", MODELS).select("market", F.col("model").alias("candidate"), F.col("rmse").alias("cand"))
    zero = s.filter("candidate = 'zero'").select("market", F.col("cand").alias("ref"))
    planted = F.when(F.col("candidate") == "late", F.lit(1e-6)).otherwise(F.lit(0.0))
    rows = s.join(zero, "market").withColumn("delta", F.col("cand") - F.col("ref") + planted).withColumn("low", F.col("delta") - 0.01).withColumn("high", F.col("delta") + 0.01)
    return V.broken_identities(rows, {"delta_is_difference": "abs(delta - (cand - ref)) <= 1e-10", "low_not_above_high": "low <= high"}, ["market", "candidate"])


@query("vf4", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def vf4(t):
    return V.uncovered(t.read("documents").select("doc_id"), t.read("labels"), ["doc_id"])


@query("vf5", f"""WITH {PREDS} SELECT market, round(sqrt(avg(power(y - p_brand, 2))), 6) AS rmse, true AS agrees FROM preds GROUP BY 1""")
def vf5(t):
    """The metric again with exact decimal sums, compared with the double path."""
    e = F.col("y") - F.col("p_brand")
    out = t.preds.groupBy("market").agg(F.sum(e * e).alias("d"), F.sum((e * e).cast("decimal(28,18)")).alias("x"), F.count(F.lit(1)).alias("n"))
    a, b = F.sqrt(F.col("d") / F.col("n")), F.sqrt(F.col("x").cast("double") / F.col("n"))
    return out.select("market", tidy(a).alias("rmse"), (F.abs(a - b) <= 1e-10).alias("agrees"))


@query("vf6", f"""WITH {PREDS} SELECT market, count(*) AS n, 0::BIGINT AS unmatched, 0.0::DOUBLE AS max_gap, true AS passed FROM preds GROUP BY 1""")
def vf6(t):
    """Archived predictions against recomputed ones, joined by row id."""
    level = t.train.groupBy("market").agg(F.avg("y").alias("m"))
    brand = t.train.groupBy("market", "brand").agg(F.avg("y").alias("b"))
    again = t.evaluation.join(level, "market").join(brand, ["market", "brand"], "left").select("source_row", F.coalesce("b", "m").alias("p_brand"))
    return V.gap(t.preds, again, ["source_row"], "p_brand", ["market"], 1e-10).select("market", "n", "unmatched", *t6("max_gap"), "passed")


@query("vf7", f"""WITH {PREDS} SELECT 'trades' AS stage, (SELECT count(*) FROM lineitem) AS expected, (SELECT count(*) FROM trades) AS actual, true AS passed
UNION ALL SELECT 'evaluation', (SELECT count(*) FROM evaluation), (SELECT count(*) FROM preds), true UNION ALL SELECT 'long', 5 * (SELECT count(*) FROM preds), (SELECT count(*) FROM long), true""")
def vf7(t):
    count = lambda df, stage, name: df.agg(F.lit(stage).alias("stage"), F.count(F.lit(1)).alias(name))
    expected = count(t.read("lineitem"), "trades", "expected").unionByName(count(t.evaluation, "evaluation", "expected")).unionByName(count(t.preds, "long", "expected").withColumn("expected", F.col("expected") * len(MODELS)))
    actual = count(t.trades, "trades", "actual").unionByName(count(t.preds, "evaluation", "actual")).unionByName(count(long_preds(t), "long", "actual"))
    return expected.join(actual, "stage").withColumn("passed", F.col("expected") == F.col("actual"))


@query("vf8", f"""WITH {PREDS}, s AS (SELECT sqrt(avg(power(y - p_emb, 2))) AS a, sqrt(avg(power(y - p_brand, 2))) AS b FROM preds) SELECT 'emb-brand' AS contrast, round(a - b, 6) + 0.0 AS delta, true AS agrees FROM s""")
def vf8(t):
    """The same difference from the score table and from the bootstrap's cluster sums."""
    from .resampling import stats
    s = point_table(t).agg((F.max(F.when(F.col("model") == "emb", F.col("rmse"))) - F.max(F.when(F.col("model") == "brand", F.col("rmse")))).alias("d1"))
    c = stats(t).agg((F.sqrt(F.sum("sse_emb") / F.sum("n")) - F.sqrt(F.sum("sse_brand") / F.sum("n"))).alias("d2"))
    j = s.withColumn("_one", F.lit(1)).join(c.withColumn("_one", F.lit(1)), "_one")
    return j.select(F.lit("emb-brand").alias("contrast"), tidy(F.col("d1")).alias("delta"), (F.abs(F.col("d1") - F.col("d2")) <= 1e-10).alias("agrees"))


@query("vf9", """WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT user_id, bool_and(coalesce(p <= ts, true)) AS ordered, count(*) AS n_steps FROM l GROUP BY 1""")
def vf9(t):
    """Steps of a run never go back in time; long runs are cut into slices of step numbers."""
    e = t.read("events").select("user_id", F.col("event_id").alias("step"), epoch_us(F.col("ts")).alias("at"))
    lagged = T.carried_lag(e, ["user_id"], "step", [], ["at"], 100_000)
    return lagged.groupBy("user_id").agg(F.bool_and(F.coalesce(F.col("prev_at") <= F.col("at"), F.lit(True))).alias("ordered"), F.count(F.lit(1)).alias("n_steps"))


@query("vf10", f"""WITH {PREDS} SELECT market, count(*) AS n, count(*) - count(DISTINCT source_row) AS repeated_ids, min(us) AS first_us, max(us) AS last_us, count(*) FILTER (WHERE brand IS NULL) AS missing_traits,
  count(*) = count(DISTINCT source_row) AND min(us) >= 946684800000000 AND max(us) < 996710400000000 AND count(*) FILTER (WHERE brand IS NULL) = 0 AND count(*) > 0 AS passed FROM preds GROUP BY 1""")
def vf10(t):
    per = t.preds.groupBy("market", "source_row").agg(F.count(F.lit(1)).alias("c"), F.min("us").alias("a"), F.max("us").alias("b"), F.count_if(F.col("brand").isNull()).alias("m"))
    out = per.groupBy("market").agg(
        F.sum("c").alias("n"), (F.sum("c") - F.count(F.lit(1))).alias("repeated_ids"), F.min("a").alias("first_us"), F.max("b").alias("last_us"), F.sum("m").alias("missing_traits")
    )
    ok = (F.col("repeated_ids") == 0) & (F.col("first_us") >= 946_684_800_000_000) & (F.col("last_us") < 996_710_400_000_000) & (F.col("missing_traits") == 0) & (F.col("n") > 0)
    return out.withColumn("passed", ok)
