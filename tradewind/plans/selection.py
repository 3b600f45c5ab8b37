"""Temporal validation and selection queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import in_window, moment, names_where, tidy
from ..operators import gram as G
from ..operators import metrics as M
from ..operators import models as L
from ..operators import select as S
from ..session import fresh_path
from ..sources.tables import ALPHAS, FEATURES, FOLD_CTES, FOLDS, MODELS, PREDS, SCORES, TARGETS
from .features import entities
from .joins import WINNERS, condition_winners
from .models import LINE_SQL, X2, centred_sql, ridge_sql, small, small_grams
from .registry import query
from .scans import CONDITION_WHERE, CONDITIONS_SQL, conditions

t6 = lambda *names: [tidy(F.col(n)).alias(n) for n in names]
ORDER_SQL = "CASE feature WHEN 'brand' THEN 0 WHEN 'size' THEN 1 WHEN 'word' THEN 2 ELSE 3 END"


def feature_order():
    return F.array_position(F.array(*[F.lit(f) for f in FEATURES]), F.col("feature"))


@query("sel1", f"""WITH {FOLD_CTES} SELECT fold, role, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM fold_rows GROUP BY 1, 2""")
def sel1(t):
    """Expanding folds from time predicates evaluated in one scan."""
    rows = t.targets.withColumn("_f", F.explode(S.fold_roles(F.col("ts"), FOLDS)))
    return rows.groupBy("_f.fold", "_f.role").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


OUTER = (("D1", "1999-01-01"), ("D2", "1999-07-01"), ("D3", "2000-01-01"))


@query("sel2", f"""WITH {TARGETS}, outer_f(parent, origin) AS (VALUES ('D1', TIMESTAMP '1999-01-01'), ('D2', TIMESTAMP '1999-07-01'), ('D3', TIMESTAMP '2000-01-01')),
inner_f AS (SELECT parent, k AS inner_no, origin - INTERVAL 3 MONTH * (3 - k) AS a, origin - INTERVAL 3 MONTH * (2 - k) AS b FROM outer_f CROSS JOIN (VALUES (0), (1), (2)) v(k))
SELECT parent, CAST(inner_no AS BIGINT) AS inner_no, CASE WHEN t.ts < a THEN 'train' ELSE 'valid' END AS role, count(*) AS n, count(DISTINCT entity) AS n_entities
FROM targets t JOIN inner_f ON t.ts >= TIMESTAMP '1997-01-01' AND t.ts < b GROUP BY 1, 2, 3""")
def sel2(t):
    """Outer folds, each with its last three quarters as inner folds."""
    folds = [f for name, origin in OUTER for f in S.inner_quarters(name, "1997-01-01", origin)]
    rows = t.targets.withColumn("_f", F.explode(S.fold_roles(F.col("ts"), folds)))
    per = rows.groupBy("_f.fold", "_f.role", "entity").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("fold", "role").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_entities"))
    return out.select(F.split_part("fold", F.lit("/"), F.lit(1)).alias("parent"), F.split_part("fold", F.lit("/"), F.lit(2)).cast("bigint").alias("inner_no"), "role", "n", "n_entities")


@query("sel3", f"""WITH {FOLD_CTES} SELECT fold, count(*) FILTER (WHERE role = 'train') AS n_train, count(*) FILTER (WHERE role = 'valid') AS n_valid,
  count(*) FILTER (WHERE role = 'train') >= 200 AND count(*) FILTER (WHERE role = 'valid') >= 200 AND count(DISTINCT entity) FILTER (WHERE role = 'train') >= 100 AND count(DISTINCT entity) FILTER (WHERE role = 'valid') >= 100 AS supported,
  max(us) FILTER (WHERE role = 'train') < min(us) FILTER (WHERE role = 'valid') AS ordered FROM fold_rows GROUP BY 1""")
def sel3(t):
    return S.fold_support(t.fold_rows, "fold", "role", "entity", "us", 200, 100)


@query("sel4", f"""WITH {FOLD_CTES}, {CONDITIONS_SQL}, c AS (SELECT condition, fold, entity, y FROM fold_rows CROSS JOIN cond WHERE role = 'train' AND {CONDITION_WHERE}),
m AS (SELECT condition, fold, quantile_cont(y, 0.5) AS med FROM c GROUP BY 1, 2)
SELECT c.condition, c.fold, count(*) AS n, count(DISTINCT entity) AS n_entities, round(any_value(med), 6) + 0.0 AS center, round(quantile_cont(abs(y - med), 0.5) / 0.6744897501960817, 6) AS scale
FROM c JOIN m ON m.condition = c.condition AND m.fold = c.fold GROUP BY 1, 2""")
def sel4(t):
    """Cohort audit per cleaning condition and fold with the robust target scale."""
    from ..operators.features import robust_parameters
    rows = t.targets.withColumn("_f", F.explode(S.fold_roles(F.col("ts"), FOLDS))).filter("_f.role = 'train'")
    rows = rows.withColumn("fold", F.col("_f.fold")).withColumn("condition", F.explode(names_where(conditions()))).select("condition", "fold", "entity", "y")
    per = rows.groupBy("condition", "fold", "entity").agg(F.count(F.lit(1)).alias("n"))
    n = per.groupBy("condition", "fold").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_entities"))
    return n.join(robust_parameters(rows, ["condition", "fold"], "y"), ["condition", "fold"]).select("condition", "fold", "n", "n_entities", *t6("center", "scale"))


@query("sel5", f"""WITH {SCORES} SELECT market, feature, config, round(mse, 6) AS mse FROM (SELECT *, row_number() OVER (PARTITION BY market, feature ORDER BY mse, -alpha) AS rn FROM pooled) WHERE rn = 1""")
def sel5(t):
    out = S.ordered_choices(t.pooled.withColumn("simple", -F.col("alpha")), ["market", "feature"], "mse", ["simple"]).filter("rank = 1")
    return out.select("market", "feature", "config", F.round("mse", 6).alias("mse"))


@query("sel6", f"""WITH {SCORES} SELECT market, feature, config, row_number() OVER (PARTITION BY market, feature ORDER BY mse, alpha, config) AS rank FROM pooled""")
def sel6(t):
    return S.grid_rounded_choices(t.pooled, ["market", "feature"], "mse", ["alpha", "config"]).select("market", "feature", "config", "rank")


@query("sel7", f"""WITH {SCORES}, f AS (SELECT market, feature, min(mse) AS mse FROM pooled GROUP BY 1, 2), m AS (SELECT market, min(mse) AS low FROM f GROUP BY 1)
SELECT market, feature, round(mse, 6) AS mse FROM (SELECT f.*, row_number() OVER (PARTITION BY f.market ORDER BY {ORDER_SQL}) AS rn FROM f JOIN m ON m.market = f.market WHERE f.mse <= low + 1e-12) WHERE rn = 1""")
def sel7(t):
    f = t.pooled.groupBy("market", "feature").agg(F.min("mse").alias("mse")).withColumn("_ord", feature_order())
    return S.first_within(f, ["market"], "mse", "_ord").select("market", "feature", F.round("mse", 6).alias("mse"))


@query("sel8", f"""WITH {SCORES} SELECT market, feature, config, round(mse, 6) AS mse FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY mse, {ORDER_SQL}, config) AS rn FROM pooled) WHERE rn = 1""")
def sel8(t):
    out = S.best(t.pooled.withColumn("_ord", feature_order()), ["market"], [F.col("mse"), F.col("_ord"), F.col("config")])
    return out.select("market", "feature", "config", F.round("mse", 6).alias("mse"))


WEIGHTS = [i / 10 for i in range(11)]
LATE_SQL = """fp AS (SELECT market, fold, source_row, any_value(y) AS y, max(p) FILTER (WHERE feature = 'brand') AS a, max(p) FILTER (WHERE feature = 'emb') AS b FROM fold_preds WHERE config = 2 GROUP BY 1, 2, 3),
grid AS (SELECT market, CAST(i / 10.0 AS DOUBLE) AS weight, count(*) AS n, round(avg(power(y - ((1 - i / 10.0::DOUBLE) * a + i / 10.0::DOUBLE * b), 2)), 9) AS mse FROM fp CROSS JOIN range(11) r(i) GROUP BY 1, 2)"""


def late_sums(t, by):
    """Metadata-like (brand) and image-like (embedding label) predictions side by side, then summed."""
    side = lambda f, name: t.fold_preds.filter((F.col("feature") == f)).select("market", "fold", "source_row", "y", F.col("p2").alias(name))
    rows = side("brand", "a").join(side("emb", "b").drop("y", "market"), ["fold", "source_row"])
    return S.blend_sums(rows, by, "y", "a", "b")


@query("sel9", f"""WITH {SCORES}, {LATE_SQL} SELECT market, weight, n, round(mse, 6) AS mse FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY mse, weight) AS rn FROM grid) WHERE rn = 1""")
def sel9(t):
    grid = S.blend_scores(late_sums(t, ["market"]), WEIGHTS, 9)
    return S.late_weight(grid, ["market"]).select("market", "weight", "n", F.round("mse", 6).alias("mse"))


@query("sel10", f"""WITH {SCORES}, {LATE_SQL}, m AS (SELECT market, min(mse) AS low FROM grid GROUP BY 1)
SELECT g.market, min(weight) AS weight FROM grid g JOIN m ON m.market = g.market WHERE mse <= low + 1e-12 GROUP BY 1""")
def sel10(t):
    grid = S.blend_scores(late_sums(t, ["market"]), WEIGHTS, 9)
    return S.late_weight(grid, ["market"], "smallest").select("market", "weight")


# Candidates of the fall-through: components asked for and the columns of (x1, x2, 2 * x1) they are taken
# from. Candidates 2 and 4 are planted: they ask for more components than their columns have rank.
CANDIDATES = [(1, [0, 1]), (2, [0, 1]), (2, [0, 2]), (1, [0]), (2, [1]), (1, [1])]

_ONE = "(w1 * t1 + w2 * t2) / (w1 * w1 * s11 + 2 * w1 * w2 * s12 + w2 * w2 * s22)"
_DET = "(s11 * s22 - s12 * s12)"


def betas_sql(moments: str) -> str:
    """Coefficients of all candidates in closed form from centred moments of (x1, x2, y)."""
    return f"""SELECT *, CASE candidate WHEN 0 THEN w1 * {_ONE} WHEN 1 THEN (t1 * s22 - s12 * t2) / {_DET} WHEN 2 THEN t1 / s11 WHEN 3 THEN t1 / s11 ELSE 0.0::DOUBLE END AS b1,
  CASE candidate WHEN 0 THEN w2 * {_ONE} WHEN 1 THEN (s11 * t2 - s12 * t1) / {_DET} WHEN 4 THEN t2 / s22 WHEN 5 THEN t2 / s22 ELSE 0.0::DOUBLE END AS b2
  FROM (SELECT *, t1 / sqrt(t1 * t1 + t2 * t2) AS w1, t2 / sqrt(t1 * t1 + t2 * t2) AS w2 FROM {moments}) CROSS JOIN (VALUES (0::BIGINT, 1), (1, 2), (2, 2), (3, 1), (4, 2), (5, 1)) c(candidate, components)"""


MOMENTS = "avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, covar_pop(x1, x1) AS s11, covar_pop(x1, x2) AS s12, covar_pop(x2, x2) AS s22, covar_pop(x1, y) AS t1, covar_pop(x2, y) AS t2"


@query("sel11", f"""WITH {FOLD_CTES}, {X2}, fm AS (SELECT market, fold, {MOMENTS} FROM fold_rows JOIN px USING (entity) WHERE role = 'train' GROUP BY 1, 2), fb AS ({betas_sql('fm')}),
tm AS (SELECT market, {MOMENTS} FROM train JOIN px USING (entity) GROUP BY 1), tb AS ({betas_sql('tm')}),
err AS (SELECT r.market, candidate, round(avg(power(r.y - (my + (x1 - m1) * b1 + (x2 - m2) * b2), 2)), 9) AS mse FROM fold_rows r JOIN px USING (entity) JOIN fb ON fb.market = r.market AND fb.fold = r.fold WHERE role = 'valid' GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY mse, candidate) AS rank FROM err),
ok AS (SELECT market, candidate, rank, mse, b1, b2, my - m1 * b1 - m2 * b2 AS intercept, row_number() OVER (PARTITION BY market ORDER BY rank) AS k FROM ranked JOIN tb USING (market, candidate)
  WHERE components <= CASE WHEN candidate < 2 AND {_DET} > 1e-9 * s11 * s22 THEN 2 ELSE 1 END)
SELECT market, candidate, rank, round(mse, 6) AS mse, round(b1, 6) + 0.0 AS b1, round(b2, 6) + 0.0 AS b2, round(intercept, 6) + 0.0 AS intercept FROM ok WHERE k = 1""")
def sel11(t):
    """Candidates ranked by their errors on the folds; a final fit that lacks components gives way to the next rank, which is fitted then."""
    vec = t.stage("sel11_vectors", lambda: entities(t).select("entity", F.array("x1", "x2", 2 * F.col("x1")).alias("x")))
    offered = F.explode(F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("candidate"), F.lit("pls").alias("family"), F.lit(f'{{"components": {k}}}').alias("config"), F.array(*map(F.lit, use)).alias("columns"))
        for i, (k, use) in enumerate(CANDIDATES)
    ]))
    grams = lambda rows, by: G.accumulate(G.entity_targets(rows, by, "entity", "y").join(vec, "entity"), by)
    on_folds = t.stage("sel11_folds", lambda: grams(t.fold_rows.filter("role = 'train'"), ["market", "fold"]))
    every = on_folds.select("market", "fold").distinct().select("market", "fold", offered.alias("o")).select("market", "fold", "o.*")
    fits = L.fit_choices(on_folds, every, ["market", "fold"]).select("market", "fold", F.lit("pls").alias("family"), F.col("candidate").alias("config_index"), "coef", "intercept")
    sums = G.entity_targets(t.fold_rows.filter("role = 'valid'"), ["market", "fold"], "entity", "y")
    scored, p = L.predict(sums.join(vec, "entity"), fits, ["market", "fold"]), F.col("p")
    errors = scored.groupBy("market", F.col("config_index").alias("candidate")).agg(F.round(F.sum(F.col("n") * p * p - 2 * p * F.col("sy") + F.col("syy")) / F.sum("n"), 9).alias("mse"))
    ranked = errors.withColumn("rank", F.row_number().over(W.partitionBy("market").orderBy("mse", "candidate")).cast("bigint"))
    frozen = S.freeze(ranked, fresh_path(t.spark, "ranking"))
    on_train = t.stage("sel11_train", lambda: grams(t.train, ["market"]))
    choices = lambda turn: turn.select("market", "candidate", offered.alias("o")).filter("o.candidate = candidate").select("market", "o.*")
    out = S.fall_through(frozen, ["market"], "candidate", lambda turn: L.fit_choices(on_train, choices(turn), ["market"]))
    out = out.join(frozen.select("market", "candidate", "mse"), ["market", "candidate"])
    return out.select("market", "candidate", "rank", F.round("mse", 6).alias("mse"), tidy(F.col("coef")[0]).alias("b1"), tidy(F.col("coef")[1]).alias("b2"), tidy(F.col("intercept")).alias("intercept"))


@query("sel12", f"""WITH {SCORES}, w AS (SELECT market, feature, config, alpha FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY mse, feature, config) AS rn FROM pooled) WHERE rn = 1),
chosen AS (SELECT t.market, t.ts, t.y, w.feature, w.config, w.alpha, coalesce(CASE w.feature WHEN 'brand' THEN brand WHEN 'size' THEN CAST(size_band AS VARCHAR) WHEN 'word' THEN word1 ELSE CAST(e.label AS VARCHAR) END, '?') AS value
  FROM targets t JOIN w ON w.market = t.market LEFT JOIN embeddings e ON e.vec_id = t.entity),
learned AS (SELECT market, value, sum(y) AS s, count(*) AS n FROM chosen WHERE ts >= '1997-01-01' AND ts < '2000-01-01' GROUP BY 1, 2), whole AS (SELECT market, sum(s) / sum(n) AS m FROM learned GROUP BY 1)
SELECT c.market, feature, config, count(*) AS n, round(sqrt(avg(power(y - CASE WHEN l.n IS NULL THEN m ELSE (s + alpha * m) / (l.n + alpha) END, 2))), 6) AS rmse
FROM chosen c JOIN whole ON whole.market = c.market LEFT JOIN learned l ON l.market = c.market AND l.value = c.value WHERE ts >= '2000-01-01' AND ts < '2001-08-02' GROUP BY 1, 2, 3""")
def sel12(t):
    """Choices made on development rows are frozen with a manifest; evaluation rows are read through it only, and scored by them."""
    path = fresh_path(t.spark, "frozen")
    S.freeze(S.best(t.pooled, ["market"], [F.col("mse"), F.col("feature"), F.col("config")]).select("market", "feature", "config"), path)
    choices, evaluation = S.read_after_freeze(t.spark, path, lambda: t.evaluation)
    traits = dict(zip(FEATURES, ["brand", "size_band", "word1", "emb_label"]))

    def cells(rows):
        """Counted sums by the traits, then by the value of the market's chosen one, so that few rows meet the choices."""
        fine = rows.join(t.labels_by_entity, "entity", "left").groupBy("market", *traits.values()).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
        value = F.coalesce(*[F.when(F.col("feature") == f, F.col(c).cast("string")) for f, c in traits.items()], F.lit("?"))
        return fine.join(choices, "market").withColumn("value", value).groupBy("market", "feature", "config", "value").agg(*[F.sum(c).alias(c) for c in ("n", "sy", "syy")])

    learned = cells(t.train)
    level = learned.groupBy("market").agg((F.sum("sy") / F.sum("n")).alias("m"))
    alpha = F.array(*[F.lit(float(a)) for a in ALPHAS])[F.col("config").cast("int")]
    rows = cells(evaluation).join(level, "market").join(learned.select("market", "value", F.col("n").alias("ln"), F.col("sy").alias("ls")), ["market", "value"], "left")
    p = F.when(F.col("ln").isNull(), F.col("m")).otherwise((F.col("ls") + alpha * F.col("m")) / (F.col("ln") + alpha))
    rows = rows.withColumn("p", p).withColumn("sse", F.col("n") * F.col("p") * F.col("p") - 2 * F.col("p") * F.col("sy") + F.col("syy"))
    return rows.groupBy("market", "feature", "config").agg(F.sum("n").alias("n"), tidy(F.sqrt(F.sum("sse") / F.sum("n"))).alias("rmse"))


@query("sel13", f"""WITH {SCORES}, q AS (SELECT *, round(sse / n, 9) AS mse FROM scores), w AS (SELECT market, fold, feature, config FROM (SELECT *, row_number() OVER (PARTITION BY market, fold ORDER BY mse, feature, config) AS rn FROM q) WHERE rn = 1),
fp AS (SELECT market, fold, source_row, any_value(y) AS y, max(p) FILTER (WHERE feature = 'brand') AS a, max(p) FILTER (WHERE feature = 'emb') AS b FROM fold_preds WHERE config = 2 GROUP BY 1, 2, 3),
g AS (SELECT market, fold, CAST(i / 10.0 AS DOUBLE) AS weight, round(avg(power(y - ((1 - i / 10.0::DOUBLE) * a + i / 10.0::DOUBLE * b), 2)), 9) AS mse FROM fp CROSS JOIN range(11) r(i) GROUP BY 1, 2, 3),
gw AS (SELECT market, fold, weight FROM (SELECT *, row_number() OVER (PARTITION BY market, fold ORDER BY mse, weight) AS rn FROM g) WHERE rn = 1)
SELECT w.market, w.fold, w.feature, w.config, gw.weight FROM w JOIN gw ON gw.market = w.market AND gw.fold = w.fold""")
def sel13(t):
    """Winner and optimal blend weight of every quarter."""
    q = t.scores.withColumn("mse", F.round(F.col("sse") / F.col("n"), 9))
    w = S.best(q, ["market", "fold"], [F.col("mse"), F.col("feature"), F.col("config")]).select("market", "fold", "feature", "config")
    grid = S.blend_scores(late_sums(t, ["market", "fold"]), WEIGHTS, 9)
    return w.join(S.late_weight(grid, ["market", "fold"]).select("market", "fold", "weight"), ["market", "fold"])


@query("sel14", f"""WITH {SCORES}, q AS (SELECT *, round(sse / n, 9) AS mse FROM scores), w AS (SELECT market, fold, feature, config, mse FROM (SELECT *, row_number() OVER (PARTITION BY market, fold ORDER BY mse, feature, config) AS rn FROM q) WHERE rn = 1),
nx AS (SELECT *, lead(fold) OVER (PARTITION BY market ORDER BY fold) AS next_fold, lead(mse) OVER (PARTITION BY market ORDER BY fold) AS best_mse FROM w)
SELECT nx.market, nx.fold, nx.next_fold, nx.feature, nx.config, round(q.mse, 6) AS transfer_mse, round(nx.best_mse, 6) AS best_mse
FROM nx JOIN q ON q.market = nx.market AND q.fold = nx.next_fold AND q.feature = nx.feature AND q.config = nx.config""")
def sel14(t):
    q = t.scores.withColumn("mse", F.round(F.col("sse") / F.col("n"), 9))
    out = S.forward_transfer(q, ["market"], "fold", ["feature", "config"], "mse")
    return out.select("market", "fold", "next_fold", "feature", "config", F.round("transfer_mse", 6).alias("transfer_mse"), F.round("best_mse", 6).alias("best_mse"))


@query("sel15", f"""WITH {PREDS}, {WINNERS} SELECT w.condition, count(*) AS n_markets, count(*) FILTER (WHERE w.model <> b.model) AS n_changed, round(max(abs(w.mse - b.mse)), 6) AS widest_change
FROM winners w JOIN winners b ON b.market = w.market AND b.condition = 'base' GROUP BY 1""")
def sel15(t):
    w = condition_winners(t)
    base = w.filter("condition = 'base'").select("market", F.col("model").alias("b"), F.col("mse").alias("bm"))
    return w.join(base, "market").groupBy("condition").agg(
        F.count(F.lit(1)).alias("n_markets"), F.count_if(F.col("model") != F.col("b")).alias("n_changed"), tidy(F.max(F.abs(F.col("mse") - F.col("bm")))).alias("widest_change")
    )


@query("sel16", f"""WITH {SCORES}, w AS (SELECT market, feature, mse FROM (SELECT *, row_number() OVER (PARTITION BY market, feature ORDER BY mse, config) AS rn FROM pooled) WHERE rn = 1)
SELECT a.market, a.feature AS candidate, b.feature AS reference, round(a.mse - b.mse, 6) + 0.0 AS delta FROM w a JOIN w b ON b.market = a.market AND b.feature = 'brand' WHERE a.feature <> 'brand'""")
def sel16(t):
    """Same kind of fit on other feature groups, contrasted with the brand fit of the same market."""
    w = S.best(t.pooled, ["market", "feature"], [F.col("mse"), F.col("config")]).select("market", "feature", "mse")
    ref = w.filter("feature = 'brand'").select("market", F.col("feature").alias("reference"), F.col("mse").alias("rm"))
    return w.filter("feature <> 'brand'").join(ref, "market").select("market", F.col("feature").alias("candidate"), "reference", tidy(F.col("mse") - F.col("rm")).alias("delta"))


@query("sel17", f"""WITH {SCORES} SELECT count(DISTINCT market) AS n_choices, 0::BIGINT AS stored_only, 0::BIGINT AS derived_only FROM pooled""")
def sel17(t):
    """Stored choices derived again by another route and compared as sets."""
    stored = S.freeze(S.best(t.pooled, ["market"], [F.col("mse"), F.col("feature"), F.col("config")]).select("market", "feature", "config"), fresh_path(t.spark, "choices"))
    low = t.pooled.groupBy("market").agg(F.min("mse").alias("mse"))
    again = t.pooled.join(low, ["market", "mse"]).groupBy("market").agg(F.min(F.struct("feature", "config")).alias("m")).select("market", "m.feature", "m.config")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).withColumn("_one", F.lit(1))
    parts = n(stored, "n_choices").join(n(stored.exceptAll(again), "stored_only"), "_one").join(n(again.exceptAll(stored), "derived_only"), "_one")
    return parts.drop("_one")


@query("sel18", f"""WITH {PREDS}, {X2}, s AS (SELECT *, concat(year(make_timestamp(us)), 'Q', quarter(make_timestamp(us))) AS quarter FROM long), x AS (SELECT 'all' AS sample, * FROM s UNION ALL SELECT 'strict', * FROM s WHERE evt <> 'R' AND prior_n >= 40),
tq AS (SELECT targets.*, x1, x2, concat(year(ts), 'Q', quarter(ts)) AS quarter FROM targets JOIN px USING (entity)), qs AS (SELECT DISTINCT quarter FROM tq),
pm2 AS (SELECT qs.quarter, {centred_sql('y')} FROM qs JOIN tq ON tq.quarter < qs.quarter GROUP BY 1), pb2 AS (SELECT *, {ridge_sql('1.0')} FROM pm2),
ev AS (SELECT t.quarter, t.evt, t.prior_n, y - {LINE_SQL} AS e FROM tq t JOIN pb2 ON pb2.quarter = t.quarter WHERE ts >= '2000-01-01' AND ts < '2001-08-02'),
xe AS (SELECT 'all' AS sample, * FROM ev UNION ALL SELECT 'strict', * FROM ev WHERE evt <> 'R' AND prior_n >= 40)
SELECT quarter, sample, model, count(*) AS n, round(sqrt(avg(power(y - p, 2))), 6) AS rmse FROM x GROUP BY 1, 2, 3
UNION ALL SELECT quarter, sample, 'refit', count(*), round(sqrt(avg(e * e)), 6) FROM xe GROUP BY 1, 2""")
def sel18(t):
    """Errors by quarter of models fixed before the evaluation, next to a fit on all that lies before each quarter."""
    quarter = F.concat(F.year("ts").cast("string"), F.lit("Q"), F.quarter("ts").cast("string"))
    sample = names_where({"all": F.lit(True), "strict": (F.col("evt") != "R") & (F.col("prior_n") >= 40)})
    rows = t.preds.withColumn("quarter", quarter).withColumn("sample", F.explode(sample))
    fixed = M.score(rows, ["quarter", "sample"], "entity", "y", MODELS).select("quarter", "sample", "model", "n", F.round("rmse", 6).alias("rmse"))
    fits = L.fit_grid(G.before(small_grams(t, ("quarter",), t.targets.withColumn("quarter", quarter)), [], "quarter"), ["quarter"], [("ridge", 2, {"alpha": 1.0})])
    later = t.evaluation.withColumn("quarter", quarter).withColumn("sample", F.explode(sample))
    scored, p = L.predict(G.entity_targets(later, ["quarter", "sample"], "entity", "y").join(small(t).select("entity", "x"), "entity"), fits, ["quarter"]), F.col("p")
    refit = scored.groupBy("quarter", "sample").agg(F.sum("n").cast("bigint").alias("n"), tidy(F.sqrt(F.sum(F.col("n") * p * p - 2 * p * F.col("sy") + F.col("syy")) / F.sum("n"))).alias("rmse"))
    return fixed.unionByName(refit.withColumn("model", F.lit("refit")))


IMAGES = ["emb", "signs"]


def sign_preds(t):
    """Fold predictions of a second image family: the signs of an embedding's first three components, shrunken as the others are."""
    sign = lambda i: F.when(F.col("embedding")[i] >= 0, "+").otherwise("-")
    signs = t.read("embeddings").select(F.col("vec_id").alias("entity"), F.concat(*[sign(i) for i in range(3)]).alias("signs"))
    rows = t.fold_rows.join(signs, "entity", "left").withColumn("value", F.coalesce("signs", F.lit("?")))
    train, valid = rows.filter("role = 'train'"), rows.filter("role = 'valid'")
    cells = train.groupBy("fold", "market", "value").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
    level = cells.groupBy("fold", "market").agg((F.sum("s") / F.sum("n")).alias("m"))
    p = lambda a: F.when(F.col("n").isNull(), F.col("m")).otherwise((F.col("s") + F.lit(a) * F.col("m")) / (F.col("n") + F.lit(a)))
    out = valid.select("fold", "source_row", "market", "y", "value").join(level, ["fold", "market"]).join(cells, ["fold", "market", "value"], "left")
    return out.select("fold", "source_row", "market", "y", F.lit("signs").alias("feature"), *[p(a).alias(f"p{i}") for i, a in enumerate(ALPHAS)])


@query("sel19", f"""WITH {SCORES}, sg AS (SELECT vec_id, concat(CASE WHEN embedding[1] >= 0 THEN '+' ELSE '-' END, CASE WHEN embedding[2] >= 0 THEN '+' ELSE '-' END, CASE WHEN embedding[3] >= 0 THEN '+' ELSE '-' END) AS signs FROM embeddings),
gx AS (SELECT r.*, coalesce(signs, '?') AS value FROM fold_rows r LEFT JOIN sg ON vec_id = r.entity),
gc AS (SELECT fold, market, value, sum(y) AS s, count(*) AS n FROM gx WHERE role = 'train' GROUP BY 1, 2, 3),
every AS (SELECT fold, source_row, market, y, feature, config, alpha, p FROM fold_preds UNION ALL
  SELECT x.fold, x.source_row, x.market, x.y, 'signs', config, alpha, CASE WHEN c.n IS NULL THEN l.m ELSE (c.s + alpha * l.m) / (c.n + alpha) END FROM gx x JOIN levels l ON l.fold = x.fold AND l.market = x.market
  LEFT JOIN gc c ON c.fold = x.fold AND c.market = x.market AND c.value = x.value CROSS JOIN (VALUES (0::BIGINT, 0::DOUBLE), (1, 1), (2, 10), (3, 100)) a(config, alpha) WHERE x.role = 'valid'),
b AS (SELECT market, feature, config FROM (SELECT *, row_number() OVER (PARTITION BY market, feature ORDER BY mse, -alpha) AS rn FROM (SELECT market, feature, config, alpha, round(avg(power(y - p, 2)), 9) AS mse FROM every GROUP BY 1, 2, 3, 4)) WHERE rn = 1),
bp AS (SELECT v.* FROM every v JOIN b USING (market, feature, config)),
cand AS (SELECT a.market, 'augmented' AS kind, a.feature AS candidate, e.feature AS image, k / 10.0::DOUBLE AS weight, round(avg(power(a.y - ((1 - k / 10.0::DOUBLE) * a.p + k / 10.0::DOUBLE * e.p), 2)), 9) AS mse, count(DISTINCT a.fold) AS folds
  FROM bp a JOIN bp e ON e.fold = a.fold AND e.source_row = a.source_row AND e.feature IN ('emb', 'signs') CROSS JOIN range(11) r(k) WHERE a.feature NOT IN ('emb', 'signs') GROUP BY ALL
  UNION ALL SELECT market, 'image_only', feature, feature, 1.0::DOUBLE, round(avg(power(y - p, 2)), 9), count(DISTINCT fold) FROM bp WHERE feature IN ('emb', 'signs') GROUP BY ALL)
SELECT market, kind, candidate, image, weight, round(mse, 6) AS mse FROM (SELECT *, row_number() OVER (PARTITION BY market, kind ORDER BY mse, candidate, image, weight) AS rn FROM cand WHERE folds = 3) WHERE rn = 1""")
def sel19(t):
    """Every metadata family blended with every image family at every weight, pooled only when all folds exist.

    One pass over the rows sums the products of all families' errors; every pair and weight is scored from these.
    """
    families = [*[f for f in FEATURES if f not in IMAGES], *IMAGES]
    preds = t.fold_preds.drop("entity").unionByName(sign_preds(t))
    wide = preds.groupBy("market", "feature").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fold").alias("folds"), *[F.sum((F.col("y") - F.col(f"p{i}")) ** 2).alias(f"s{i}") for i in range(len(ALPHAS))])
    scores = wide.select("market", "feature", F.posexplode(F.array(*[F.round(F.col(f"s{i}") / F.col("n"), 9) for i in range(len(ALPHAS))])).alias("config", "mse"))
    simple = scores.withColumn("simple", -F.array(*[F.lit(float(a)) for a in ALPHAS])[F.col("config")])
    chosen = S.ordered_choices(simple, ["market", "feature"], "mse", ["simple"]).filter("rank = 1").select("market", "feature", "config")
    error = F.col("y") - F.array(*[f"p{i}" for i in range(len(ALPHAS))])[F.col("config")]
    rows = preds.join(chosen, ["market", "feature"]).groupBy("market", "fold", "source_row").agg(*[F.max(F.when(F.col("feature") == f, error)).alias(f) for f in families])
    product = lambda a, b: F.sum(F.col(a) * F.col(b))
    pair = lambda a, b: F.struct(F.lit(a).alias("candidate"), F.lit(b).alias("image"), product(a, a).alias("aa"), product(a, b).alias("ab"), product(b, b).alias("bb"), F.count(F.col(a) * F.col(b)).alias("n"))
    products = rows.groupBy("market", "fold").agg(F.array(*[pair(a, b) for a in families for b in IMAGES if a not in IMAGES or a == b]).alias("pairs")).select("market", "fold", F.inline("pairs"))
    sums = products.filter("n > 0").groupBy("market", "candidate", "image").agg(*[F.sum(c).alias(c) for c in ("n", "aa", "ab", "bb")], F.count(F.lit(1)).alias("folds")).filter("folds = 3")
    alone = F.col("candidate") == F.col("image")
    grid = S.blend_scores(sums, WEIGHTS, 9).filter(~alone | (F.col("weight") == 1.0)).withColumn("kind", F.when(alone, "image_only").otherwise("augmented"))
    out = S.best(grid, ["market", "kind"], [F.col("mse"), F.col("candidate"), F.col("image"), F.col("weight")])
    return out.select("market", "kind", "candidate", "image", "weight", F.round("mse", 6).alias("mse"))
