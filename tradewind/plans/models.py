"""Model queries. Closed forms on two numeric traits give the linear families an exact SQL check;
the wide traits and embeddings run through the same code without one."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.sql import functions as F

from ..functions.scalars import in_window, moment, names_where, robust_asinh, robust_sinh, tidy
from ..operators import gram as G
from ..operators import metrics as M
from ..operators import models as L
from ..operators import resample as B
from ..operators import select as S
from ..operators import trees as T
from ..operators.features import robust_parameters
from ..sources.tables import EVAL, FOLD_CTES, FOLDS, PREDS, TARGETS, TRAIN
from .features import early_vectors, entities, image_vectors, trait_vectors, vectors
from .registry import query
from .scans import CONDITION_WHERE, CONDITIONS_SQL, asinh_parameters, conditions

t6 = lambda *names: [tidy(F.col(n)).alias(n) for n in names]


def small(t):
    """Two numeric traits per entity as a vector."""
    return entities(t).select("entity", "market", "x1", "x2", F.array("x1", "x2").alias("x"))


def train_sums(t, by=("market",)):
    return G.entity_targets(t.train, list(by), "entity", "y")


X2 = """px AS (SELECT p_partkey AS entity, p_size / 10.0::DOUBLE AS x1, p_retailprice / 1000.0::DOUBLE AS x2 FROM part)"""


def moments_sql(source: str, by: str, w: str = "1.0::DOUBLE", y: str = "y") -> str:
    """CTE mom: centred second moments of (x1, x2, y) per group."""
    return f"""{X2}, s0 AS (SELECT {by}, sum({w}) AS n, sum({w} * x1) / sum({w}) AS m1, sum({w} * x2) / sum({w}) AS m2, sum({w} * {y}) / sum({w}) AS my FROM {source} JOIN px USING (entity) GROUP BY {by}),
mom AS (SELECT s.{by.replace(', ', ', s.')}, any_value(n) AS n, any_value(m1) AS m1, any_value(m2) AS m2, any_value(my) AS my, sum({w} * (x1 - m1) * (x1 - m1)) AS s11, sum({w} * (x1 - m1) * (x2 - m2)) AS s12,
  sum({w} * (x2 - m2) * (x2 - m2)) AS s22, sum({w} * (x1 - m1) * ({y} - my)) AS t1, sum({w} * (x2 - m2) * ({y} - my)) AS t2
  FROM {source} JOIN px USING (entity) JOIN s0 s USING ({by}) GROUP BY s.{by.replace(', ', ', s.')})"""


def ridge_sql(alpha: str) -> str:
    det = f"((s11 + {alpha}) * (s22 + {alpha}) - s12 * s12)"
    return f"(t1 * (s22 + {alpha}) - s12 * t2) / {det} AS b1, ((s11 + {alpha}) * t2 - s12 * t1) / {det} AS b2"


SHOW = "round(b1, 6) + 0.0 AS b1, round(b2, 6) + 0.0 AS b2, round(my - m1 * b1 - m2 * b2, 6) + 0.0 AS intercept"


def shown(fits, *keys):
    return fits.select(*keys, tidy(F.col("coef")[0]).alias("b1"), tidy(F.col("coef")[1]).alias("b2"), *t6("intercept"))


def small_grams(t, by=("market",), rows=None):
    sums = G.entity_targets(t.train if rows is None else rows, list(by), "entity", "y")
    return G.accumulate(sums.join(small(t).select("entity", "x"), "entity"), list(by))


GRAM_SQL = f"""WITH {TARGETS}, {X2} SELECT market, i, round(sum(z * 1.0), 5) AS g0, round(sum(z * x1), 5) AS g1, round(sum(z * x2), 5) AS g2, round(sum(z * y), 5) + 0.0 AS b, round(CASE WHEN i = 0 THEN sum(y * y) ELSE 0 END, 5) + 0.0 AS c
FROM (SELECT market, i, CASE i WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN x1 ELSE x2 END AS z, x1, x2, y FROM train JOIN px USING (entity) CROSS JOIN (VALUES (0), (1), (2)) v(i)) GROUP BY 1, 2"""


def gram_shown(g):
    return g.select("market", "i", *[tidy(F.col("g")[k], 5).alias(f"g{k}") for k in range(3)], tidy(F.col("b"), 5).alias("b"), tidy(F.col("c"), 5).alias("c"))


@query("md0", GRAM_SQL)
def md0(t):
    """Gram statistics from counted entity sums, by matrix products in Arrow batches."""
    return gram_shown(small_grams(t))


@query("md0_rows", GRAM_SQL)
def md0_rows(t):
    """The same Gram from expanded trades, as JVM sums over columns."""
    rows = t.train.join(small(t).select("entity", "x1", "x2"), "entity").select("market", "x1", "x2", F.lit(1.0).alias("n"), F.col("y").alias("sy"), (F.col("y") * F.col("y")).alias("syy"))
    return gram_shown(G.accumulate_columns(rows, ["market"], ["x1", "x2"]))


@query("md1", f"WITH {TARGETS}, {moments_sql('train', 'market')}, b AS (SELECT *, {ridge_sql('0.0')} FROM mom) SELECT market, {SHOW} FROM b")
def md1(t):
    return shown(L.fit_grid(small_grams(t), ["market"], L.grid("ols")), "market")


@query("md2", f"""WITH {TARGETS}, {moments_sql('train', 'market')}, b AS (SELECT *, {ridge_sql('a')} FROM mom CROSS JOIN (SELECT CAST(k AS BIGINT) AS config_index, power(10.0::DOUBLE, k - 2) AS a FROM range(9) r(k)))
SELECT market, config_index, {SHOW} FROM b""")
def md2(t):
    """Ridge on the full alpha grid from one Gram per market."""
    return shown(L.fit_grid(small_grams(t), ["market"], L.grid("ridge")), "market", "config_index")


@query("md3", f"""WITH {TARGETS}, {moments_sql('train', 'market')}, g AS (SELECT row_number() OVER (ORDER BY a, r) - 1 AS config_index, a, r FROM (VALUES (0.001::DOUBLE), (0.01), (0.1), (1), (10)) x(a) CROSS JOIN (VALUES (0.1::DOUBLE), (0.5), (0.9)) y(r))
SELECT market, config_index, round(sign(t1 / n) * greatest(abs(t1 / n) - a * r, 0) / (s11 / n + a * (1 - r)), 6) + 0.0 AS b1 FROM mom CROSS JOIN g""")
def md3(t):
    """Elastic net on one trait, where the soft threshold is the closed form."""
    sums = train_sums(t).join(small(t).select("entity", F.array("x1").alias("x")), "entity")
    return L.fit_grid(G.accumulate(sums, ["market"]), ["market"], L.grid("elasticnet")).select("market", "config_index", tidy(F.col("coef")[0]).alias("b1"))


@query("md4", f"""WITH {TARGETS}, {moments_sql('train', 'market')}, w AS (SELECT *, t1 / sqrt(t1 * t1 + t2 * t2) AS w1, t2 / sqrt(t1 * t1 + t2 * t2) AS w2 FROM mom),
b AS (SELECT *, w1 * (w1 * t1 + w2 * t2) / (w1 * w1 * s11 + 2 * w1 * w2 * s12 + w2 * w2 * s22) AS b1, w2 * (w1 * t1 + w2 * t2) / (w1 * w1 * s11 + 2 * w1 * w2 * s12 + w2 * w2 * s22) AS b2 FROM w),
c AS (SELECT *, {ridge_sql('0.0')} FROM mom)
SELECT market, 1::BIGINT AS components, {SHOW} FROM b UNION ALL SELECT market, 2::BIGINT, {SHOW} FROM c""")
def md4(t):
    """Partial least squares: one component in closed form, two components equal least squares."""
    fits = L.fit_grid(small_grams(t), ["market"], [("pls", 1, {"components": 1}), ("pls", 2, {"components": 2})])
    return shown(fits, "market", F.col("config_index").alias("components"))


def svr_inputs(t):
    rows = t.stage("svr_rows", lambda: t.train.select("entity", "y"))
    return rows, t.stage("svr_vectors", lambda: small(t).select("entity", "x"))


@query("md5")
def md5(t):
    """Squared epsilon-insensitive SVR by Newton steps; the certificate is part of the result."""
    rows, vec = svr_inputs(t)
    cells = L.svr_cells(rows, vec, "entity", "y")
    out = [(i, c, L.fit_svr(rows, vec, "entity", "y", 2, cells=cells, **c)) for i, c in enumerate(L.GRID["svr"])]
    data = [(i, c["C"], c["epsilon"], float(f["beta"][0]), float(f["beta"][1]), float(f["beta"][2]), f["objective"], f["gradient_norm"], f["gap_bound"], bool(f["valid"])) for i, c, f in out]
    return t.spark.createDataFrame(data, "config_index bigint, C double, epsilon double, b1 double, b2 double, intercept double, objective double, gradient_norm double, gap_bound double, valid boolean")


CHECK_BETA = (0.02, -0.05, 0.01)


@query("md17", f"""WITH {TARGETS}, {X2}, r AS (SELECT x1, x2, 0.02::DOUBLE * x1 - 0.05::DOUBLE * x2 + 0.01::DOUBLE - y AS raw FROM train JOIN px USING (entity)),
e AS (SELECT *, sign(raw) * greatest(abs(raw) - 0.1::DOUBLE, 0) AS res FROM r), g AS (SELECT 0.5::DOUBLE * (0.0004 + 0.0025 + 0.0001) + 1.0 * sum(res * res) AS objective, 0.02 + 2 * sum(x1 * res) AS g1, -0.05 + 2 * sum(x2 * res) AS g2, 0.01 + 2 * sum(res) AS g3 FROM e)
SELECT round(objective, 4) AS objective, round(sqrt(g1 * g1 + g2 * g2 + g3 * g3), 4) AS gradient_norm FROM g""")
def md17(t):
    """Objective and gradient norm recomputed for given coefficients."""
    rows, vec = svr_inputs(t)
    at = L.svr_certificate(rows, vec, "entity", "y", np.array(CHECK_BETA), 1.0, 0.1)
    out = t.spark.createDataFrame([(at["objective"], at["gradient_norm"])], "objective double, gradient_norm double")
    return out.select(F.round("objective", 4).alias("objective"), F.round("gradient_norm", 4).alias("gradient_norm"))


FITS = [*(name for name, *_ in FOLDS), "all"]


def tree_parameters(t):
    """Centre and scale of the target per (fit, market): the three folds and the whole training window."""
    folds = robust_parameters(t.fold_rows.filter("role = 'train'"), ["fold", "market"], "y").select("fold", "market", "center", "scale")
    return t.stage("tree_asinh", lambda: folds.unionByName(asinh_parameters(t).select(F.lit("all").alias("fold"), "market", "center", "scale")))


def tree_entities(t):
    """Every entity with its trait vector and, per fit, how many training trades it has and the sum of their targets."""
    train = t.fold_rows.filter("role = 'train'").select("fold", "market", "entity", "y").unionByName(t.train.select(F.lit("all").alias("fold"), "market", "entity", "y"))
    z = robust_asinh(F.col("y"), F.col("center"), F.col("scale"))
    sums = train.join(tree_parameters(t), ["fold", "market"]).groupBy("entity").agg(*[
        f(F.when(F.col("fold") == fold, v)).alias(f"{name}{i}") for i, fold in enumerate(FITS) for name, f, v in (("n", F.count, F.lit(1)), ("s", F.sum, z))
    ])
    packed = lambda c: F.array(*[F.coalesce(F.col(f"{c}{i}"), F.lit(0)).cast("double") for i in range(len(FITS))]).alias(c)
    return t.stage("tree_entities", lambda: trait_vectors(t).join(sums, "entity", "left").select("entity", "x", packed("n"), packed("s")))


def boosted(t, family, trees):
    """(entity, p): predictions of all folds' and configurations' trees, by fold, then configuration."""
    growth = [T.Growth(c["learning_rate"], c["max_leaf_nodes"], float(c["l2"]), **TREE_GROWTH[family]) for c in L.TREE_GRID[family]]
    return T.boost(tree_entities(t), "entity", "x", "n", "s", growth, trees).withColumnRenamed("key", "entity")


def of_fit(p, fold):
    """The predictions of all configurations of one fit."""
    configs = F.expr(f"size({p}) div {len(FITS)}")
    return F.slice(p, ((F.array_position(F.array(*map(F.lit, FITS)), fold) - 1) * configs + 1).cast("int"), configs.cast("int"))


def forest(t, family, trees, fits):
    """(entity, fold, config_index, z): predictions of bagged forests for the given (fold, configuration) pairs, four fits at a time, on entities weighted by their trades."""
    grid, rows = L.TREE_GRID[family], tree_entities(t)
    edges = T.bin_edges(rows, "x")

    def drawn(fold):
        n, s = F.col("n")[FITS.index(fold)], F.col("s")[FITS.index(fold)]
        return t.stage(f"bag_{fold}_{trees}", lambda: T.bag(rows.select("entity", "x", n.alias("n"), s.alias("s")), "entity", "x", "n", "s", edges, trees))

    bags = {fold: drawn(fold) for fold in dict.fromkeys(fold for fold, _ in fits)}

    def one(of):
        fold, c = of
        model = L.fit_tree(bags[fold], family, grid[c], trees=trees, edges=edges)
        return model.transform(rows).select("entity", F.lit(fold).alias("fold"), F.lit(c).cast("bigint").alias("config_index"), F.col("p").alias("z"))

    with ThreadPool(4) as pool:
        out = pool.map(one, fits)
    for more in out[1:]:
        out[0] = out[0].unionAll(more)
    return out[0]


#: What tells the boosted families apart: XGBoost's default grows whole levels with any leaf size, the others the best leaf of at least 20 rows.
TREE_GROWTH = {"hist_gradient": {}, "lgbm_like": {}, "xgb_like": {"by_depth": True, "min_rows": 1.0}}


def tree_scores(t, predicted):
    """Pooled validation error of each configuration: squared errors of an entity's trades from their sums."""
    valid = t.fold_rows.filter("role = 'valid'").groupBy("fold", "market", "entity").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    p = robust_sinh(F.col("z"), F.col("center"), F.col("scale"))
    rows = valid.join(tree_parameters(t), ["fold", "market"])
    if "p" in predicted.columns:
        # Entities meet all their predictions in one row; those of the row's fold are taken after the join.
        rows = rows.join(predicted, "entity").select(*rows.columns, F.posexplode(of_fit("p", F.col("fold"))).alias("config_index", "z")).withColumn("config_index", F.col("config_index").cast("bigint"))
    else:
        rows = rows.join(predicted, ["fold", "entity"])
    e = rows.select("fold", "config_index", "n", (F.col("n") * p * p - 2 * p * F.col("sy") + F.col("syy")).alias("sse"))
    per = e.groupBy("fold", "config_index").agg(F.sum("n").alias("n"), F.sum("sse").alias("sse"), F.lit(True).alias("valid"))
    return S.pool(per, ["config_index"])


def tree_best(t, predicted):
    """The configuration best on the folds; ties within 1e-12 go to the earlier, simpler one."""
    return tree_scores(t, predicted).filter("valid").agg(F.min(F.struct(F.round("mse", 12), "config_index")).alias("b")).first()["b"]["config_index"]


def boosted_stage(t, family, trees):
    # Families of equal growth have equal trees, which are grown once.
    return t.stage(f"trees_{sorted(TREE_GROWTH[family].items())}_{trees}", lambda: boosted(t, family, trees))


def tree_query(family, trees=L.TREES):
    """The whole grid on every fold; the best configuration, fitted on all training rows, is scored on the evaluation rows."""
    def run(t):
        if family == "forest":
            folds = [(fold, c) for fold in FITS[:-1] for c in range(len(L.TREE_GRID[family]))]
            best = tree_best(t, t.stage(f"trees_{family}_{trees}", lambda: forest(t, family, trees, folds)))
            chosen = forest(t, family, trees, [("all", best)])
        else:
            predicted = boosted_stage(t, family, trees)
            best = tree_best(t, predicted)
            chosen = predicted.select("entity", F.get(of_fit("p", F.lit("all")), F.lit(best).cast("int")).alias("z"))
        rows = t.evaluation.join(asinh_parameters(t), "market").join(chosen, "entity")
        rows = rows.withColumn("p_tree", robust_sinh(F.col("z"), F.col("center"), F.col("scale"))).withColumn("p_zero", F.lit(0.0))
        return M.score(rows, ["market"], "entity", "y", ["zero", "tree"]).select("market", "model", "n", *t6("rmse", "mae", "entity_rmse"), F.lit(best).cast("bigint").alias("config_index"))

    return run


def tree_properties(family, trees=L.TREES):
    """Per configuration of the refit: the trades it learned from, whether it beats their mean, and whether its squared error from sums is that from trades."""
    def run(t):
        # All configurations meet a row at once, each as a column of its own.
        fitted = boosted_stage(t, family, trees).select("entity", of_fit("p", F.lit("all")).alias("p"))
        configs = range(len(L.TREE_GRID[family]))
        z = robust_asinh(F.col("y"), F.col("center"), F.col("scale"))
        train = t.train.join(asinh_parameters(t), "market").select("entity", z.alias("y"))
        sums = train.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
        p = [F.col("p")[i] for i in configs]
        from_sums = sums.join(fitted, "entity").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * p[i] * p[i] - 2 * p[i] * F.col("sy") + F.col("syy")).alias(f"sse{i}") for i in configs])
        errors = [F.sum((F.col("y") - p[i]) * (F.col("y") - p[i])).alias(f"direct{i}") for i in configs]
        from_rows = train.join(fitted, "entity").agg(*errors, (F.count(F.lit(1)) * F.var_pop("y")).alias("sst"))
        both = from_sums.crossJoin(from_rows).where("n IS NOT NULL")
        each = F.inline(F.array(*[F.struct(F.lit(i).cast("bigint").alias("config_index"), F.col(f"sse{i}").alias("sse"), F.col(f"direct{i}").alias("direct")) for i in configs]))
        each = both.select("n", "sst", each)
        return each.select("config_index", "n", (F.col("direct") < F.col("sst")).alias("beats_mean"), (F.abs(F.col("sse") - F.col("direct")) <= 1e-9 * F.col("sst")).alias("errors_agree"))

    return run


# The full ensemble and the family's whole grid on every fold and on all training rows.
query("md6")(tree_query("hist_gradient"))
query("md7")(tree_query("xgb_like"))
query("md8")(tree_query("lgbm_like"))
query("md9")(tree_query("forest"))

PROPERTIES_SQL = f"WITH {TARGETS} SELECT c.i AS config_index, count(*) AS n, true AS beats_mean, true AS errors_agree FROM train CROSS JOIN range({len(L.BOOSTED)}) c(i) GROUP BY 1"
query("md6_properties", PROPERTIES_SQL)(tree_properties("hist_gradient"))
query("md7_properties", PROPERTIES_SQL)(tree_properties("xgb_like"))


@query("md10", f"""WITH {TARGETS} SELECT market, family, true AS identical FROM (SELECT DISTINCT market FROM train) CROSS JOIN (VALUES ('ols'), ('ridge'), ('elasticnet')) v(family)""")
def md10(t):
    """Row-expanded and entity-counted fits of squared-loss families agree."""
    rows = t.train.join(small(t).select("entity", "x"), "entity").select("market", "x", F.lit(1.0).alias("n"), F.col("y").alias("sy"), (F.col("y") * F.col("y")).alias("syy"))
    configs = L.grid("ols", "ridge", "elasticnet")
    a = L.fit_grid(small_grams(t), ["market"], configs).select("market", "family", "config_index", F.col("coef").alias("ca"))
    b = L.fit_grid(G.accumulate(rows, ["market"]), ["market"], configs).select("market", "family", "config_index", F.col("coef").alias("cb"))
    gap = F.array_max(F.zip_with("ca", "cb", lambda u, v: F.abs(u - v)))
    return a.join(b, ["market", "family", "config_index"]).groupBy("market", "family").agg((F.max(gap) < 1e-9).alias("identical"))


def fold_grams(t):
    """Small Grams of every fold's training rows at once."""
    return small_grams(t, ("fold",), t.fold_rows.filter("role = 'train'"))


@query("md12", f"""WITH {FOLD_CTES}, ftr AS (SELECT * FROM fold_rows WHERE role = 'train'), {moments_sql('ftr', 'fold')}, b AS (SELECT *, {ridge_sql('1.0')} FROM mom)
SELECT r.fold, r.source_row, round(my + (x1 - m1) * b1 + (x2 - m2) * b2, 6) + 0.0 AS p FROM fold_rows r JOIN px USING (entity) JOIN b ON b.fold = r.fold WHERE role = 'valid'""")
def md12(t):
    """Out-of-fold predictions: each quarter scored by the fit of the time before it."""
    fits = L.fit_grid(fold_grams(t), ["fold"], [("ridge", 2, {"alpha": 1.0})])
    return oof(t, fits).select("fold", "source_row", *t6("p"))


def oof(t, fits, vec=None):
    valid = t.fold_rows.filter("role = 'valid'").select("fold", "source_row", "market", "entity", "us", "y", "evt", "prior_n")
    vec = small(t).select("entity", "x") if vec is None else vec
    pairs = valid.select("fold", "entity").distinct().join(vec, "entity")
    scored = L.predict(pairs, fits, ["fold"]).select("fold", "entity", "p")
    return valid.join(scored, ["fold", "entity"])


def search(t, vec, families, dims=None):
    """Grid search over folds on wide vectors, entity-level from fit to score."""
    train = t.fold_rows.filter("role = 'train'")
    valid = t.fold_rows.filter("role = 'valid'")
    grams = G.accumulate(G.entity_targets(train, ["fold"], "entity", "y").join(vec, "entity"), ["fold"])
    fits = L.fit_grid(grams, ["fold"], L.grid(*families))
    sums = G.entity_targets(valid, ["fold"], "entity", "y")
    scored = L.predict(sums.join(vec, "entity"), fits.select("fold", "family", "config_index", "coef", "intercept"), ["fold"])
    p = F.col("p")
    per = scored.groupBy("fold", "family", "config_index").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * p * p - 2 * p * F.col("sy") + F.col("syy")).alias("sse")
    )
    return per.join(fits.select("fold", "family", "config_index", "config", "valid", "reason"), ["fold", "family", "config_index"])


@query("md_search")
def md_search(t):
    """The whole linear grid on traits plus embeddings over the three folds, pooled and ranked."""
    scores = search(t, early_vectors(t), ["ols", "ridge", "elasticnet", "pls"])
    pooled = S.pool(scores, ["family", "config_index", "config"])
    best = S.best(pooled.filter("valid"), ["family"], [F.round("mse", 9), F.col("config_index")]).withColumn("best", F.lit(True)).select("family", "config_index", "best")
    return pooled.join(best, ["family", "config_index"], "left").select("family", "config_index", "config", "n", "valid", "folds", *t6("mse"), F.coalesce("best", F.lit(False)).alias("best"))


@query("md13", f"""WITH {TARGETS} SELECT market, components, components <= 2 AS valid, CASE WHEN components <= 2 THEN '' ELSE concat(2, ' of ', components, ' components') END AS reason
FROM (SELECT DISTINCT market FROM train) CROSS JOIN (VALUES (1::BIGINT), (2), (8)) v(components)""")
def md13(t):
    """Validity rule: a fit with fewer components than asked for is reported, not used."""
    fits = L.fit_grid(small_grams(t), ["market"], [("pls", k, {"components": k}) for k in (1, 2, 8)])
    return fits.select("market", F.col("config_index").alias("components"), "valid", "reason")


@query("md14", f"""WITH {TARGETS}, tm AS (SELECT market, entity, avg(y) AS y FROM train GROUP BY 1, 2), {moments_sql('tm', 'market')}, b AS (SELECT *, {ridge_sql('0.0')} FROM mom) SELECT market, {SHOW} FROM b""")
def md14(t):
    """Entity-mean training: one row per entity with equal weight."""
    mean = train_sums(t).select("market", "entity", (F.col("sy") / F.col("n")).alias("m"))
    rows = mean.join(small(t).select("entity", "x"), "entity").select("market", "x", F.lit(1.0).alias("n"), F.col("m").alias("sy"), (F.col("m") * F.col("m")).alias("syy"))
    return shown(L.fit_grid(G.accumulate(rows, ["market"]), ["market"], L.grid("ols")), "market")


@query("md15", f"""WITH {TARGETS}, {CONDITIONS_SQL}, ctr AS (SELECT condition, t.* FROM train t CROSS JOIN cond WHERE {CONDITION_WHERE}), {moments_sql('ctr', 'condition')}, b AS (SELECT *, {ridge_sql('10.0')} FROM mom),
ev AS (SELECT e.*, x1, x2, s.sample FROM evaluation e JOIN px USING (entity) CROSS JOIN (VALUES ('all'), ('strict')) s(sample) WHERE sample = 'all' OR (evt <> 'R' AND prior_n >= 40))
SELECT condition, sample, count(*) AS n, round(sqrt(avg(power(y - (my + (x1 - m1) * b1 + (x2 - m2) * b2), 2))), 6) AS rmse FROM ev CROSS JOIN b GROUP BY 1, 2""")
def md15(t):
    """One fixed configuration refitted per cleaning condition, scored on all and strict rows."""
    rows = t.train.withColumn("condition", F.explode(names_where(conditions())))
    fits = L.fit_grid(small_grams(t, ("condition",), rows), ["condition"], [("ridge", 3, {"alpha": 10.0})])
    sample = names_where({"all": F.lit(True), "strict": (F.col("evt") != "R") & (F.col("prior_n") >= 40)})
    sums = G.entity_targets(t.evaluation.withColumn("sample", F.explode(sample)), ["sample"], "entity", "y")
    named = fits.select(F.col("condition").alias("family"), F.col("config_index"), "coef", "intercept")
    scored = L.predict(sums.join(small(t).select("entity", "x"), "entity"), named, [])
    p = F.col("p")
    return scored.groupBy(F.col("family").alias("condition"), "sample").agg(
        F.sum("n").cast("bigint").alias("n"), tidy(F.sqrt(F.sum(F.col("n") * p * p - 2 * p * F.col("sy") + F.col("syy")) / F.sum("n"))).alias("rmse")
    )


#: Cohorts of the residual correction, by the masks their rows pass before anything is learned from them.
COHORTS = {"all": "true", "no_event": "evt <> 'R'", "strict": "evt <> 'R' AND prior_n >= 40"}
LAST_QUARTER = "1999Q4"


def by_cohort(rows):
    return rows.withColumn("cohort", F.explode(names_where({name: F.expr(mask) for name, mask in COHORTS.items()})))


def residual_rows(t):
    """Out-of-fold residuals of every cohort."""
    base = oof(t, L.fit_grid(fold_grams(t), ["fold"], [("ridge", 2, {"alpha": 1.0})])).withColumn("r", F.col("y") - F.col("p"))
    return by_cohort(base).select("cohort", "fold", "entity", "r")


def residual_sums(t):
    """Counted sums of the out-of-fold residuals by (cohort, fold, entity): all that the correction learns from."""
    return t.stage("residual_sums", lambda: G.entity_targets(residual_rows(t), ["cohort", "fold"], "entity", "r"))


def alpha_search(t, vec):
    """Per cohort and alpha: errors in the last quarter of the correction fitted on the quarters before it."""
    sums = residual_sums(t)
    grams = G.accumulate(sums.filter(F.col("fold") != LAST_QUARTER).join(vec, "entity"), ["cohort"])
    scored, q = L.predict(sums.filter(F.col("fold") == LAST_QUARTER).join(vec, "entity"), L.residual_grid(grams, ["cohort"]), ["cohort"]), F.col("p")
    out = scored.groupBy("cohort", "config_index").agg(
        F.sum("n").cast("bigint").alias("n"), F.sum("syy").alias("base_sse"), F.sum(F.col("n") * q * q - 2 * q * F.col("sy") + F.col("syy")).alias("sse")
    )
    alphas = F.array(*[F.lit(a) for a in L.RESIDUAL_ALPHAS])
    return out.withColumn("alpha", F.get(alphas, F.col("config_index").cast("int"))).withColumn("q4_rmse", F.sqrt(F.col("sse") / F.col("n")))


def best_alpha(searched):
    """The alpha of least error in each cohort; equal errors go to the smaller alpha."""
    return S.best(searched, ["cohort"], [F.round("q4_rmse", 12), F.col("alpha")]).select("cohort", "config_index", "alpha")


def corrected(t, vec, kind):
    """Evaluation trades of every cohort with the base prediction and the corrected one.

    The correction is fitted again on the residuals of all quarters with the cohort's best alpha. An
    entity without a vector gets no correction.
    """

    def build():
        best = best_alpha(alpha_search(t, vec))
        fits = L.residual_grid(G.accumulate(residual_sums(t).join(vec, "entity"), ["cohort"]), ["cohort"])
        fits = fits.join(best.select("cohort", "config_index"), ["cohort", "config_index"])
        base = L.fit_grid(small_grams(t, ()), [], [("ridge", 2, {"alpha": 1.0})])
        rows = by_cohort(t.evaluation).select("cohort", "source_row", "entity", "y")
        pairs = rows.select("cohort", "entity").distinct()
        first = L.predict(pairs.select("entity").distinct().join(small(t).select("entity", "x"), "entity"), base, []).select("entity", F.col("p").alias("p_base"))
        more = L.predict(pairs.join(vec, "entity"), fits, ["cohort"]).select("cohort", "entity", F.col("p").alias("q"))
        rows = rows.join(first, "entity").join(more, ["cohort", "entity"], "left").join(best.select("cohort", "alpha"), "cohort")
        return rows.withColumn("p_corrected", F.col("p_base") + F.coalesce("q", F.lit(0.0))).drop("q")

    return t.stage(f"corrected_{kind}", build)


CORRECTION = ["base", "corrected"]
DRAWS, SEED = 2000, 1729


def correction_report(t, cohorts):
    """Evaluation errors of base and corrected predictions by cohort, with the paired entity-bootstrap interval of their difference."""
    rows = corrected(t, image_vectors(t), "image").filter(F.col("cohort").isin(cohorts))
    stats = B.cluster_stats(rows, ["cohort"], "entity", "y", CORRECTION)
    changes = B.deltas(B.bootstrap(stats, ["cohort"], CORRECTION, DRAWS, SEED), ["cohort"], [("correction", "corrected", "base")], ["rmse", "entity_rmse"])
    interval = B.intervals(changes, ["cohort", "metric"], {"95": 95.0})
    rmse = {m: (F.sqrt(F.sum(f"sse_{m}") / F.sum("n")), F.sqrt(F.avg(F.col(f"sse_{m}") / F.col("n")))) for m in CORRECTION}
    wide = stats.groupBy("cohort").agg(F.sum("n").alias("n"), *[rmse[m][i].alias(f"{m}{i}") for m in CORRECTION for i in range(2)])
    points = wide.select("cohort", "n", F.inline(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"base{i}").alias("base"), F.col(f"corrected{i}").alias("corrected")) for i, name in enumerate(("rmse", "entity_rmse"))])))
    alphas = rows.groupBy("cohort").agg(F.max("alpha").alias("alpha"))
    out = points.join(interval, ["cohort", "metric"]).join(alphas, "cohort")
    return out.select("cohort", "metric", "alpha", "n", *t6("base", "corrected", "ci95_low", "ci95_high"), tidy(F.col("corrected") - F.col("base")).alias("delta"))


@query("md11")
def md11(t):
    """Correction on embeddings: searched, refitted on all residuals, scored on the evaluation with its interval."""
    return correction_report(t, ["all"])


@query("md16")
def md16(t):
    """The same when rows are filtered to a strict cohort before the alpha search."""
    return correction_report(t, ["no_event", "strict"])


@query("md11_search")
def md11_search(t):
    """The alpha search itself for every cohort, on embeddings."""
    found = alpha_search(t, image_vectors(t))
    out = found.join(best_alpha(found).select("cohort", F.col("alpha").alias("best")), "cohort")
    return out.select("cohort", "alpha", "n", *t6("q4_rmse"), tidy(1 - F.col("sse") / F.col("base_sse")).alias("partial_r2"), (F.col("alpha") == F.col("best")).alias("chosen"))


def centred_sql(y: str) -> str:
    c = lambda a, b: f"count(*) * covar_pop({a}, {b})"
    return f"avg(x1) AS m1, avg(x2) AS m2, avg({y}) AS my, {c('x1', 'x1')} AS s11, {c('x1', 'x2')} AS s12, {c('x2', 'x2')} AS s22, {c('x1', y)} AS t1, {c('x2', y)} AS t2"


COHORTS_SQL = "(VALUES ('all'), ('no_event'), ('strict')) c(cohort) WHERE cohort = 'all' OR (evt <> 'R' AND (cohort = 'no_event' OR prior_n >= 40))"
LINE_SQL = "(my + (x1 - m1) * b1 + (x2 - m2) * b2)"


@query("md11_traits", f"""WITH {FOLD_CTES}, {X2}, fm AS (SELECT fold, {centred_sql('y')} FROM fold_rows JOIN px USING (entity) WHERE role = 'train' GROUP BY 1), fb AS (SELECT *, {ridge_sql('1.0')} FROM fm),
res AS (SELECT v.fold, v.evt, v.prior_n, x1, x2, y - {LINE_SQL} AS r FROM fold_rows v JOIN px USING (entity) JOIN fb ON fb.fold = v.fold WHERE role = 'valid'),
co AS (SELECT cohort, res.* FROM res CROSS JOIN {COHORTS_SQL}),
em AS (SELECT cohort, {centred_sql('r')} FROM co WHERE fold <> '{LAST_QUARTER}' GROUP BY 1), am AS (SELECT cohort, {centred_sql('r')} FROM co GROUP BY 1),
al(alpha) AS (VALUES (0.0::DOUBLE), (1e2), (1e3), (1e4), (1e5), (1e6)),
eb AS (SELECT *, {ridge_sql('alpha')} FROM em CROSS JOIN al), ab AS (SELECT *, {ridge_sql('alpha')} FROM am CROSS JOIN al),
q4 AS (SELECT cohort, alpha, round(sqrt(avg(power(r - CASE WHEN alpha = 0 THEN 0 ELSE {LINE_SQL} END, 2))), 12) AS e FROM co JOIN eb USING (cohort) WHERE fold = '{LAST_QUARTER}' GROUP BY 1, 2),
best AS (SELECT cohort, alpha FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY e, alpha) AS k FROM q4) WHERE k = 1),
tb AS (SELECT *, {ridge_sql('1.0')} FROM (SELECT {centred_sql('y')} FROM train JOIN px USING (entity))),
ev AS (SELECT cohort, y, x1, x2, {LINE_SQL} AS p FROM evaluation JOIN px USING (entity) CROSS JOIN tb CROSS JOIN {COHORTS_SQL})
SELECT ev.cohort, alpha, count(*) AS n, round(sqrt(avg(power(y - p, 2))), 6) AS base, round(sqrt(avg(power(y - p - CASE WHEN alpha = 0 THEN 0 ELSE {LINE_SQL} END, 2))), 6) AS corrected
FROM ev JOIN best USING (cohort) JOIN ab USING (cohort, alpha) GROUP BY 1, 2""")
def md11_traits(t):
    """The whole correction on two traits, where every fit has a closed form."""
    rows = corrected(t, small(t).select("entity", "x"), "traits")
    e = lambda m: F.sqrt(F.avg((F.col("y") - F.col(f"p_{m}")) * (F.col("y") - F.col(f"p_{m}"))))
    return rows.groupBy("cohort", "alpha").agg(F.count(F.lit(1)).alias("n"), *[tidy(e(m)).alias(m) for m in CORRECTION])
