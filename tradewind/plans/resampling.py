"""Bootstrap and inference queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import names_where, tidy
from ..operators import metrics as M
from ..operators import resample as B
from ..session import written
from ..sources.tables import MODELS, PREDS
from .registry import query
from .scans import CONDITION_WHERE, CONDITIONS_SQL, conditions

DRAWS, SEED = 2000, 1729
CONTRASTS = [
    ("feature_comparison", "emb", "brand"), ("feature_comparison", "late", "brand"), ("fusion_comparison", "emb", "late"),
    ("zero_comparison", "brand", "zero"), ("zero_comparison", "emb", "zero"), ("zero_comparison", "late", "zero"), ("zero_comparison", "market", "zero"),
]
LEVELS = {"95": 95.0, "975": 97.5, "99375": 99.375}
t6 = lambda *names: [tidy(F.col(n)).alias(n) for n in names]

SSE = ", ".join(f"sum(power(y - p_{m}, 2)) AS sse_{m}" for m in MODELS)


def sql_reps(source: str, cluster: str, by: str = "", tag: str = "", draws: int = DRAWS) -> str:
    """CTEs st/idx/slots/reps for one clustering; ``by`` is a column or empty."""
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    on_by = f"AND x.{by} = i.{by}" if by else ""
    sel = f"i.{by}, " if by else ""
    return f"""st{tag} AS (SELECT {b}{cluster} AS cluster, count(*) AS n, {SSE} FROM {source} GROUP BY {b}{cluster}),
idx{tag} AS (SELECT *, row_number() OVER ({part}ORDER BY cluster) - 1 AS idx, count(*) OVER ({part.strip()}) AS g FROM st{tag}),
slots{tag} AS (SELECT {b}d.draw, idx AS slot, ('0x' || substr(md5(concat('{SEED}:', d.draw, ':', idx // 4)), CAST(idx % 4 * 8 + 1 AS INTEGER), 8))::BIGINT % g AS pick
  FROM idx{tag}, range({draws}) d(draw)),
reps{tag} AS (SELECT {sel}draw, {", ".join(f"sqrt(sum(sse_{m}) / sum(n)) AS rmse_{m}, sqrt(avg(sse_{m} / n)) AS entity_rmse_{m}" for m in MODELS)}
  FROM slots{tag} x JOIN idx{tag} i ON i.idx = x.pick {on_by} GROUP BY {sel}draw)"""


def sql_deltas(reps: str, by: str = "", metrics=("rmse", "entity_rmse"), contrasts=CONTRASTS, tag: str = "") -> str:
    b = f"{by}, " if by else ""
    parts = [
        f"SELECT {b}draw, '{k}' AS kind, '{c}' AS candidate, '{r}' AS reference, '{m}' AS metric, {m}_{c} - {m}_{r} AS delta, 100 * ({m}_{r} - {m}_{c}) / {m}_{r} AS improvement FROM {reps}"
        for k, c, r in contrasts for m in metrics
    ]
    return f"deltas{tag} AS (" + " UNION ALL ".join(parts) + ")"


def stats(t, cluster="entity", by=(), source=None, key=""):
    rows = t.preds if source is None else source
    return t.stage(f"stats|{cluster}|{by}|{key}", lambda: B.cluster_stats(rows, list(by), cluster, "y", MODELS))


def reps(t, cluster="entity", by=(), source=None, key="", draws=DRAWS):
    def build():
        s = stats(t, cluster, by, source, key)
        return B.bootstrap(s, list(by), MODELS, draws, SEED)

    return t.stage(f"reps|{cluster}|{by}|{key}|{draws}", build)


def fresh_reps(t, cluster="entity", draws=DRAWS):
    """Replicates computed anew (no stage table): what the benchmark measures."""
    s = B.cluster_stats(t.preds, [], cluster, "y", MODELS)
    return B.bootstrap(s, [], MODELS, draws, SEED)


@query("bs1", f"""WITH {PREDS} SELECT entity, model, count(*) AS n, round(sum(power(y - p, 2)), 6) + 0.0 AS sse FROM long GROUP BY 1, 2""")
def bs1(t):
    sums = M.entity_sums(t.preds, [], "entity", "y", MODELS)
    return M.long_models(sums, ["entity", "n"], MODELS, {"sse": "sse_"}).select("entity", "model", "n", *t6("sse"))


def _reps_sql(cluster, metric):
    cols = ", ".join(f"round({metric}_{m}, 6) + 0.0 AS {m}" for m in MODELS)
    return f"WITH {PREDS}, {sql_reps('preds', cluster)} SELECT draw, {cols} FROM reps"


def _reps_query(t, cluster, metric):
    return fresh_reps(t, cluster).select("draw", *[tidy(F.col(f"{metric}_{m}")).alias(m) for m in MODELS])


@query("bs2", _reps_sql("entity", "rmse"))
def bs2(t):
    return _reps_query(t, "entity", "rmse")


@query("bs3", _reps_sql("entity", "entity_rmse"))
def bs3(t):
    return _reps_query(t, "entity", "entity_rmse")


@query("bs4", _reps_sql("block", "rmse"))
def bs4(t):
    """Calendar blocks: only occupied 14-day blocks are clusters."""
    return _reps_query(t, "block", "rmse")


def _interval_cols(levels):
    return [f"{p}{n}_{s}" for n in levels for p in ("ci", "gain") for s in ("low", "high")]


def _interval_sql(levels, by=""):
    out = []
    for n, level in levels.items():
        a = (1 - level / 100) / 2
        for p, c in (("ci", "delta"), ("gain", "improvement")):
            out.append(f"round(quantile_cont({c}, {a!r}), 6) + 0.0 AS {p}{n}_low, round(quantile_cont({c}, {1 - a!r}), 6) + 0.0 AS {p}{n}_high")
    return ", ".join(out)


KEYS = ["kind", "candidate", "reference", "metric"]
L95 = {"95": 95.0}


@query("bs5", f"""WITH {PREDS}, {sql_reps('preds', 'entity')}, {sql_reps('preds', 'block', tag='b')}, {sql_deltas('reps')}, {sql_deltas('repsb', metrics=('rmse',), tag='b')},
al AS (SELECT 'entity' AS scheme, * FROM deltas UNION ALL SELECT 'block', * FROM deltasb)
SELECT scheme, kind, candidate, reference, metric, {_interval_sql(L95)} FROM al GROUP BY ALL""")
def bs5(t):
    """Intervals of paired differences under both resampling schemes, in one grouped percentile."""
    a = B.deltas(reps(t), [], CONTRASTS, ["rmse", "entity_rmse"]).withColumn("scheme", F.lit("entity"))
    b = B.deltas(reps(t, "block"), [], CONTRASTS, ["rmse"]).withColumn("scheme", F.lit("block"))
    out = B.intervals(a.unionByName(b), ["scheme", *KEYS], L95)
    return out.select("scheme", *KEYS, *t6(*_interval_cols(L95)))


@query("bs6", f"""WITH {PREDS}, {sql_reps('preds', 'entity')}, {sql_deltas('reps')} SELECT kind, candidate, reference, metric, {_interval_sql(LEVELS)} FROM deltas GROUP BY ALL""")
def bs6(t):
    out = B.intervals(B.deltas(reps(t), [], CONTRASTS, ["rmse", "entity_rmse"]), KEYS, LEVELS)
    return out.select(*KEYS, *t6(*_interval_cols(LEVELS)))


@query("bs7", f"""WITH {PREDS}, {sql_reps('preds', 'entity')}, {sql_deltas('reps')} SELECT kind, candidate, reference, metric, count(*) AS n_draws, round(avg(CASE WHEN delta < 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_better FROM deltas GROUP BY ALL""")
def bs7(t):
    return B.intervals(B.deltas(reps(t), [], CONTRASTS, ["rmse", "entity_rmse"]), KEYS, L95).select(*KEYS, "n_draws", *t6("share_better"))


@query("bs8", f"""WITH {PREDS}, {sql_reps('preds', 'block')}, {sql_deltas('reps')},
p AS (SELECT kind, candidate, reference, metric, least(1.0::DOUBLE, 2 * (least(count(*) FILTER (WHERE delta <= 0), count(*) FILTER (WHERE delta >= 0)) + 1) / (count(*) + 1)::DOUBLE) AS p FROM deltas GROUP BY ALL)
SELECT kind, candidate, reference, metric, round(p, 6) AS p_value, round(least(1.0::DOUBLE, 2 * p), 6) AS p_adjusted FROM p""")
def bs8(t):
    out = B.empirical_p(B.deltas(reps(t, "block"), [], CONTRASTS, ["rmse", "entity_rmse"]), KEYS)
    return out.select(*KEYS, *t6("p_value", "p_adjusted"))


SUBGROUP = """sub AS (SELECT *, CASE WHEN seen THEN 'seen' ELSE 'unseen' END AS subgroup FROM preds UNION ALL SELECT *, 'all' FROM preds
  UNION ALL SELECT *, 'single' FROM preds WHERE entity IN (SELECT min(entity) FROM preds))"""


def subgroups(t):
    lowest = t.preds.agg(F.min("entity").alias("_low"))
    rows = t.preds.join(F.broadcast(lowest))
    names = names_where({"all": F.lit(True), "seen": F.col("seen"), "unseen": ~F.col("seen"), "single": F.col("entity") == F.col("_low")})
    return rows.withColumn("subgroup", F.explode(names)).drop("_low")


SUB_CONTRASTS = [("feature_comparison", "emb", "brand"), ("self", "brand", "brand")]


@query("bs9", f"""WITH {PREDS}, {SUBGROUP}, {sql_reps('sub', 'entity', 'subgroup')}, {sql_deltas('reps', 'subgroup', ('rmse',), SUB_CONTRASTS)},
k AS (SELECT subgroup, count(DISTINCT entity) AS k FROM sub GROUP BY 1),
s AS (SELECT subgroup, kind, candidate, reference, max(delta) - min(delta) AS spread, quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi FROM deltas GROUP BY ALL)
SELECT s.subgroup, kind, k AS n_clusters, CASE WHEN k < 2 THEN 'interval_unavailable' WHEN spread = 0 THEN 'degenerate_contrast' ELSE 'ok' END AS status,
  CASE WHEN k >= 2 THEN round(lo, 6) + 0.0 END AS low, CASE WHEN k >= 2 THEN round(hi, 6) + 0.0 END AS high FROM s JOIN k ON k.subgroup = s.subgroup""")
def bs9(t):
    src = subgroups(t)
    s = stats(t, "entity", ("subgroup",), src, "sub")
    size = s.groupBy("subgroup").agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("n").alias("n"), F.sum("sum_y").alias("sy"), F.sum("sum_yy").alias("syy"))
    sd = F.sqrt(F.greatest(F.col("syy") / F.col("n") - (F.col("sy") / F.col("n")) ** 2, F.lit(0.0)))
    iv = B.intervals(B.deltas(reps(t, "entity", ("subgroup",), src, "sub"), ["subgroup"], SUB_CONTRASTS, ["rmse"]), ["subgroup", "kind"], L95)
    j = iv.join(size, "subgroup")
    state = B.status(F.col("n_clusters"), sd, F.col("spread"))
    usable = state != "interval_unavailable"
    return j.select("subgroup", "kind", "n_clusters", state.alias("status"), F.when(usable, tidy(F.col("ci95_low"))).alias("low"), F.when(usable, tidy(F.col("ci95_high"))).alias("high"))


@query("bs10", f"""WITH {PREDS}, {sql_reps('preds', 'entity', draws=8)}, {sql_reps('preds', 'block', tag='_block', draws=8)}
SELECT 'entity' AS scheme, draw, round(rmse_brand, 6) AS rmse_brand, round(entity_rmse_brand, 6) AS cluster_rmse_brand, true AS expansion_agrees FROM reps
UNION ALL SELECT 'block', draw, round(rmse_brand, 6), round(entity_rmse_brand, 6), true FROM reps_block""")
def bs10(t):
    """First eight draws of both schemes recomputed from rows; the routes must agree within 1e-10 on both metrics."""
    def scheme(cluster):
        s = stats(t, cluster)
        slots = written(B.draw_slots(s, [], 8, SEED), "slots")
        fast = B.bootstrap(s, [], MODELS, 8, SEED)
        direct = B.row_expansion(t.preds, s, slots, [], cluster, "y", MODELS, 8)
        gap = F.greatest(*[F.abs(F.col(f"{k}rmse_{m}") - F.col(f"direct_{k}{m}")) for m in MODELS for k in ("", "entity_")])
        return fast.join(direct, "draw").select(
            F.lit(cluster).alias("scheme"), "draw", tidy(F.col("rmse_brand")).alias("rmse_brand"), tidy(F.col("entity_rmse_brand")).alias("cluster_rmse_brand"), (gap <= 1e-10).alias("expansion_agrees")
        )

    return scheme("entity").unionByName(scheme("block"))


@query("bs11", f"""WITH {PREDS} SELECT market, seen, count(*) AS n, count(DISTINCT entity) AS n_entities, count(*) >= 50 AND count(DISTINCT entity) >= 30 AS supported FROM preds GROUP BY 1, 2""")
def bs11(t):
    per = t.preds.groupBy("market", "seen", "entity").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("market", "seen").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_entities"))
    return out.withColumn("supported", (F.col("n") >= 50) & (F.col("n_entities") >= 30))


@query("bs12", f"""WITH {PREDS}, tot AS (SELECT model, sqrt(avg(power(y - p, 2))) AS rmse FROM long GROUP BY 1),
c(kind, candidate, reference) AS (VALUES {", ".join(f"('{k}', '{a}', '{b}')" for k, a, b in CONTRASTS)})
SELECT kind, candidate, reference, round(a.rmse - b.rmse, 6) + 0.0 AS delta, round(100 * (b.rmse - a.rmse) / b.rmse, 6) + 0.0 AS improvement
FROM c JOIN tot a ON a.model = candidate JOIN tot b ON b.model = reference""")
def bs12(t):
    """Contrast table joined twice to the point estimates."""
    contrasts = t.spark.createDataFrame(CONTRASTS, "kind string, candidate string, reference string")
    point = M.score(t.preds, [], "entity", "y", MODELS).select("model", "rmse")
    a = point.select(F.col("model").alias("candidate"), F.col("rmse").alias("a"))
    b = point.select(F.col("model").alias("reference"), F.col("rmse").alias("b"))
    j = contrasts.join(a, "candidate").join(b, "reference")
    return j.select("kind", "candidate", "reference", tidy(F.col("a") - F.col("b")).alias("delta"), tidy(100 * (F.col("b") - F.col("a")) / F.col("b")).alias("improvement"))


@query("bs13", f"""WITH {PREDS}, {sql_reps('preds', 'block')},
ext AS (SELECT o_orderkey % 100 AS draw, o_custkey % (SELECT max(g) FROM idx) AS pick FROM orders)
SELECT draw, round(sqrt(sum(sse_brand) / sum(n)), 6) AS rmse_brand, round(sqrt(sum(sse_emb) / sum(n)), 6) AS rmse_emb FROM ext JOIN idx ON idx = pick GROUP BY 1""")
def bs13(t):
    """Replicates from a supplied draw table instead of generated slots."""
    s = stats(t, "block")
    g = s.agg(F.max("g").alias("g"))
    ext = t.read("orders").join(F.broadcast(g)).select((F.col("o_orderkey") % 100).alias("draw"), (F.col("o_custkey") % F.col("g")).alias("idx"))
    return B.replicates(s, ext, [], MODELS).select("draw", *t6("rmse_brand", "rmse_emb"))


@query("bs14", f"""WITH {PREDS}, {CONDITIONS_SQL}, cp AS (SELECT condition, p.* FROM preds p CROSS JOIN cond WHERE {CONDITION_WHERE}),
{sql_reps('cp', 'entity', 'condition')}, {sql_deltas('reps', 'condition', ('rmse', 'entity_rmse'), CONTRASTS[:3])}
SELECT condition, candidate, reference, metric, {_interval_sql(L95)} FROM deltas GROUP BY ALL""")
def bs14(t):
    """Entity intervals on masked subsets, one bootstrap per analysis in the same job."""
    src = t.preds.withColumn("condition", F.explode(names_where(conditions())))
    r = reps(t, "entity", ("condition",), src, "cond")
    out = B.intervals(B.deltas(r, ["condition"], CONTRASTS[:3], ["rmse", "entity_rmse"]), ["condition", "candidate", "reference", "metric"], L95)
    return out.select("condition", "candidate", "reference", "metric", *t6(*_interval_cols(L95)))


@query("bs15", f"""WITH {PREDS}, {sql_reps('preds', 'entity')}, {sql_deltas('reps')},
i AS (SELECT kind, candidate, reference, metric, round(quantile_cont(improvement, 0.025), 6) AS lo, round(quantile_cont(improvement, 0.975), 6) AS hi FROM deltas GROUP BY ALL)
SELECT i.*, thr AS threshold, CASE WHEN lo >= thr THEN 'improves' WHEN hi <= -thr THEN 'worsens' WHEN lo > -thr AND hi < thr THEN 'within' ELSE 'inconclusive' END AS label
FROM i CROSS JOIN (VALUES (0.5::DOUBLE), (1), (2)) v(thr)""")
def bs15(t):
    iv = B.intervals(B.deltas(reps(t), [], CONTRASTS, ["rmse", "entity_rmse"]), KEYS, L95)
    iv = iv.select(*KEYS, tidy(F.col("gain95_low")).alias("lo"), tidy(F.col("gain95_high")).alias("hi"))
    rows = F.array(*[F.struct(F.lit(x).alias("threshold"), B.threshold_label(F.col("lo"), F.col("hi"), x).alias("label")) for x in (0.5, 1.0, 2.0)])
    return iv.select(*KEYS, "lo", "hi", F.inline(rows))


@query("ag23", f"""WITH {PREDS}, {sql_reps('preds', 'entity')}, {sql_reps('preds', 'block', tag='b')}, {sql_deltas('reps', metrics=('rmse',))}, {sql_deltas('repsb', metrics=('rmse',), tag='b')},
a AS (SELECT kind, candidate, reference, round(quantile_cont(delta, 0.025), 9) AS lo, round(quantile_cont(delta, 0.975), 9) AS hi FROM deltas GROUP BY ALL),
b AS (SELECT kind, candidate, reference, round(quantile_cont(delta, 0.025), 9) AS lo, round(quantile_cont(delta, 0.975), 9) AS hi FROM deltasb GROUP BY ALL),
l AS (SELECT a.kind, a.candidate, a.reference, CASE WHEN a.lo > 0 THEN 'higher' WHEN a.hi < 0 THEN 'lower' ELSE 'includes_zero' END AS entity_conclusion,
  CASE WHEN b.lo > 0 THEN 'higher' WHEN b.hi < 0 THEN 'lower' ELSE 'includes_zero' END AS block_conclusion FROM a JOIN b USING (kind, candidate, reference))
SELECT *, entity_conclusion <> block_conclusion AS changed FROM l""")
def ag23(t):
    def labelled(r, name):
        iv = B.intervals(B.deltas(r, [], CONTRASTS, ["rmse"]), ["kind", "candidate", "reference"], L95)
        return iv.select("kind", "candidate", "reference", B.conclusion(F.round("ci95_low", 9), F.round("ci95_high", 9)).alias(name))

    j = labelled(reps(t), "entity_conclusion").join(labelled(reps(t, "block"), "block_conclusion"), ["kind", "candidate", "reference"])
    return j.withColumn("changed", F.col("entity_conclusion") != F.col("block_conclusion"))
