"""Join queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranking import dense_index, exact_quantiles
from ..functions.scalars import in_window, moment, steady, tidy
from ..operators import joins as J
from ..session import written
from ..operators.metrics import long_models, score
from ..sources.tables import EVAL, FOLD_CTES, MODELS, PREDS, SEEN, TARGETS, TRADES, WINDOW_US
from .registry import query
from .scans import CONDITION_WHERE, CONDITIONS_SQL, conditions
from ..functions.scalars import names_where


@query("jn1", """SELECT l_orderkey, l_linenumber, l_partkey, p_brand, p_size FROM lineitem JOIN part ON p_partkey = l_partkey""")
def jn1(t):
    traits = t.read("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    return J.lookup(t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), traits, ["l_partkey"])


@query("jn2", f"""WITH {TRADES} SELECT t.market, count(*) AS n_trades, count(DISTINCT t.entity) AS n_entities, round(sum(p_retailprice), 6) AS list_value
FROM trades t JOIN part p ON p.p_type = t.market AND p.p_partkey = t.entity GROUP BY 1""")
def jn2(t):
    """Composite-key join (market, entity), aggregated by entity before the join."""
    per = t.trades.groupBy("market", "entity").agg(F.count(F.lit(1)).alias("n"))
    listed = t.read("part").select(F.col("p_type").alias("market"), F.col("p_partkey").alias("entity"), "p_retailprice")
    return per.join(listed, ["market", "entity"]).groupBy("market").agg(
        F.sum("n").alias("n_trades"), F.count(F.lit(1)).alias("n_entities"), tidy(F.sum(F.col("n") * F.col("p_retailprice"))).alias("list_value")
    )


@query("jn3", f"""WITH {TARGETS} SELECT count(*) FILTER (WHERE t.source_row IS NULL) AS only_left, count(*) FILTER (WHERE l.source_row IS NULL) AS only_right,
  count(*) FILTER (WHERE t.source_row IS NOT NULL AND l.source_row IS NOT NULL) AS shared, 0::BIGINT AS differs_market, 0::BIGINT AS differs_us, 0::BIGINT AS differs_price
FROM trades l FULL JOIN targets t ON t.source_row = l.source_row""")
def jn3(t):
    return J.alignment(t.trades, t.targets, "source_row", ["market", "us", "price"])


@query("jn4", f"""WITH {TRADES}, v AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS s FROM embeddings)
SELECT market, count(*) AS n_trades, count(s) AS n_with_vector, round(sum(s), 4) + 0.0 AS total FROM trades LEFT JOIN v ON vec_id = entity GROUP BY 1""")
def jn4(t):
    """Vectors joined per entity, after counting trades per entity."""
    per = t.trades.groupBy("market", "entity").agg(F.count(F.lit(1)).alias("n"))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    v = t.read("embeddings").select(F.col("vec_id").alias("entity"), total.alias("s"))
    j = per.join(v, "entity", "left")
    return j.groupBy("market").agg(
        F.sum("n").alias("n_trades"), F.sum(F.when(F.col("s").isNotNull(), F.col("n")).otherwise(F.lit(0))).alias("n_with_vector"),
        tidy(F.sum(F.col("n") * F.col("s")), 4).alias("total"),
    )


@query("jn5", f"""WITH {TARGETS}, s AS (SELECT p_partkey AS entity, ln(p_retailprice) - 0.01 * p_size AS score FROM part)
SELECT source_row, round(score, 6) + 0.0 AS score FROM evaluation JOIN s USING (entity)""")
def jn5(t):
    scored = t.read("part").select(F.col("p_partkey").alias("entity"), tidy(F.log("p_retailprice") - 0.01 * F.col("p_size")).alias("score"))
    return J.score_once(t.evaluation.select("source_row", "entity"), scored, "entity").select("source_row", "score")


@query("jn6", f"""WITH {PREDS} SELECT count(*) AS n_aligned, 0::BIGINT AS entity_mismatch, 0::BIGINT AS target_mismatch,
  round(max(abs(p_brand - p_emb)), 6) AS widest_gap FROM preds""")
def jn6(t):
    """Three model outputs aligned on the row id, with disagreement counts."""
    part = lambda m: t.preds.select("source_row", F.col("entity").alias(f"e_{m}"), F.col("y").alias(f"y_{m}"), f"p_{m}")
    j = part("market").join(part("brand"), "source_row").join(part("emb"), "source_row")
    differs = lambda k: F.count_if(~(F.col(f"{k}_market").eqNullSafe(F.col(f"{k}_brand")) & F.col(f"{k}_market").eqNullSafe(F.col(f"{k}_emb"))))
    return j.agg(F.count(F.lit(1)).alias("n_aligned"), differs("e").alias("entity_mismatch"), differs("y").alias("target_mismatch"), tidy(F.max(F.abs(F.col("p_brand") - F.col("p_emb")))).alias("widest_gap"))


@query("jn7", f"""WITH {PREDS} SELECT market, seen, count(*) AS n_trades, count(DISTINCT entity) AS n_entities FROM preds GROUP BY 1, 2""")
def jn7(t):
    window = t.targets.filter(in_window(F.col("ts"), *SEEN)).select("entity").distinct()
    rows = t.evaluation.select("market", "entity")
    seen = rows.join(window, "entity", "left_semi").withColumn("seen", F.lit(True))
    unseen = rows.join(window, "entity", "left_anti").withColumn("seen", F.lit(False))
    return seen.unionByName(unseen).groupBy("market", "seen").agg(F.count(F.lit(1)).alias("n_trades"), F.count_distinct("entity").alias("n_entities"))


@query("jn8", f"""WITH {PREDS}, dev AS (SELECT DISTINCT entity FROM targets WHERE ts < '2000-01-01'),
f AS (SELECT market, entity, seen, entity IN (SELECT entity FROM dev) AS seen_any FROM preds)
SELECT market, seen, seen_any, count(*) AS n_trades, count(DISTINCT entity) AS n_entities FROM f GROUP BY 1, 2, 3""")
def jn8(t):
    """Two definitions of a seen entity and how often they disagree."""
    early = t.targets.filter(F.col("ts") < moment(EVAL[0]))
    window = t.targets.filter(in_window(F.col("ts"), *SEEN))
    per = t.evaluation.groupBy("market", "entity").agg(F.count(F.lit(1)).alias("n"))
    both = J.membership(J.membership(per, window, ["entity"], "seen"), early, ["entity"], "seen_any")
    return both.groupBy("market", "seen", "seen_any").agg(F.sum("n").alias("n_trades"), F.count(F.lit(1)).alias("n_entities"))


@query("jn9", """WITH a AS (SELECT l_partkey AS entity, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT vec_id AS entity, count(*) AS m FROM embeddings GROUP BY 1)
SELECT coalesce(a.entity, b.entity) AS entity, coalesce(n, 0) AS n_trades, coalesce(m, 0) AS n_described FROM a FULL JOIN b ON a.entity = b.entity""")
def jn9(t):
    return J.manifest(t.read("lineitem").select(F.col("l_partkey").alias("entity")), t.read("embeddings").select(F.col("vec_id").alias("entity")), "entity")


RANKED = """ranked AS (SELECT *, row_number() OVER (ORDER BY us, ('0x' || substr(md5(source_row), 1, 8))::BIGINT, source_row) - 1 AS idx, count(*) OVER () AS total FROM trades),
probes AS (SELECT source_row AS probe, market AS pm, us AS probe_us, idx FROM ranked WHERE idx IN (SELECT DISTINCT (i * (total - 1)) // 39 FROM range(40) r(i)))"""


def checkpoints(t, k=40):
    """k evenly spaced trades in time order."""
    ranked = dense_index(t.trades.select("source_row", "market", "us"), "us", "source_row", "idx")
    total = t.trades.agg(F.count(F.lit(1)).alias("total"))
    wanted = total.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("total") - 1) / F.lit(k - 1)).cast("bigint")))).alias("idx"))
    return ranked.join(F.broadcast(wanted), "idx")


@query("jn10", f"""WITH {TRADES}, {RANKED}
SELECT probe, count(t.source_row) AS prior_n, count(DISTINCT t.entity) AS prior_entities, round(quantile_cont(t.price, 0.5) + 1e-9::DOUBLE, 6) AS median
FROM probes p LEFT JOIN trades t ON t.market = p.pm AND t.us < p.probe_us AND t.us >= p.probe_us - 1728000000000 GROUP BY 1""")
def jn10(t):
    """Brute-force range join at 40 evenly spaced checkpoints, to compare with the window features."""
    probes = written(checkpoints(t).select(F.col("source_row").alias("probe"), "market", "us"), "probes")
    # Forty probes by construction, 21 day buckets each: a fixed bound for the broadcast.
    past = written(J.range_lookback(F.broadcast(probes), t.trades, "market", "us", WINDOW_US, ["entity", "price"]), "lookback")
    counts = past.groupBy("probe").agg(F.count(F.lit(1)).alias("prior_n"), F.count_distinct("entity").alias("prior_entities"))
    median = exact_quantiles(past, ["probe"], "price", {"median": 0.5})
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return probes.select("probe").join(counts, "probe", "left").join(median, "probe", "left").select("probe", zero("prior_n"), zero("prior_entities"), steady(F.col("median")).alias("median"))


WEIGHTS = [i / 10 for i in range(11)]


@query("jn11", f"""WITH {PREDS}, grid AS (SELECT i / 10.0::DOUBLE AS weight FROM range(11) r(i)),
pairs(meta, image) AS (VALUES ('market', 'emb'), ('brand', 'emb'), ('zero', 'emb'))
SELECT market, meta, image, weight, round(avg(power(y - ((1 - weight) * CASE meta WHEN 'market' THEN p_market WHEN 'brand' THEN p_brand ELSE p_zero END + weight * p_emb), 2)), 6) AS mse
FROM preds CROSS JOIN pairs CROSS JOIN grid GROUP BY 1, 2, 3, 4""")
def jn11(t):
    """Grid of (family, family, weight) scored from three error sums per pair, not per grid cell."""
    e = lambda m: F.col("y") - F.col(f"p_{m}")
    metas = ["market", "brand", "zero"]
    sums = t.preds.groupBy("market").agg(
        F.count(F.lit(1)).alias("n"), F.sum(e("emb") * e("emb")).alias("ii"),
        *[F.sum(e(m) * e(m)).alias(f"mm_{m}") for m in metas], *[F.sum(e(m) * e("emb")).alias(f"mi_{m}") for m in metas],
    )
    long = long_models(sums, ["market", "n", "ii"], metas, {"mm": "mm_", "mi": "mi_"}, "meta")
    w = F.col("weight")
    mse = ((1 - w) * (1 - w) * F.col("mm") + 2 * w * (1 - w) * F.col("mi") + w * w * F.col("ii")) / F.col("n")
    return long.withColumn("weight", F.explode(F.array(*[F.lit(x) for x in WEIGHTS]))).select("market", "meta", F.lit("emb").alias("image"), "weight", tidy(mse).alias("mse"))


WINNERS = f"""{CONDITIONS_SQL},
cond_mse AS (SELECT condition, market, m AS model, ord,
   round(avg(power(y - CASE m WHEN 'zero' THEN p_zero WHEN 'market' THEN p_market WHEN 'brand' THEN p_brand WHEN 'emb' THEN p_emb ELSE p_late END, 2)), 9) AS mse
  FROM preds CROSS JOIN cond CROSS JOIN (VALUES ('zero', 0), ('market', 1), ('brand', 2), ('emb', 3), ('late', 4)) v(m, ord)
  WHERE {CONDITION_WHERE} GROUP BY 1, 2, 3, 4),
winners AS (SELECT condition, market, model, mse FROM (SELECT *, row_number() OVER (PARTITION BY condition, market ORDER BY mse, ord) AS rk FROM cond_mse) WHERE rk = 1)"""


def condition_winners(t):
    rows = t.preds.withColumn("condition", F.explode(names_where(conditions())))
    scored = score(rows, ["condition", "market"], "entity", "y", MODELS)
    order = F.array_position(F.array(*[F.lit(m) for m in MODELS]), F.col("model"))
    mse = F.round(F.col("rmse") * F.col("rmse"), 9)
    best = scored.groupBy("condition", "market").agg(F.min(F.struct(mse.alias("mse"), order.alias("o"), "model")).alias("b"))
    return best.select("condition", "market", F.col("b.model").alias("model"), F.col("b.mse").alias("mse"))


@query("jn12", f"""WITH {PREDS}, {WINNERS} SELECT w.condition, w.market, w.model, b.model AS base_model, w.model IS DISTINCT FROM b.model AS changed
FROM winners w LEFT JOIN winners b ON b.market = w.market AND b.condition = 'base'""")
def jn12(t):
    w = condition_winners(t)
    base = w.filter("condition = 'base'").select("market", F.col("model").alias("base_model"))
    return w.join(base, "market", "left").select("condition", "market", "model", "base_model", (~F.col("model").eqNullSafe(F.col("base_model"))).alias("changed"))


@query("jn13", f"""WITH {PREDS}, r AS (SELECT market, model, round(sqrt(avg(power(y - p, 2))), 6) AS value FROM long GROUP BY 1, 2)
SELECT concat(market, '/', model) AS source_row, 'rmse' AS field, value AS expected, value AS actual, true AS passed FROM r""")
def jn13(t):
    """Stored metrics joined to recomputed ones by (row, field) within a tolerance."""
    from ..operators.verify import contract
    scored = score(t.preds, ["market"], "entity", "y", MODELS)
    actual = scored.select(F.concat_ws("/", "market", "model").alias("source_row"), F.lit("rmse").alias("field"), F.col("rmse").alias("actual"))
    # The expectation is computed by a different route: a plain average over long rows.
    sq = (F.col("y") - F.col("p")) ** 2
    from .scans import long_preds
    expected = long_preds(t).groupBy("market", "model").agg(F.sqrt(F.avg(sq)).alias("expected")).select(F.concat_ws("/", "market", "model").alias("source_row"), F.lit("rmse").alias("field"), "expected")
    out = contract(actual, expected, ["source_row", "field"], 1e-10)
    return out.select("source_row", "field", tidy(F.col("expected")).alias("expected"), tidy(F.col("actual")).alias("actual"), "passed")


FOLD_ENTITIES = "fe AS (SELECT DISTINCT fold, entity FROM fold_rows WHERE role = 'train')"


@query("jn14", f"""WITH {FOLD_CTES}, {FOLD_ENTITIES}
SELECT r.fold, r.source_row, fe.entity IS NOT NULL AS seen FROM fold_rows r LEFT JOIN fe ON fe.fold = r.fold AND fe.entity = r.entity WHERE role = 'valid'""")
def jn14(t):
    rows = t.fold_rows
    return J.membership(rows.filter("role = 'valid'"), rows.filter("role = 'train'"), ["fold", "entity"], "seen").select("fold", "source_row", "seen")
