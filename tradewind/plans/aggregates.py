"""Aggregation queries: metrics, cohort counts, summaries and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ranking import exact_quantiles
from ..functions.scalars import hash_number, in_window, moment, names_where, normalize_category, tidy
from ..operators import metrics as M
from ..operators import cleaning as C
from ..operators.joins import membership
from ..sources.tables import ALPHAS, EVAL, FOLD_CTES, MODELS, PREDS, SCORES, TARGETS, TRADES
from .cleaning import CLEAN, MULTI, PAIRS, ledger_stage, with_multi, with_pairs
from .registry import query
from .scans import ASINH, MASKS_SQL, asinh_parameters, masks

t6 = lambda *names: [tidy(F.col(n)).alias(n) for n in names]
n_rows = lambda name="n": F.count(F.lit(1)).alias(name)


@query("ag1", f"""WITH {PREDS} SELECT market, model, count(*) AS n, round(sqrt(avg(power(y - p, 2))), 6) + 0.0 AS rmse, round(avg(abs(y - p)), 6) + 0.0 AS mae,
  round(1 - sum(power(y - p, 2)) / (count(*) * var_pop(y)), 6) + 0.0 AS r2 FROM long GROUP BY 1, 2""")
def ag1(t):
    return M.score(t.preds, ["market"], "entity", "y", MODELS).select("market", "model", "n", *t6("rmse", "mae", "r2"))


@query("ag2", f"""WITH {PREDS}, e AS (SELECT market, model, entity, avg(power(y - p, 2)) AS m FROM long GROUP BY 1, 2, 3)
SELECT market, model, count(*) AS n_entities, round(sqrt(avg(m)), 6) + 0.0 AS entity_rmse FROM e GROUP BY 1, 2""")
def ag2(t):
    return M.score(t.preds, ["market"], "entity", "y", MODELS).select("market", "model", "n_entities", *t6("entity_rmse"))


BALANCED = """w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY market, model, entity) AS w FROM long),
mu AS (SELECT market, model, sum(w * y) / sum(w) AS m FROM w GROUP BY 1, 2)"""


@query("ag3", f"""WITH {PREDS}, {BALANCED}
SELECT w.market, w.model, count(*) AS n, count(DISTINCT entity) AS n_entities, round(sqrt(sum(w * power(y - p, 2)) / sum(w)), 6) + 0.0 AS rmse,
  round(sum(w * abs(y - p)) / sum(w), 6) + 0.0 AS mae, round(1 - sum(w * power(y - p, 2)) / sum(w * power(y - m, 2)), 6) + 0.0 AS r2,
  round(sqrt(sum(w * power(y - m, 2)) / sum(w)), 6) + 0.0 AS target_sd FROM w JOIN mu ON mu.market = w.market AND mu.model = w.model GROUP BY 1, 2""")
def ag3(t):
    return M.balanced_score(t.preds, ["market"], "entity", "y", MODELS).select("market", "model", "n", "n_entities", *t6("rmse", "mae", "r2", "target_sd"))


@query("ag4", f"""WITH {SCORES} SELECT market, fold, feature, config, s.n, round(sse, 6) AS sse, round(v.sst, 6) AS sst, round(sqrt(sse / s.n), 6) AS rmse
FROM scores s JOIN (SELECT market, fold, count(*) * var_pop(y) AS sst FROM fold_rows WHERE role = 'valid' GROUP BY 1, 2) v USING (market, fold)""")
def ag4(t):
    """Metrics kept with their sums, so folds can be pooled later."""
    sst = t.fold_rows.filter("role = 'valid'").groupBy("market", "fold").agg((F.count(F.lit(1)) * F.var_pop("y")).alias("sst"))
    return t.scores.join(sst, ["market", "fold"]).select("market", "fold", "feature", "config", "n", *t6("sse", "sst"), tidy(F.sqrt(F.col("sse") / F.col("n"))).alias("rmse"))


MIN_VALID = 340


@query("ag5", f"""WITH {SCORES} SELECT market, feature, config, CAST(sum(n) AS BIGINT) AS n, bool_and(n >= {MIN_VALID}) AS valid,
  CASE WHEN bool_and(n >= {MIN_VALID}) THEN round(sum(sse) / sum(n), 6) END AS mse FROM scores GROUP BY 1, 2, 3""")
def ag5(t):
    from ..operators.select import pool
    return pool(t.scores.withColumn("valid", F.col("n") >= MIN_VALID), ["market", "feature", "config"]).select("market", "feature", "config", "n", "valid", F.round("mse", 6).alias("mse"))


@query("ag6", f"""WITH {CLEAN}, s AS (SELECT CASE WHEN ts < '2000-01-01' THEN 'development' WHEN ts < '2001-06-01' THEN 'temporal_test' ELSE 'outside' END AS period, entity, stage
  FROM ledger CROSS JOIN (VALUES ('raw'), ('unique'), ('single'), ('clean')) v(stage)
  WHERE stage = 'raw' OR (stage = 'unique' AND step > 2) OR (stage = 'single' AND step > 7) OR (stage = 'clean' AND step > 12))
SELECT period, stage, count(*) AS n_trades, count(DISTINCT entity) AS n_entities FROM s GROUP BY 1, 2""")
def ag6(t):
    """Trades and entities per period and cleaning stage; entities counted once per period first."""
    from ..functions.scalars import period_label
    step = F.col("step")
    stages = names_where({"raw": F.lit(True), "unique": step > 2, "single": step > 7, "clean": step > 12})
    rows = ledger_stage(t).select(period_label(F.col("ts"), "2000-01-01", "2001-06-01").alias("period"), "entity", F.explode(stages).alias("stage"))
    per = rows.groupBy("period", "stage", "entity").agg(n_rows())
    return per.groupBy("period", "stage").agg(F.sum("n").alias("n_trades"), F.count("entity").alias("n_entities"))


@query("ag7", f"""WITH {CLEAN} SELECT coalesce(market, '*') AS market, coalesce(CAST(year(ts) AS VARCHAR), '*') AS year, count(*) AS n_raw, count(*) FILTER (WHERE base_clean) AS n_clean,
  count(*) FILTER (WHERE price IS NULL OR isnan(price)) AS n_missing FROM ledger GROUP BY ROLLUP (market, CAST(year(ts) AS VARCHAR))""".replace("coalesce(CAST(year(ts) AS VARCHAR), '*')", "coalesce(CAST(year(ts) AS VARCHAR), '*')"))
def ag7(t):
    rows = ledger_stage(t).withColumn("year", F.year("ts").cast("string"))
    missing = F.col("price").isNull() | F.isnan("price")
    r = rows.rollup("market", "year").agg(n_rows("n_raw"), F.count_if("base_clean").alias("n_clean"), F.count_if(missing).alias("n_missing"))
    return r.select(F.coalesce("market", F.lit("*")).alias("market"), F.coalesce("year", F.lit("*")).alias("year"), "n_raw", "n_clean", "n_missing")


@query("ag8", f"""WITH {TRADES}, c AS (SELECT market, entity, count(*) AS sales FROM trades GROUP BY 1, 2) SELECT market, sales, count(*) AS n_entities FROM c GROUP BY 1, 2""")
def ag8(t):
    return t.trades.groupBy("market", "entity").agg(n_rows("sales")).groupBy("market", "sales").agg(n_rows("n_entities"))


@query("ag9", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def ag9(t):
    return t.read("lineitem").groupBy("l_returnflag", "l_linestatus").agg(n_rows())


TRAITS = """dirty AS (SELECT p_partkey, p_brand AS brand, CASE WHEN p_partkey % 7 = 0 THEN ' None ' ELSE split_part(p_name, ' ', 1) END AS word,
  CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_type END AS kind FROM part)"""


def dirty_traits(t):
    k = F.col("p_partkey")
    return t.read("part").select(
        k, F.col("p_brand").alias("brand"), F.when(k % 7 == 0, F.lit(" None ")).otherwise(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("word"),
        F.when(k % 9 == 0, F.lit("")).otherwise(F.col("p_type")).alias("kind"),
    )


def cells(df, columns):
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])))


@query("ag10", f"""WITH {TRAITS} SELECT 'brand' AS "column", brand AS value, count(*) AS n FROM dirty GROUP BY 2 UNION ALL SELECT 'word', CASE WHEN trim(word) IN ('', 'None') THEN 'word_None' ELSE trim(word) END, count(*) FROM dirty GROUP BY 2
UNION ALL SELECT 'kind', CASE WHEN trim(kind) IN ('', 'None') THEN 'kind_None' ELSE trim(kind) END, count(*) FROM dirty GROUP BY 2""")
def ag10(t):
    """Category inventory, one row per (column, value); sort it where it is shown."""
    rows = dirty_traits(t)
    clean = rows.select(*[normalize_category(F.col(c), c).alias(c) for c in ("brand", "word", "kind")])
    return cells(clean, ["brand", "word", "kind"]).groupBy("column", "value").agg(n_rows())


@query("ag11", f"""WITH {TRAITS}, c AS (SELECT 'brand' AS "column", brand AS v FROM dirty UNION ALL SELECT 'word', word FROM dirty UNION ALL SELECT 'kind', kind FROM dirty)
SELECT "column", count(*) AS n, count(*) FILTER (WHERE trim(v) = '') AS n_blank, count(*) FILTER (WHERE trim(v) = 'None') AS n_marker FROM c GROUP BY 1""")
def ag11(t):
    v = F.trim("value")
    return cells(dirty_traits(t), ["brand", "word", "kind"]).groupBy("column").agg(n_rows(), F.count_if(v == "").alias("n_blank"), F.count_if(v == "None").alias("n_marker"))


@query("ag12", f"WITH {TARGETS}, {ASINH} SELECT c.market, round(med, 6) + 0.0 AS center, round(mad, 6) + 0.0 AS scale FROM center c JOIN spread s ON s.market = c.market")
def ag12(t):
    return asinh_parameters(t).select("market", *t6("center", "scale"))


@query("ag13", f"""WITH {TARGETS}, r AS (SELECT market, y, row_number() OVER (PARTITION BY market ORDER BY y) - 1 AS k, count(*) OVER (PARTITION BY market) AS n FROM targets)
SELECT market, any_value(n) AS n, round(min(y), 6) AS min_y, round(max(y) FILTER (WHERE k = round_even(0.01 * (n - 1), 0)), 6) AS q01, round(max(y) FILTER (WHERE k = round_even(0.5 * (n - 1), 0)), 6) + 0.0 AS median,
  round(max(y) FILTER (WHERE k = round_even(0.99 * (n - 1), 0)), 6) AS q99, round(max(y), 6) AS max_y, count(*) FILTER (WHERE y < 0) AS n_negative FROM r GROUP BY 1""")
def ag13(t):
    """Nearest-rank quantiles picked by counting, never by sorting a market in one task."""
    q = exact_quantiles(t.targets, ["market"], "y", {"q01": 0.01, "median": 0.5, "q99": 0.99}, nearest=True)
    s = t.targets.groupBy("market").agg(n_rows(), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.count_if(F.col("y") < 0).alias("n_negative"))
    return s.join(q, "market").select("market", "n", "n_negative", *t6("min_y", "q01", "median", "q99", "max_y"))


@query("ag14", f"""WITH {TARGETS}, {ASINH} SELECT t.market, entity, count(*) AS n, round(avg(asinh((y - med) / mad)), 6) + 0.0 AS mean_z
FROM train t JOIN center c ON c.market = t.market JOIN spread s ON s.market = t.market GROUP BY 1, 2""")
def ag14(t):
    from ..functions.scalars import robust_asinh
    rows = t.train.join(asinh_parameters(t), "market")
    return rows.groupBy("market", "entity").agg(n_rows(), tidy(F.avg(robust_asinh(F.col("y"), F.col("center"), F.col("scale")))).alias("mean_z"))


@query("ag15", f"""WITH {PREDS} SELECT market, round(sum(power(y - p_brand, 2)), 6) AS expanded_sse, true AS identity_holds FROM preds GROUP BY 1""")
def ag15(t):
    """Expanded SSE equals between-entity plus within-entity SSE for per-entity predictions."""
    e = F.col("y") - F.col("p_brand")
    per = t.preds.groupBy("market", "entity").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), (F.count(F.lit(1)) * F.var_pop("y")).alias("within"), F.first("p_brand").alias("p"), F.sum(e * e).alias("sse"))
    parts = per.groupBy("market").agg(F.sum("sse").alias("expanded"), F.sum(F.col("n") * (F.col("m") - F.col("p")) ** 2).alias("between"), F.sum("within").alias("within"))
    holds = F.abs(F.col("expanded") - F.col("between") - F.col("within")) <= 1e-9 * F.col("expanded")
    return parts.select("market", tidy(F.col("expanded")).alias("expanded_sse"), holds.alias("identity_holds"))


@query("ag16", f"""WITH {PREDS} SELECT market, model, round(avg(power(y - p, 2)), 6) AS mse, true AS mse_recombines, true AS mae_recombines FROM long GROUP BY 1, 2""")
def ag16(t):
    """Seen and unseen metrics recombine to the overall ones."""
    sums = M.entity_sums(t.preds, ["market", "seen"], "entity", "y", MODELS)
    part = M.score_sums(sums, ["market", "seen"], MODELS)
    whole = M.score_sums(M.rollup_entities(sums, ["market"], "entity", MODELS), ["market"], MODELS)
    joined = part.groupBy("market", "model").agg(
        (F.sum(F.col("n") * F.col("rmse") ** 2) / F.sum("n")).alias("mse_parts"), (F.sum(F.col("n") * F.col("mae")) / F.sum("n")).alias("mae_parts")
    ).join(whole, ["market", "model"])
    near = lambda a, b: F.abs(a - b) <= 1e-10
    return joined.select("market", "model", tidy(F.col("rmse") ** 2).alias("mse"), near(F.col("mse_parts"), F.col("rmse") ** 2).alias("mse_recombines"), near(F.col("mae_parts"), F.col("mae")).alias("mae_recombines"))


@query("ag17", f"""WITH {PREDS}, tot AS (SELECT market, count(*) AS n, count(DISTINCT entity) AS k FROM preds GROUP BY 1)
SELECT p.market, seen, round(count(*) / any_value(tot.n), 6) AS row_share, round(count(DISTINCT entity) / any_value(k), 6) AS entity_share, count(DISTINCT block) AS n_blocks,
  round(stddev_pop(y), 6) AS target_sd FROM preds p JOIN tot ON tot.market = p.market GROUP BY 1, 2""")
def ag17(t):
    """Shares per subgroup. Counts of entities and of blocks are each taken over their own groups."""
    rows = t.preds
    sums = rows.groupBy("market", "seen", "entity").agg(n_rows(), F.sum("y").alias("s"), F.sum(F.col("y") ** 2).alias("ss"))
    blocks = rows.groupBy("market", "seen", "block").agg(n_rows()).groupBy("market", "seen").agg(F.count(F.lit(1)).alias("n_blocks"))
    part = sums.groupBy("market", "seen").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    whole = part.groupBy("market").agg(F.sum("n").alias("tn"), F.sum("k").alias("tk"))
    mean = F.col("s") / F.col("n")
    return part.join(whole, "market").join(blocks, ["market", "seen"]).select(
        "market", "seen", tidy(F.col("n") / F.col("tn")).alias("row_share"), tidy(F.col("k") / F.col("tk")).alias("entity_share"), "n_blocks",
        tidy(F.sqrt(F.col("ss") / F.col("n") - mean * mean)).alias("target_sd"),
    )


@query("ag18", """WITH e AS (SELECT unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT dim, count(*) AS n, round(min(v), 6) + 0.0 AS min_v, round(max(v), 6) + 0.0 AS max_v, count(*) FILTER (WHERE isnan(v)) AS n_nan, count(*) FILTER (WHERE v = 'inf'::DOUBLE) AS n_pos_inf,
  count(*) FILTER (WHERE v = '-inf'::DOUBLE) AS n_neg_inf, min(v) = max(v) AS is_constant FROM e GROUP BY 1""")
def ag18(t):
    return dimension_audit(t.read("embeddings"), "embedding").select(F.col("dim").cast("bigint").alias("dim"), "n", *t6("min_v", "max_v"), "n_nan", "n_pos_inf", "n_neg_inf", "is_constant")


def dimension_audit(df, vector):
    from ..operators.vectors import dimension_audit as audit
    return audit(df, vector)


@query("ag19", f"""WITH {FOLD_CTES} SELECT fold, role, count(*) AS n, CAST(sum(('0x' || substr(md5(source_row), 1, 8))::BIGINT) AS BIGINT) AS hash_sum,
  max(md5(source_row)) AS hash_max FROM fold_rows GROUP BY 1, 2""")
def ag19(t):
    """Order-free fingerprint of row sets: additive, so it needs no sorted list of ids."""
    return t.fold_rows.groupBy("fold", "role").agg(n_rows(), F.sum(hash_number(F.col("source_row"))).alias("hash_sum"), F.max(F.md5("source_row")).alias("hash_max"))


@query("ag20", f"""WITH {PREDS} SELECT market, round(1 - sum(power(y - p_late, 2)) / sum(power(y - p_brand, 2)), 6) + 0.0 AS partial_r2 FROM preds GROUP BY 1""")
def ag20(t):
    sq = lambda m: F.sum((F.col("y") - F.col(f"p_{m}")) ** 2)
    return t.preds.groupBy("market").agg(tidy(1 - sq("late") / sq("brand")).alias("partial_r2"))


@query("ag21", "SELECT c_acctbal AS value, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def ag21(t):
    return t.read("customer").groupBy(F.col("c_acctbal").alias("value")).agg(n_rows()).filter("n > 1")


@query("ag22", f"""WITH {FOLD_CTES}, tr AS (SELECT * FROM fold_rows WHERE role = 'train'), va AS (SELECT * FROM fold_rows WHERE role = 'valid'),
u AS (SELECT fold, source_row,
   (fold, CAST(entity AS VARCHAR)) NOT IN (SELECT (fold, CAST(entity AS VARCHAR)) FROM tr) AS u_entity,
   (fold, concat(brand, word1, size_band)) NOT IN (SELECT (fold, concat(brand, word1, size_band)) FROM tr) AS u_combo, (fold, brand) NOT IN (SELECT (fold, brand) FROM tr) AS u_brand FROM va)
SELECT fold, count(*) FILTER (WHERE u_entity) AS unseen_entity, count(*) FILTER (WHERE u_combo) AS unseen_combo, count(*) FILTER (WHERE u_brand) AS unseen_brand,
  count(*) FILTER (WHERE u_entity OR u_combo OR u_brand) AS unseen_any FROM u GROUP BY 1""")
def ag22(t):
    """Validation rows with a category the fold's training prefix never had, per column and in any."""
    from ..operators.features import unseen_categories
    rows = t.fold_rows.withColumn("combo", F.concat("brand", "word1", F.col("size_band").cast("string")))
    return unseen_categories(rows.filter("role = 'train'"), rows.filter("role = 'valid'"), ["fold"], ["entity", "combo", "brand"])


@query("ag24", f"""WITH {SCORES}, f AS (SELECT market, fold, feature, n, max(sse) FILTER (WHERE config = 0) AS a, max(sse) FILTER (WHERE config = 2) AS b FROM scores GROUP BY 1, 2, 3, 4)
SELECT market, feature, round(sum(a) / sum(n), 6) AS mse_a, round(sum(b) / sum(n), 6) AS mse_b, round(sum(b) / sum(n) - sum(a) / sum(n), 6) + 0.0 AS difference, bool_and(n >= {MIN_VALID}) AS all_valid FROM f GROUP BY 1, 2""")
def ag24(t):
    from ..operators.select import compare_fits
    rows = t.scores.withColumn("rmse", F.sqrt(F.col("sse") / F.col("n"))).withColumn("valid", F.col("n") >= MIN_VALID)
    out = compare_fits(rows.filter("config = 0"), rows.filter("config = 2"), ["market", "feature"], "fold")
    return out.select("market", "feature", *t6("mse_a", "mse_b", "difference"), "all_valid")


@query("ag25", f"""WITH {FOLD_CTES}, fe AS (SELECT DISTINCT fold, entity FROM fold_rows WHERE role = 'train')
SELECT r.fold, count(*) FILTER (WHERE role = 'train') AS n_train, count(*) FILTER (WHERE role = 'valid') AS n_valid, count(DISTINCT r.entity) FILTER (WHERE role = 'train') AS train_entities,
  count(DISTINCT r.entity) FILTER (WHERE role = 'valid') AS valid_entities, count(*) FILTER (WHERE role = 'valid' AND fe.entity IS NULL) AS unseen_trades
FROM fold_rows r LEFT JOIN fe ON fe.fold = r.fold AND fe.entity = r.entity GROUP BY 1""")
def ag25(t):
    """Counts per fold from one aggregate keyed by (fold, entity): unseen means no training trade."""
    per = t.fold_rows.groupBy("fold", "entity").agg(F.count_if(F.col("role") == "train").alias("a"), F.count_if(F.col("role") == "valid").alias("b"))
    return per.groupBy("fold").agg(
        F.sum("a").alias("n_train"), F.sum("b").alias("n_valid"), F.count_if(F.col("a") > 0).alias("train_entities"), F.count_if(F.col("b") > 0).alias("valid_entities"),
        F.sum(F.when(F.col("a") == 0, F.col("b")).otherwise(F.lit(0))).alias("unseen_trades"),
    )


@query("ag26", f"""WITH {TARGETS}, s AS (SELECT 'training' AS sample, evt, price, prior_n, status FROM train UNION ALL SELECT 'evaluation', evt, price, prior_n, status FROM evaluation)
SELECT sample, flag, count(*) FILTER (WHERE CASE flag WHEN 'returned' THEN evt = 'R' WHEN 'low_price' THEN price < 100 WHEN 'thin' THEN prior_n < 40 ELSE evt <> 'R' AND prior_n >= 40 END) AS n
FROM s CROSS JOIN (VALUES ('returned'), ('low_price'), ('thin'), ('strict')) v(flag) GROUP BY 1, 2""")
def ag26(t):
    sample = F.when(in_window(F.col("ts"), "1997-01-01", "2000-01-01"), "training").when(in_window(F.col("ts"), *EVAL), "evaluation")
    flags = {"returned": F.col("evt") == "R", "low_price": F.col("price") < 100, "thin": F.col("prior_n") < 40, "strict": (F.col("evt") != "R") & (F.col("prior_n") >= 40)}
    packed = t.targets.withColumn("sample", sample).filter("sample IS NOT NULL").groupBy("sample").agg(*[F.count_if(c).alias(n) for n, c in flags.items()])
    return packed.select("sample", F.inline(F.array(*[F.struct(F.lit(n).alias("flag"), F.col(n).alias("n")) for n in flags])))


@query("ag27", f"""WITH {PREDS}, l2 AS (SELECT * FROM long), w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY market, seen, model, entity) AS w FROM l2)
SELECT market, seen, model, round(sqrt(sum(w * power(y - p, 2)) / sum(w)), 6) + 0.0 AS rmse, round(sum(w * abs(y - p)) / sum(w), 6) + 0.0 AS mae FROM w GROUP BY 1, 2, 3""")
def ag27(t):
    return M.balanced_score(t.preds, ["market", "seen"], "entity", "y", MODELS).select("market", "seen", "model", *t6("rmse", "mae"))


@query("ag28", f"""WITH {CLEAN}, {MULTI}, {PAIRS}, j AS (SELECT l.*, l.tx IN (SELECT tx FROM multi) AS multi, coalesce(p.reverse_pair, false) AS rp, l.entity IN (SELECT vec_id FROM embeddings) AS ready
  FROM ledger l LEFT JOIN (SELECT line_no AS ln, reverse_pair FROM pairs) p ON p.ln = l.line_no)
SELECT count(*) FILTER (WHERE bad_currency) AS currency_excluded, count(*) FILTER (WHERE base_clean AND multi) AS multi_trades, count(*) FILTER (WHERE rp) AS reverse_trades,
  count(*) FILTER (WHERE base_clean AND NOT ready) AS missing_asset_trades, count(DISTINCT entity) FILTER (WHERE base_clean AND NOT ready) AS missing_asset_entities,
  count(*) FILTER (WHERE base_clean AND (multi OR rp)) AS flagged_trades FROM j""")
def ag28(t):
    rows = membership(with_multi(ledger_stage(t)), t.labels_by_entity, ["entity"], "ready")
    pairs = with_pairs(ledger_stage(t).filter("base_clean")).filter("reverse_pair").select("line_no", F.lit(True).alias("rp"))
    j = rows.join(pairs, "line_no", "left").withColumn("rp", F.coalesce("rp", F.lit(False)))
    clean, gone = F.col("base_clean"), F.col("base_clean") & ~F.col("ready")
    per = j.groupBy("entity").agg(
        F.count_if("flag_bad_currency").alias("a"), F.count_if(clean & F.col("multi")).alias("b"), F.count_if("rp").alias("c"),
        F.count_if(gone).alias("d"), F.count_if(clean & (F.col("multi") | F.col("rp"))).alias("e"),
    )
    return per.agg(
        F.sum("a").alias("currency_excluded"), F.sum("b").alias("multi_trades"), F.sum("c").alias("reverse_trades"), F.sum("d").alias("missing_asset_trades"),
        F.count_if(F.col("d") > 0).alias("missing_asset_entities"), F.sum("e").alias("flagged_trades"),
    )


@query("ag29", f"""WITH {FOLD_CTES} SELECT fold, role, count(*) AS n, round(avg(y), 6) + 0.0 AS mean_y, round(quantile_cont(y, 0.5), 6) + 0.0 AS median_y, round(stddev_pop(y), 6) AS sd_y FROM fold_rows GROUP BY 1, 2""")
def ag29(t):
    rows = t.fold_rows
    q = exact_quantiles(rows, ["fold", "role"], "y", {"median_y": 0.5})
    s = rows.groupBy("fold", "role").agg(n_rows(), F.avg("y").alias("mean_y"), F.stddev_pop("y").alias("sd_y"))
    return s.join(q, ["fold", "role"]).select("fold", "role", "n", *t6("mean_y", "median_y", "sd_y"))
