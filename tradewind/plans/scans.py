"""Scan, sink and scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.metrics import long_models, score
from ..session import fresh_path
from ..sources import readers as R
from ..sources import sinks as K
from ..sources.tables import EVAL_ANCHOR_US, MODELS, PREDS, RAW, TARGETS, TRADES
from .registry import query

tidy = lambda *names: [S.tidy(F.col(n)).alias(n) for n in names]


def dated(c="o_orderdate"):
    return F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


@query("src1", """SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS note, concat(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), ' UTC') AS stamp FROM orders""")
def src1(t):
    """Orders written as CSV and scanned back as text."""
    path = fresh_path(t.spark, "csv")
    o = t.read("orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("note"), dated().alias("stamp"),
    )
    K.write_csv(o, path)
    return R.read_text_csv(t.spark, path, ["id", "status", "note", "stamp"])


@query("src2", "SELECT event_id, user_id, event_type, epoch_us(ts) AS us, value FROM events")
def src2(t):
    path = fresh_path(t.spark, "jsonl")
    t.read("events").select("event_id", "user_id", "event_type", S.epoch_us(F.col("ts")).alias("us"), "value").write.json(path)
    return R.read_json_lines(t.spark, path, "event_id bigint, user_id bigint, event_type string, us bigint, value double")


@query("src3", """SELECT p_partkey AS entity, p_brand AS brand, CAST(p_size // 10 AS VARCHAR) AS band,
  CASE WHEN p_partkey % 13 <> 0 THEN split_part(p_name, ' ', 1) END AS word, p_partkey % 20 = 0 AS duplicate_trait, c.n = 2 AS duplicate_entity,
  concat('img://', p_partkey) AS image
FROM part JOIN (VALUES (1), (2)) v(k) ON k = 1 OR p_partkey % 31 = 0 JOIN (SELECT 1 AS one) x ON true
JOIN (SELECT p_partkey AS pk, CASE WHEN p_partkey % 31 = 0 THEN 2 ELSE 1 END AS n FROM part) c ON c.pk = p_partkey""")
def src3(t):
    """Nested trait documents written as JSON and scanned back, duplicates flagged."""
    path = fresh_path(t.spark, "traits")
    pair = lambda k, v: F.struct(F.lit(k).alias("trait_type"), v.alias("value"))
    k = F.col("p_partkey")
    attributes = F.array_compact(F.array(
        pair("brand", F.col("p_brand")), pair("band", F.expr("cast(p_size div 10 as string)")),
        F.when(k % 13 != 0, pair("word", F.split_part("p_name", F.lit(" "), F.lit(1)))), F.when(k % 20 == 0, pair("brand", F.lit("again"))),
    ))
    docs = t.read("part").select(
        k.alias("entity"), F.struct(attributes.alias("attributes"), F.concat(F.lit("img://"), k.cast("string")).alias("image")).alias("metadata"),
        F.explode(F.when(k % 31 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_k"),
    ).drop("_k")
    docs.write.json(path)
    return R.read_trait_documents(t.spark, path, ["brand", "band", "word"])


@query("src4", "SELECT event_id, 'k' AS \"key\", json_extract_string(props, '$.k') AS value FROM events")
def src4(t):
    return R.flatten_json_map(t.read("events"), ["event_id"], "props")


@query("src5", """SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem
WHERE l_linestatus = 'O' AND l_returnflag IN ('A', 'N') AND l_shipdate >= '1998-01-01'""")
def src5(t):
    """Only three columns are read; the filters reach the scan."""
    return (
        t.read("lineitem")
        .filter((F.col("l_linestatus") == "O") & F.col("l_returnflag").isin("A", "N") & (F.col("l_shipdate") >= S.moment("1998-01-01")))
        .select("l_orderkey", "l_partkey", "l_extendedprice")
    )


@query("src6", """WITH v AS (SELECT vec_id, count(*) AS c, min(len(embedding)) AS lo, max(len(embedding)) AS hi,
  bool_or(len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0) AS bad FROM embeddings GROUP BY 1),
j AS (SELECT * FROM v FULL JOIN (SELECT p_partkey FROM part) p ON p.p_partkey = v.vec_id)
SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(c) AS n_ids, count(*) FILTER (WHERE c > 1) AS n_duplicated, min(lo) AS min_dim, max(hi) AS max_dim,
  count(*) FILTER (WHERE bad) AS n_nonfinite, count(*) FILTER (WHERE vec_id IS NULL) AS n_missing, count(*) FILTER (WHERE p_partkey IS NULL) AS n_extra FROM j""")
def src6(t):
    return R.vector_checks(t.read("embeddings"), t.read("part").select(F.col("p_partkey").alias("vec_id")), "vec_id", "embedding")


@query("src7", f"""WITH {PREDS} SELECT count(*) AS n_rows, count(*) - count(DISTINCT source_row) AS repeated_ids,
  count(*) FILTER (WHERE NOT (isfinite(y) AND isfinite(p_market) AND isfinite(p_brand))) AS nonfinite_rows,
  count(DISTINCT entity) AS n_clusters, count(*) FILTER (WHERE entity IS NULL) AS rows_without_cluster FROM preds""")
def src7(t):
    out = R.bundle_checks(t.preds, "source_row", "entity", ["y", "p_market", "p_brand"])
    return out


REQUESTED = ["ECONOMY", "PROMO", "STANDARD", "UNLISTED"]


@query("src8", f"""WITH {TRADES}, catalog AS (SELECT market AS dataset, count(*) AS n_rows, count(DISTINCT entity) AS n_entities FROM trades GROUP BY 1),
req(dataset) AS (VALUES ('ECONOMY'), ('PROMO'), ('STANDARD'), ('UNLISTED'))
SELECT r.dataset, n_rows, n_entities, CASE WHEN c.dataset IS NULL THEN 'unknown' ELSE 'ok' END AS status FROM req r LEFT JOIN catalog c ON c.dataset = r.dataset""")
def src8(t):
    catalog = t.trades.groupBy(F.col("market").alias("dataset")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("entity").alias("n_entities"))
    requested = t.spark.createDataFrame([(d,) for d in REQUESTED], "dataset string")
    return R.select_datasets(catalog, requested, "dataset")


@query("src9", """SELECT min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us, count(*) AS n,
  count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS n_after_cutoff FROM events""")
def src9(t):
    return R.time_bounds(t.read("events").select(S.epoch_us(F.col("ts")).alias("us")), "us", 1_705_276_800_000_000)


@query("snk1", "SELECT c_nationkey, count(*) AS n, true AS second_write_refused FROM customer GROUP BY 1")
def snk1(t):
    path = fresh_path(t.spark, "once")
    counts = t.read("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    K.write_once(counts, path)
    refused = K.refuses_overwrite(counts, path)
    return t.spark.read.parquet(path).withColumn("second_write_refused", F.lit(refused))


@query("snk2", """SELECT 'customer' AS kind, CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS segment, '' AS nation FROM customer
UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), '', CAST(s_nationkey AS VARCHAR) FROM supplier""")
def snk2(t):
    a = t.read("customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    b = t.read("supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    path = fresh_path(t.spark, "union")
    rows = K.union_all([a, b])
    K.write_csv(rows, path)
    return R.read_text_csv(t.spark, path, rows.columns)


def period():
    return S.period_label(F.col("ts"), "2000-01-01", "2001-08-01")


@query("snk3", f"""WITH {TARGETS} SELECT CASE WHEN ts < '2000-01-01' THEN 'development' WHEN ts < '2001-08-01' THEN 'temporal_test' ELSE 'outside' END AS split,
  market, count(*) AS n, round(sum(y), 6) + 0.0::DOUBLE AS sum_y FROM targets GROUP BY 1, 2""")
def snk3(t):
    path = fresh_path(t.spark, "splits")
    K.write_splits(t.targets.select(period().alias("split"), "source_row", "market", "y"), path)
    back = t.spark.read.parquet(path)
    return back.groupBy("split", "market").agg(F.count(F.lit(1)).alias("n"), S.tidy(F.sum("y")).alias("sum_y"))


def long_preds(t, keep=("source_row", "market", "entity", "us", "block", "y", "seen", "evt")):
    return long_models(t.preds, list(keep), MODELS, {"p": "p_"})


@query("snk4", f"""WITH {PREDS} SELECT source_row, round(p_zero, 6) AS prediction__zero, round(p_market, 6) + 0.0 AS prediction__market, round(p_brand, 6) + 0.0 AS prediction__brand,
  round(p_emb, 6) + 0.0 AS prediction__emb, round(p_late, 6) + 0.0 AS prediction__late FROM preds""")
def snk4(t):
    wide = K.widen_predictions(long_preds(t, ["source_row"]), ["source_row"], "model", "p", MODELS)
    return wide.select("source_row", *tidy(*[f"prediction__{m}" for m in MODELS]))


@query("snk5", f"""WITH {PREDS} SELECT market, model, printf('%.4f', sqrt(avg((y - p) * (y - p)))) AS rmse, printf('%.4f', avg(abs(y - p))) AS mae FROM long GROUP BY 1, 2""")
def snk5(t):
    return K.fixed_decimals(score(t.preds, ["market"], "entity", "y", MODELS).select("market", "model", "rmse", "mae"), {"rmse": 4, "mae": 4})


@query("snk6", f"""WITH {TARGETS}
SELECT 'brand_mean' AS model, 'intercept' AS feature, 'intercept' AS kind, round(avg(y), 6) + 0.0 AS value FROM train
UNION ALL SELECT 'brand_mean', brand, 'coefficient', round(avg(y) - (SELECT avg(y) FROM train), 6) + 0.0 FROM train GROUP BY brand
UNION ALL SELECT 'brand_mean', brand, 'count', CAST(count(*) AS DOUBLE) FROM train GROUP BY brand""")
def snk6(t):
    """Parameters of a one-factor model written once as rows and read back."""
    per = t.train.groupBy("brand").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
    level = per.agg((F.sum("s") / F.sum("n")).alias("m"))
    centred = per.join(F.broadcast(level)).withColumn("coef", F.col("s") / F.col("n") - F.col("m"))
    rows = K.union_all([
        K.parameter_rows(level.withColumn("feature", F.lit("intercept")), "brand_mean", "feature", "intercept", "m"),
        K.parameter_rows(centred, "brand_mean", "brand", "coefficient", "coef"),
        K.parameter_rows(per, "brand_mean", "brand", "count", "n"),
    ])
    path = fresh_path(t.spark, "params")
    K.write_once(rows, path)
    return t.spark.read.parquet(path).select("model", "feature", "kind", *tidy("value"))


# --- projections and filters --------------------------------------------------------------------

@query("prj1", f"""WITH {TRADES}, d AS (SELECT source_row, CASE WHEN entity % 7 = 0 THEN ' None ' WHEN entity % 11 = 0 THEN '' WHEN entity % 13 = 0 THEN concat(word1, ' None ')
  WHEN entity % 17 = 0 THEN 'word_None' ELSE word1 END AS w FROM trades)
SELECT source_row, CASE WHEN trim(w) IN ('', 'None', 'word_None') THEN 'word_None' ELSE trim(w) END AS word FROM d""")
def prj1(t):
    e = F.col("entity")
    dirty = (
        F.when(e % 7 == 0, F.lit(" None ")).when(e % 11 == 0, F.lit("")).when(e % 13 == 0, F.concat("word1", F.lit(" None ")))
        .when(e % 17 == 0, F.lit("word_None")).otherwise(F.col("word1"))
    )
    return t.trades.select("source_row", S.normalize_category(dirty, "word").alias("word"))


@query("prj2", f"WITH {RAW} SELECT line_no, try_cast(entity_text AS DOUBLE) AS entity_number, try_cast(contract AS DOUBLE) AS contract_number FROM raw")
def prj2(t):
    return t.trades_raw.select("line_no", S.coerce_number(F.col("entity_text")).alias("entity_number"), S.coerce_number(F.col("contract")).alias("contract_number"))


@query("prj3", """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE epoch_us(o_orderdate) END AS us FROM orders""")
def prj3(t):
    text = F.when(F.col("o_orderkey") % 9 == 0, F.lit("not a time UTC")).otherwise(dated())
    return t.read("orders").select("o_orderkey", S.epoch_us(S.parse_utc(text)).alias("us"))


@query("prj4", """SELECT o_orderkey, concat(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), '+00:00') AS stamp, o_orderkey % 11 = 0 AS repaired FROM orders""")
def prj4(t):
    iso = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    fixed, broken = S.repair_zone(F.when(F.col("o_orderkey") % 11 == 0, F.concat(iso, F.lit("Z"))).otherwise(iso))
    return t.read("orders").select("o_orderkey", fixed.alias("stamp"), broken.alias("repaired"))


@query("prj5", f"WITH {TARGETS} SELECT source_row, round(y, 6) + 0.0 AS y, abs(exp(y) * baseline - price) <= 1e-9 * price AS round_trip FROM targets")
def prj5(t):
    back = F.abs(F.exp("y") * F.col("baseline") - F.col("price")) <= 1e-9 * F.col("price")
    return t.targets.select("source_row", *tidy("y"), back.alias("round_trip"))


ASINH = """center AS (SELECT market, quantile_cont(y, 0.5) AS med FROM train GROUP BY 1),
spread AS (SELECT t.market, quantile_cont(abs(y - med), 0.5) / 0.6744897501960817 AS mad FROM train t JOIN center c ON c.market = t.market GROUP BY 1)"""


def asinh_parameters(t):
    from ..operators.features import robust_parameters
    return t.stage("asinh", lambda: robust_parameters(t.train, ["market"], "y"))


@query("prj6", f"""WITH {TARGETS}, {ASINH} SELECT source_row, round(asinh((y - med) / mad), 6) + 0.0 AS z, abs(med + mad * sinh(asinh((y - med) / mad)) - y) < 1e-12 AS round_trip
FROM evaluation e JOIN center c ON c.market = e.market JOIN spread s ON s.market = e.market""")
def prj6(t):
    rows = t.evaluation.join(asinh_parameters(t), "market")
    z = S.robust_asinh(F.col("y"), F.col("center"), F.col("scale"))
    rows = rows.withColumn("z", z)
    back = F.abs(S.robust_sinh(F.col("z"), F.col("center"), F.col("scale")) - F.col("y")) < 1e-12
    return rows.select("source_row", *tidy("z"), back.alias("round_trip"))


@query("prj7", f"WITH {PREDS} SELECT source_row, round(0.7::DOUBLE * p_brand + 0.3::DOUBLE * p_emb, 6) + 0.0 AS p FROM preds")
def prj7(t):
    return t.preds.select("source_row", S.tidy(S.blend(F.col("p_brand"), F.col("p_emb"), 0.3)).alias("p"))


@query("prj8", f"WITH {TRADES} SELECT source_row, (us - 788918400000000) // 1209600000000 AS block FROM trades")
def prj8(t):
    return t.trades.select("source_row", S.block_index(F.col("us"), 788_918_400_000_000).alias("block"))


@query("prj9", f"""WITH {TRADES}, a AS (SELECT market, min(us) AS anchor FROM trades WHERE ts >= '1997-03-05' GROUP BY 1)
SELECT source_row, CAST(floor((us - anchor) / 1209600000000.0) AS BIGINT) AS block FROM trades t JOIN a ON a.market = t.market""")
def prj9(t):
    anchor = t.trades.filter(F.col("ts") >= S.moment("1997-03-05")).groupBy("market").agg(F.min("us").alias("anchor"))
    return t.trades.join(anchor, "market").select("source_row", S.block_index(F.col("us"), F.col("anchor")).alias("block"))


@query("prj10", f"""WITH {TRADES} SELECT source_row, CASE WHEN ts < '2000-01-01' THEN 'development' WHEN ts < '2001-08-01' THEN 'temporal_test' ELSE 'outside' END AS period FROM trades""")
def prj10(t):
    return t.trades.select("source_row", period().alias("period"))


@query("flt1", f"WITH {TRADES} SELECT source_row, us FROM trades WHERE ts >= '1999-04-01' AND ts < '1999-07-01'")
def flt1(t):
    return t.trades.filter(S.in_window(F.col("ts"), "1999-04-01", "1999-07-01")).select("source_row", "us")


def conditions():
    strict = (F.col("evt") != "R") & (F.col("prior_n") >= 40)
    return {"base": F.lit(True), "strict": strict, "strict_no_low": strict & (F.col("price") >= 100)}


CONDITIONS_SQL = """cond(condition) AS (VALUES ('base'), ('strict'), ('strict_no_low'))"""
CONDITION_WHERE = "(condition = 'base' OR (evt <> 'R' AND prior_n >= 40 AND (condition = 'strict' OR price >= 100)))"


@query("flt2", f"WITH {TARGETS}, {CONDITIONS_SQL} SELECT condition, source_row FROM targets CROSS JOIN cond WHERE {CONDITION_WHERE}")
def flt2(t):
    return t.targets.select(F.explode(S.names_where(conditions())).alias("condition"), "source_row")


@query("flt3", f"WITH {TRADES} SELECT source_row, abs(price - 900) <= 1e-9 AS is_floor, price < 50 AS is_low FROM trades")
def flt3(t):
    return t.trades.select("source_row", (F.abs(F.col("price") - 900) <= 1e-9).alias("is_floor"), (F.col("price") < 50).alias("is_low"))


def masks():
    return {
    "all": F.lit(True), "no_return": F.col("evt") != "R", "liquid": F.col("prior_n") >= 60, "seen": F.col("seen"),
    "unseen": ~F.col("seen"), "no_low": F.col("price") >= 100, "known_asset": F.col("emb_label").isNotNull(),
    }


MASKS_SQL = """masks(mask) AS (VALUES ('all'), ('no_return'), ('liquid'), ('seen'), ('unseen'), ('no_low'), ('known_asset')),
masked AS (SELECT mask, p.* FROM preds p CROSS JOIN masks WHERE CASE mask WHEN 'all' THEN true WHEN 'no_return' THEN evt <> 'R' WHEN 'liquid' THEN prior_n >= 60
  WHEN 'seen' THEN seen WHEN 'unseen' THEN NOT seen WHEN 'no_low' THEN price >= 100 ELSE emb_label IS NOT NULL END)"""


@query("flt4", f"""WITH {PREDS}, {MASKS_SQL} SELECT mask, market, count(*) AS n, round(sqrt(avg((y - p_brand) * (y - p_brand))), 6) + 0.0 AS rmse FROM masked GROUP BY 1, 2""")
def flt4(t):
    """Seven masks over the same rows in one pass."""
    rows = t.preds.withColumn("mask", F.explode(S.names_where(masks())))
    return score(rows, ["mask", "market"], "entity", "y", ["brand"]).select("mask", "market", "n", *tidy("rmse"))


@query("scalar_pack", f"""WITH {TRADES} SELECT source_row, lower(brand) AS lower_brand, regexp_replace(brand, '#', '-') AS dashed, regexp_matches(word1, '^[a-m]') AS early,
  split_part(trade_id, '-', -1) AS tail, regexp_extract(brand, '#([0-9]+)', 1) AS brand_no, lpad(CAST(size_band AS VARCHAR), 3, '0') AS padded,
  CAST(year(ts) AS BIGINT) AS year, CAST(date_diff('day', DATE '1995-01-01', CAST(ts AS DATE)) // 14 AS BIGINT) AS blk, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso,
  abs(exp(ln(price)) - price) <= 1e-9 * price AS back, round(sqrt(price), 6) AS root, round(asinh(price), 6) AS ash, sign(price - 1000) * greatest(abs(price - 1000) - 5, 0) >= 0 AS above,
  list_sum([line, supp, line]) AS total, len(list_distinct([line, supp, line])) AS n_unique, greatest(line, supp) - least(line, supp) AS span,
  sha256(source_row) AS fingerprint FROM trades""")
def scalar_pack(t):
    days = F.datediff(F.to_date("ts"), F.to_date(F.lit("1995-01-01")))
    values = F.array("line", "supp", "line")
    residual = F.signum(F.col("price") - 1000) * F.greatest(F.abs(F.col("price") - 1000) - 5, F.lit(0.0))
    r6 = lambda c: F.round(c, 6)
    return t.trades.select(
        "source_row", F.lower("brand").alias("lower_brand"), F.regexp_replace("brand", "#", "-").alias("dashed"), F.col("word1").rlike("^[a-m]").alias("early"),
        F.element_at(F.split("trade_id", "-"), -1).alias("tail"), F.regexp_extract("brand", "#([0-9]+)", 1).alias("brand_no"),
        F.lpad(F.col("size_band").cast("string"), 3, "0").alias("padded"), F.year("ts").cast("bigint").alias("year"),
        F.floor(days / 14).cast("bigint").alias("blk"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
        (F.abs(F.exp(F.log("price")) - F.col("price")) <= 1e-9 * F.col("price")).alias("back"), r6(F.sqrt("price")).alias("root"), r6(F.asinh("price")).alias("ash"), (residual >= 0).alias("above"),
        F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.size(F.array_distinct(values)).cast("bigint").alias("n_unique"),
        (F.array_max(values) - F.array_min(values)).alias("span"), F.sha2("source_row", 256).alias("fingerprint"),
    )
