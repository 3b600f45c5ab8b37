"""Past-only window queries, ranks, top-k and sampling."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranking import dense_index
from ..functions.scalars import DAY_US, in_window, moment, steady, tidy
from ..operators import metrics as M
from ..operators import select as S
from ..operators import temporal as T
from ..session import written
from ..sources.tables import EVAL, MODELS, PREDS, SCORES, TARGETS, TRADES, WINDOW_US
from .joins import RANKED, checkpoints
from .registry import query

t6 = lambda *names: [tidy(F.col(n)).alias(n) for n in names]

FRAME = lambda days: f"WINDOW w AS (PARTITION BY market ORDER BY us RANGE BETWEEN {days * DAY_US} PRECEDING AND 1 PRECEDING)"
W1_SQL = f"WITH {TRADES} SELECT source_row, round(quantile_cont(price, 0.5) OVER w + 1e-9::DOUBLE, 6) AS median FROM trades {FRAME(20)}"


@query("w1", W1_SQL)
def w1(t):
    """Past-only 20-day rolling median on every trade."""
    f = T.past_only_stat(t.trades, "market", "us", "price", WINDOW_US)
    return T.attach(t.trades.select("source_row", "market", "us"), f, "market", "us").select("source_row", steady(F.col("baseline")).alias("median"))


@query("w1_by_count", f"WITH {TRADES} SELECT DISTINCT market, us, round(quantile_cont(price, 0.5) OVER w + 1e-9::DOUBLE, 6) AS median FROM trades {FRAME(20)}")
def w1_by_count(t):
    """The same median by counting, for markets whose single windows are too big to frame."""
    f = T.past_only_median_by_count(t.trades, "market", "us", "price", WINDOW_US)
    return f.select("market", "us", steady(F.col("baseline")).alias("median"))


@query("w1_events", """SELECT event_id, round(quantile_cont(value, 0.5) OVER w, 6) AS median, count(*) OVER w AS prior_n, count(DISTINCT user_id) OVER w AS prior_users FROM (SELECT *, epoch_us(ts) AS us FROM events)
WINDOW w AS (PARTITION BY event_type ORDER BY us RANGE BETWEEN 21600000000 PRECEDING AND 1 PRECEDING)""")
def w1_events(t):
    """Microsecond stamps and a six-hour window over the event stream table."""
    from ..functions.scalars import epoch_us
    e = t.read("events").select("event_id", "event_type", "user_id", "value", epoch_us(F.col("ts")).alias("us"))
    window = 6 * 3600 * 1_000_000
    # A frame would be read again at every microsecond; the sorted list is not.
    f = T.past_only_median_sorted(e, "event_type", "us", "value", window).join(T.past_only_support(e, "event_type", "us", "user_id", window), ["event_type", "us"])
    out = T.attach(e.select("event_id", "event_type", "us"), f, "event_type", "us")
    return out.select("event_id", F.round("baseline", 6).alias("median"), "prior_n", F.col("prior_entities").alias("prior_users"))


@query("w1_sorted", """SELECT DISTINCT event_type, us, round(quantile_cont(value, 0.5) OVER w, 6) AS median FROM (SELECT *, epoch_us(ts) AS us FROM events)
WINDOW w AS (PARTITION BY event_type ORDER BY us RANGE BETWEEN 259200000000 PRECEDING AND 1 PRECEDING)""")
def w1_sorted(t):
    """Three-day median of microsecond events from sorted window lists."""
    from ..functions.scalars import epoch_us
    e = t.read("events").select("event_type", "value", epoch_us(F.col("ts")).alias("us"))
    return T.past_only_median_sorted(e, "event_type", "us", "value", 3 * DAY_US, "median").select("event_type", "us", F.round("median", 6).alias("median"))


@query("w2", f"WITH {TRADES} SELECT source_row, count(*) OVER w AS prior_n, count(DISTINCT entity) OVER w AS prior_entities FROM trades {FRAME(20)}")
def w2(t):
    f = T.past_only_support(t.trades, "market", "us", "entity", WINDOW_US)
    return T.attach(t.trades.select("source_row", "market", "us"), f, "market", "us").select("source_row", "prior_n", "prior_entities")


@query("w3", f"WITH {TRADES} SELECT source_row, max(us) OVER w AS prior_us FROM trades {FRAME(20)}")
def w3(t):
    f = T.past_only_support(t.trades, "market", "us", "entity", WINDOW_US)
    return T.attach(t.trades.select("source_row", "market", "us"), f, "market", "us").select("source_row", "prior_us")


@query("w4", f"""WITH {TRADES}, a AS (SELECT DISTINCT market, us, quantile_cont(price, 0.5) OVER w AS m7 FROM trades {FRAME(7)}),
b AS (SELECT DISTINCT market, us, quantile_cont(price, 0.5) OVER w AS m30 FROM trades {FRAME(30)}), c AS (SELECT DISTINCT market, us, avg(price) OVER w AS a20 FROM trades {FRAME(20)})
SELECT market, us, round(m7 + 1e-9::DOUBLE, 6) AS median_7d, round(m30 + 1e-9::DOUBLE, 6) AS median_30d, round(a20 + 1e-9::DOUBLE, 6) AS mean_20d FROM a JOIN b USING (market, us) JOIN c USING (market, us)""")
def w4(t):
    """Alternative windows and the mean statistic."""
    f = lambda days, stat, name: T.past_only_stat(t.trades, "market", "us", "price", days * DAY_US, stat, name)
    j = f(7, "median", "a").join(f(30, "median", "b"), ["market", "us"]).join(f(20, "mean", "c"), ["market", "us"])
    return j.select("market", "us", steady(F.col("a")).alias("median_7d"), steady(F.col("b")).alias("median_30d"), steady(F.col("c")).alias("mean_20d"))


@query("w5", f"""WITH {TRADES} SELECT source_row, lag(buyer) OVER w AS prev_buyer, lag(seller) OVER w AS prev_seller, lag(us) OVER w AS prev_us FROM trades WINDOW w AS (PARTITION BY entity ORDER BY us, order_id, source_row)""")
def w5(t):
    """Previous parties of each entity; time shards with a carried last row keep hot entities split."""
    rows = t.trades.select("source_row", "entity", "us", "order_id", "buyer", "seller")
    return T.carried_lag(rows, ["entity"], "us", ["order_id", "source_row"], ["buyer", "seller", "us"], 365 * DAY_US).select("source_row", "prev_buyer", "prev_seller", "prev_us")


@query("w6", f"""WITH {TARGETS} SELECT entity, source_row, us FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY us, source_row) AS rn FROM evaluation) WHERE rn = 1""")
def w6(t):
    """First evaluation trade per entity as a combining minimum, not a per-entity sort."""
    first = t.evaluation.groupBy("entity").agg(F.min(F.struct("us", "source_row")).alias("f"))
    return first.select("entity", "f.source_row", "f.us")


POOLED_RANK = "ranked AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY mse, feature, config) AS rank FROM pooled)"


@query("w7", f"""WITH {SCORES}, f AS (SELECT market, feature, min(mse) AS mse FROM pooled GROUP BY 1, 2)
SELECT market, feature, round(mse, 6) AS mse, row_number() OVER w AS rank, row_number() OVER w = 1 AS is_best FROM f
WINDOW w AS (PARTITION BY market ORDER BY mse, CASE feature WHEN 'brand' THEN 0 WHEN 'size' THEN 1 WHEN 'word' THEN 2 ELSE 3 END)""")
def w7(t):
    """Ranking table of feature groups with a fixed order for ties."""
    from .selection import feature_order
    f = t.pooled.groupBy("market", "feature").agg(F.min("mse").alias("mse"))
    w = W.partitionBy("market").orderBy("mse", feature_order())
    r = f.withColumn("rank", F.row_number().over(w).cast("bigint"))
    return r.select("market", "feature", F.round("mse", 6).alias("mse"), "rank", (F.col("rank") == 1).alias("is_best"))


@query("w8", f"""WITH {SCORES} SELECT market, feature, config, round(mse, 6) AS mse, row_number() OVER (PARTITION BY market, feature ORDER BY mse, -alpha) AS rank FROM pooled""")
def w8(t):
    """Fall-through order per feature under the sequential tolerance rule (larger alpha is simpler)."""
    rows = t.pooled.withColumn("simple", -F.col("alpha"))
    out = S.ordered_choices(rows, ["market", "feature"], "mse", ["simple"])
    return out.select("market", "feature", "config", F.round("mse", 6).alias("mse"), "rank")


@query("w9", f"""WITH {SCORES}, q AS (SELECT market, fold, lead(fold) OVER (PARTITION BY market ORDER BY fold) AS next_fold FROM (SELECT DISTINCT market, fold FROM scores))
SELECT market, fold, next_fold FROM q WHERE next_fold IS NOT NULL""")
def w9(t):
    return S.next_quarter(t.scores, ["market"], "fold").select("market", "fold", "next_fold")


@query("w10", f"""WITH {TRADES} SELECT k.kind AS "check", count(DISTINCT (market, us)) AS n_moments, 0::BIGINT AS n_changed FROM trades CROSS JOIN (VALUES ('future_removed'), ('future_repriced')) k(kind) WHERE ts < '1999-01-01' GROUP BY 1""")
def w10(t):
    """Features before a date must not change when later trades vanish or change price."""
    cut = F.col("ts") < moment("1999-01-01")
    full = t.trades

    def features(df):
        a = T.past_only_support(df, "market", "us", "entity", WINDOW_US)
        return a.join(T.past_only_stat(df, "market", "us", "price", WINDOW_US), ["market", "us"])

    limit = 915_148_800_000_000
    # Compared twice; written, it is computed once.
    base = written(features(full).filter(F.col("us") < limit), "base_features")
    changed = full.withColumn("price", F.when(cut, F.col("price")).otherwise(F.col("price") * 7))
    parts = []
    for kind, df in (("future_removed", full.filter(cut)), ("future_repriced", changed)):
        other = features(df).filter(F.col("us") < limit)
        cols = ["prior_n", "prior_entities", "prior_us", "baseline"]
        j = base.select("market", "us", F.struct(*cols).alias("a")).join(other.select("market", "us", F.struct(*cols).alias("b")), ["market", "us"], "full_outer")
        parts.append(j.agg(F.lit(kind).alias("check"), F.count(F.lit(1)).alias("n_moments"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_changed")))
    return parts[0].unionByName(parts[1])


@query("tk1", f"""WITH {SCORES} SELECT market, feature, config, round(mse, 6) AS mse FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY mse, feature, config) AS rn FROM pooled) WHERE rn = 1""")
def tk1(t):
    return S.best(t.pooled, ["market"], [F.col("mse"), F.col("feature"), F.col("config")]).select("market", "feature", "config", F.round("mse", 6).alias("mse"))


@query("tk2", "SELECT doc_id, idx FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents) WHERE idx % 7 = 0 AND idx < 7 * 64")
def tk2(t):
    """Systematic sample: every seventh document in id order, first 64 of them."""
    ranked = dense_index(t.read("documents").select("doc_id"), "doc_id", "doc_id", "idx")
    return ranked.filter((F.col("idx") % 7 == 0) & (F.col("idx") < 7 * 64)).select("doc_id", "idx")


@query("tk3", f"WITH {TRADES}, {RANKED} SELECT probe AS source_row, idx FROM probes")
def tk3(t):
    return checkpoints(t).select("source_row", "idx")


@query("tk4", """SELECT market, entity FROM (SELECT p_type AS market, p_partkey AS entity, row_number() OVER (PARTITION BY p_type ORDER BY md5(concat('17:', p_partkey)), p_partkey) AS rn FROM part) WHERE rn <= 25""")
def tk4(t):
    """Seeded sample of at most 25 entities per market; Spark prunes each task to 25 before the shuffle."""
    key = F.md5(F.concat(F.lit("17:"), F.col("p_partkey").cast("string")).cast("binary"))
    w = W.partitionBy("p_type").orderBy(key, "p_partkey")
    r = t.read("part").select("p_type", "p_partkey", F.row_number().over(w).alias("rn")).filter("rn <= 25")
    return r.select(F.col("p_type").alias("market"), F.col("p_partkey").alias("entity"))


@query("tk5", f"""WITH {PREDS} SELECT market, model, round(sqrt(avg(power(y - p, 2))), 6) AS rmse FROM long GROUP BY 1, 2 ORDER BY 1, 3""")
def tk5(t):
    return M.score(t.preds, ["market"], "entity", "y", MODELS).select("market", "model", F.round("rmse", 6).alias("rmse")).orderBy("market", "rmse", "model")
