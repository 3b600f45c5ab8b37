"""Feature queries: everything is fitted on training entities or training trades only."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ranking import dense_index
from ..functions.scalars import tidy
from ..operators import features as X
from ..operators import metrics as M
from ..operators.vectors import dimension_audit
from ..sources.readers import vector_checks
from ..sources.tables import PREDS, TARGETS
from .registry import query
from .scans import ASINH, asinh_parameters

t6 = lambda *names: [tidy(F.col(n)).alias(n) for n in names]
COLUMNS = ["brand", "word1", "word2", "size_band", "unit"]


def entities(t):
    """One row per entity with its traits; 'unit' is constant on purpose."""
    return t.read("part").select(
        F.col("p_partkey").alias("entity"), F.col("p_type").alias("market"), F.col("p_brand").alias("brand"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word1"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("word2"), F.expr("cast(p_size div 10 as int)").alias("size_band"), F.lit("each").alias("unit"),
        (F.col("p_size") / 10).alias("x1"), (F.col("p_retailprice") / 1000).alias("x2"),
    ).withColumn("tokens", X.trait_tokens(COLUMNS))


def trained(t):
    """Training entities with their trade counts; the training window is a strict prefix of time."""
    return t.stage("trained", lambda: t.train.groupBy("entity").agg(F.count(F.lit(1)).alias("w")))


ENT = """ent AS (SELECT p_partkey AS entity, p_brand AS brand, split_part(p_name, ' ', 1) AS word1, split_part(p_name, ' ', 2) AS word2, p_size // 10 AS size_band FROM part),
tok AS (SELECT entity, concat('brand=', brand) AS feature FROM ent UNION ALL SELECT entity, concat('word1=', word1) FROM ent UNION ALL SELECT entity, concat('word2=', word2) FROM ent
  UNION ALL SELECT entity, concat('size_band=', size_band) FROM ent UNION ALL SELECT entity, 'unit=each' FROM ent),
trained AS (SELECT entity, count(*) AS w FROM train GROUP BY 1),
vocab AS (SELECT feature, count(*) AS df FROM tok WHERE entity IN (SELECT entity FROM trained) GROUP BY 1),
oh AS (SELECT t.entity, t.feature, 1.0::DOUBLE AS value FROM tok t JOIN vocab v ON v.feature = t.feature),
idf AS (SELECT feature, df, ln((1 + (SELECT count(*) FROM trained)) / (1 + df)::DOUBLE) + 1 AS idf FROM vocab),
tf AS (SELECT t.entity, t.feature, i.idf / sqrt(sum(i.idf * i.idf) OVER (PARTITION BY t.entity)) AS value FROM tok t JOIN idf i ON i.feature = t.feature)"""


def train_entities(t):
    return entities(t).join(trained(t), "entity")


@query("fe1", f"WITH {TARGETS}, {ENT} SELECT entity, feature, value FROM oh")
def fe1(t):
    return X.one_hot(train_entities(t), entities(t), "entity", "tokens")


@query("fe2", f"WITH {TARGETS}, {ENT} SELECT entity, feature, round(value, 6) AS value FROM tf")
def fe2(t):
    return X.tf_idf(train_entities(t), entities(t), "entity", "tokens").select("entity", "feature", *t6("value"))


@query("fe2_idf", f"WITH {TARGETS}, {ENT} SELECT feature, df, round(idf, 6) AS idf FROM idf")
def fe2_idf(t):
    return X.idf_table(train_entities(t), "entity", "tokens").select("feature", "df", *t6("idf"))


MOMENTS = """m AS (SELECT v.feature, coalesce(sum(w * value), 0) / (SELECT sum(w) FROM trained) AS mean, coalesce(sum(w * value * value), 0) / (SELECT sum(w) FROM trained) AS sq
  FROM vocab v LEFT JOIN (SELECT o.*, w FROM {src} o JOIN trained t ON t.entity = o.entity) x ON x.feature = v.feature GROUP BY 1)"""


@query("fe3", f"WITH {TARGETS}, {ENT}, {MOMENTS.format(src='oh')} SELECT feature, sq - mean * mean > 1e-12 AS kept FROM m")
def fe3(t):
    sparse = X.one_hot(train_entities(t), entities(t), "entity", "tokens")
    return X.sparse_moments(sparse, trained(t), "entity", "w").select("feature", "kept")


@query("fe4", f"WITH {TARGETS}, {ENT}, {MOMENTS.format(src='tf')} SELECT feature, round(mean, 6) + 0.0 AS mean, round(sqrt(greatest(sq - mean * mean, 0)), 6) + 0.0 AS scale FROM m")
def fe4(t):
    sparse = X.tf_idf(train_entities(t), entities(t), "entity", "tokens")
    return X.sparse_moments(sparse, trained(t), "entity", "w").select("feature", *t6("mean", "scale"))


def vectors(t):
    return t.read("embeddings").select(F.col("vec_id").alias("entity"), F.col("embedding").cast("array<double>").alias("v"))


@query("fe5")
def fe5(t):
    """Principal components fitted on distinct training entities and applied to all of them."""
    train = vectors(t).join(trained(t), "entity", "left_semi")
    mean, axes, _ = X.fit_projection(train, "v", 8)
    pcs = X.project(vectors(t), "v", mean, axes, ["entity"])
    return pcs.select("entity", *[tidy(F.col("pc")[i]).alias(f"pc{i + 1}") for i in range(8)])


@query("fe5_variance", f"""WITH {TARGETS}, {ENT}, e AS (SELECT vec_id, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE vec_id IN (SELECT entity FROM trained))
SELECT round(sum(s), 6) AS total_variance FROM (SELECT dim, var_samp(v) AS s FROM e GROUP BY 1)""")
def fe5_variance(t):
    """All components together carry exactly the total variance of the training block."""
    train = vectors(t).join(trained(t), "entity", "left_semi")
    _, _, values = X.fit_projection(train, "v", 64)
    per = train.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.var_samp("x").alias("s"))
    total = per.agg(F.sum("s").alias("direct"))
    agreed = F.abs(F.col("direct") - F.lit(float(values.sum()))) < 1e-9
    return total.select(F.when(agreed, tidy(F.lit(float(values.sum())))).alias("total_variance"))


@query("fe6", f"""WITH {TARGETS}, {ENT}, {MOMENTS.format(src='oh')}, mk AS (SELECT feature, mean, sqrt(sq - mean * mean) AS sd FROM m WHERE sq - mean * mean > 1e-12),
a AS (SELECT e.entity, (coalesce(o.value, 0) - mean) / sd AS z FROM ent e CROSS JOIN mk LEFT JOIN oh o ON o.entity = e.entity AND o.feature = mk.feature),
u AS (SELECT vec_id AS entity, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
um AS (SELECT dim, sum(w * v) / sum(w) AS mean, sqrt(sum(w * v * v) / sum(w) - power(sum(w * v) / sum(w), 2)) AS sd FROM u JOIN trained t ON t.entity = u.entity GROUP BY 1),
b AS (SELECT u.entity, (v - mean) / sd AS z FROM u JOIN um ON um.dim = u.dim),
al AS (SELECT * FROM a WHERE entity IN (SELECT vec_id FROM embeddings) UNION ALL SELECT * FROM b WHERE entity IN (SELECT entity FROM ent))
SELECT entity, count(*) AS width, round(sum(z), 4) + 0.0 AS sum_z, round(sum(z * z), 4) AS sum_zz FROM al GROUP BY 1""")
def fe6(t):
    """Early fusion of standardised traits and the standardised embedding block, shown by its sums."""
    fused = early_vectors(t)
    total = lambda f: F.aggregate("x", F.lit(0.0), f)
    return fused.select(
        "entity", F.size("x").cast("bigint").alias("width"), tidy(total(lambda a, v: a + v), 4).alias("sum_z"), tidy(total(lambda a, v: a + v * v), 4).alias("sum_zz")
    )


def trait_vectors(t):
    train = train_entities(t)
    sparse = X.one_hot(train, entities(t), "entity", "tokens")
    columns = X.dense_columns(X.sparse_moments(sparse, trained(t), "entity", "w"))
    return X.densify(entities(t).select("entity"), sparse, "entity", columns)


def image_vectors(t):
    weighted = vectors(t).join(trained(t), "entity")
    return X.standardize_block(vectors(t), "v", X.block_moments(weighted, "v", "w")).select("entity", "x")


def early_vectors(t):
    return t.stage("early_vectors", lambda: X.concat_blocks(trait_vectors(t), image_vectors(t), "entity"))


@query("fe7", """SELECT CAST(max(len(embedding)) AS BIGINT) AS dims, count(*) AS n_rows, CAST(least(max(len(embedding)), least(256, count(*)) - 1) AS BIGINT) AS rank_lower_bound FROM embeddings""")
def fe7(t):
    """Rank lower bound of the embedding block from 256 evenly spaced rows."""
    rows = dense_index(t.read("embeddings").select("vec_id", "embedding"), "vec_id", "vec_id", "idx")
    n = t.read("embeddings").count()
    k = min(256, n)
    positions = sorted({round(i * (n - 1) / max(k - 1, 1)) for i in range(k)})
    # 256 rows are the operator's sample size, a fixed bound.
    wanted = t.spark.createDataFrame([(p,) for p in positions], "idx bigint")
    sample = rows.join(F.broadcast(wanted), "idx")
    bound = X.rank_lower_bound(sample, "embedding")
    return t.read("embeddings").agg(F.max(F.size("embedding")).cast("bigint").alias("dims"), F.count(F.lit(1)).alias("n_rows")).withColumn("rank_lower_bound", F.lit(bound).cast("bigint"))


@query("fe8", """WITH v AS (SELECT vec_id, count(*) AS c, min(len(embedding)) AS lo, max(len(embedding)) AS hi FROM embeddings GROUP BY 1), j AS (SELECT * FROM v FULL JOIN (SELECT p_partkey FROM part) p ON p.p_partkey = v.vec_id),
e AS (SELECT unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), k AS (SELECT count(*) AS n_constant FROM (SELECT dim FROM e GROUP BY dim HAVING min(v) = max(v)))
SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) FILTER (WHERE c > 1) AS n_duplicated, min(lo) AS min_dim, max(hi) AS max_dim, count(*) FILTER (WHERE vec_id IS NULL) AS n_missing,
  count(*) FILTER (WHERE p_partkey IS NULL) AS n_extra, any_value(n_constant) AS n_constant, min(lo) = max(hi) AND any_value(n_constant) = 0 AS passed FROM j CROSS JOIN k""")
def fe8(t):
    """Embedding table audit: dimensions, ids against the registry, constant dimensions, one verdict."""
    base = vector_checks(t.read("embeddings"), t.read("part").select(F.col("p_partkey").alias("vec_id")), "vec_id", "embedding")
    flat = dimension_audit(t.read("embeddings"), "embedding").agg(F.count_if("is_constant").alias("n_constant"))
    j = base.join(F.broadcast(flat))
    return j.select("n_rows", "n_duplicated", "min_dim", "max_dim", "n_missing", "n_extra", "n_constant", ((F.col("min_dim") == F.col("max_dim")) & (F.col("n_constant") == 0)).alias("passed"))


@query("fe9", """SELECT p_type AS market, CASE WHEN p_type = 'PROMO' THEN 'word2=' ELSE 'word1=' END AS lead_feature, count(*) AS n FROM part GROUP BY 1, 2""")
def fe9(t):
    """A trait that exists in one market only enters the feature list of that market alone."""
    rows = entities(t)
    promo = X.trait_columns({"word2": True, "word1": True})
    other = X.trait_columns({"word2": False, "word1": True})
    first = F.when(F.col("market") == "PROMO", X.trait_tokens(promo)[0]).otherwise(X.trait_tokens(other)[0])
    lead = F.concat(F.split_part(first, F.lit("="), F.lit(1)), F.lit("=")).alias("lead_feature")
    return rows.select("market", lead).groupBy("market", "lead_feature").agg(F.count(F.lit(1)).alias("n"))


@query("fe10", f"""WITH {TARGETS}, {ASINH}, z AS (SELECT t.market, avg(asinh((y - med) / mad)) AS mz, avg(y) AS my FROM train t JOIN center c ON c.market = t.market JOIN spread s ON s.market = t.market GROUP BY 1),
b AS (SELECT e.market, e.entity, y, 0.0::DOUBLE AS p_zero, my AS p_mean, med + mad * sinh(mz) AS p_back FROM evaluation e JOIN z ON z.market = e.market JOIN center c ON c.market = e.market JOIN spread s ON s.market = e.market)
SELECT market, m AS model, round(sqrt(avg(power(y - CASE m WHEN 'zero' THEN p_zero WHEN 'mean' THEN p_mean ELSE p_back END, 2))), 6) AS rmse FROM b CROSS JOIN (VALUES ('zero'), ('mean'), ('back')) v(m) GROUP BY 1, 2""")
def fe10(t):
    """Zero, training-mean and back-transformed asinh-mean baselines."""
    from ..functions.scalars import robust_asinh, robust_sinh
    par = asinh_parameters(t)
    z = robust_asinh(F.col("y"), F.col("center"), F.col("scale"))
    level = t.train.join(par, "market").groupBy("market").agg(F.avg(z).alias("mz"), F.avg("y").alias("my"), F.first("center").alias("center"), F.first("scale").alias("scale"))
    rows = t.evaluation.join(level, "market").select(
        "market", "entity", "y", F.lit(0.0).alias("p_zero"), F.col("my").alias("p_mean"), robust_sinh(F.col("mz"), F.col("center"), F.col("scale")).alias("p_back")
    )
    return M.score(rows, ["market"], "entity", "y", ["zero", "mean", "back"]).select("market", "model", *t6("rmse"))
