"""Features fitted on training rows only: robust scale, one-hot, TF-IDF, weighted scaling, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import exact_quantiles
from ..session import written

# Fixed value: the 75 % point of the standard normal, which makes MAD estimate a standard deviation.
MAD_SCALE = 0.6744897501960817


def robust_parameters(train: DataFrame, by: list[str], y: str) -> DataFrame:
    """Median and normalised MAD per group, exact; a zero scale is an error, not a silent divide."""
    # Read by two passes over the rows and once more at the end; written, it is computed once, and its size is known.
    center = written(exact_quantiles(train, by, y, {"center": 0.5}), "centers")
    distance = train.join(center, by).withColumn("_d", F.abs(F.col(y) - F.col("center")))
    scale = exact_quantiles(distance, by, "_d", {"scale": 0.5}).withColumn("scale", F.col("scale") / F.lit(MAD_SCALE))
    usable = F.when(F.col("scale") > 0, F.col("scale")).otherwise(F.raise_error(F.lit("target scale is zero")).cast("double"))
    return center.join(scale.withColumn("scale", usable), by)


def unseen_categories(train: DataFrame, rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Per group: rows whose category is absent from training, per column and in any column."""
    marked = rows
    for c in columns:
        known = train.select(*by, c).distinct().withColumn(f"_k_{c}", F.lit(True))
        marked = marked.join(known, [*by, c], "left")
    unseen = {c: F.col(f"_k_{c}").isNull() for c in columns}
    anywhere = F.lit(False)
    for c in columns:
        anywhere = anywhere | unseen[c]
    return marked.groupBy(*by).agg(*[F.count_if(u).alias(f"unseen_{c}") for c, u in unseen.items()], F.count_if(anywhere).alias("unseen_any"))


# --- traits ---------------------------------------------------------------------------------------

MAX_FEATURES = 20_000


def trait_tokens(columns: list[str]) -> "F.Column":
    """Array of 'column=value' features of one entity; null traits give none."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat_ws("=", F.lit(c), F.col(c).cast("string"))) for c in columns]))


def trait_columns(present: dict[str, bool]) -> list[str]:
    """Feature list of a collection: conditional traits only where the collection has them."""
    return [c for c, has in present.items() if has]


def one_hot(train: DataFrame, rows: DataFrame, key: str, tokens: str) -> DataFrame:
    """Sparse (key, feature, value=1): features come from training entities, unknown ones vanish."""
    vocabulary = train.select(F.explode(tokens).alias("feature")).distinct()
    return rows.select(key, F.explode(tokens).alias("feature")).join(vocabulary, "feature").select(key, "feature", F.lit(1.0).alias("value"))


def idf_table(train: DataFrame, key: str, tokens: str) -> DataFrame:
    """ln((1+N)/(1+df))+1 per feature over distinct training entities: one entity is one document."""
    docs = train.groupBy(key).agg(F.first(tokens).alias("_t"))
    counted = docs.select(F.explode("_t").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("df"))
    total = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    return counted.join(F.broadcast(total)).withColumn("idf", F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)


def tf_idf(train: DataFrame, rows: DataFrame, key: str, tokens: str) -> DataFrame:
    """Sparse (key, feature, value) with unit length per entity over its known features."""
    idf = idf_table(train, key, tokens).select("feature", "idf")
    known = rows.select(key, F.explode(tokens).alias("feature")).join(idf, "feature")
    norm = known.groupBy(key).agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("_norm"))
    return known.join(norm, key).select(key, "feature", (F.col("idf") / F.col("_norm")).alias("value"))


def sparse_moments(sparse: DataFrame, weights: DataFrame, key: str, weight: str) -> DataFrame:
    """Count-weighted mean, population SD and a kept flag per sparse feature; absent cells are zeros."""
    total = weights.agg(F.sum(weight).alias("_w"))
    w = F.col(weight)
    sums = sparse.join(weights, key).groupBy("feature").agg(F.sum(w * F.col("value")).alias("_s"), F.sum(w * F.col("value") ** 2).alias("_ss"))
    mean = F.col("_s") / F.col("_w")
    var = F.greatest(F.col("_ss") / F.col("_w") - mean * mean, F.lit(0.0))
    out = sums.join(F.broadcast(total)).select("feature", mean.alias("mean"), F.sqrt(var).alias("scale"))
    return out.withColumn("kept", F.col("scale") > 1e-12)


def dense_columns(moments: DataFrame) -> list[tuple[str, float, float]]:
    """The fitted feature list (name, mean, scale), kept features only, in name order.

    It is as wide as the Gram matrix, which bounds it; wider vocabularies are refused, not cut.
    """
    got = moments.filter("kept").orderBy("feature").limit(MAX_FEATURES + 1).collect()
    if len(got) > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} features; a dense model is the wrong tool")
    return [(r["feature"], float(r["mean"]), float(r["scale"])) for r in got]


def densify(rows: DataFrame, sparse: DataFrame, key: str, columns: list[tuple[str, float, float]], name: str = "x") -> DataFrame:
    """Standardised dense vector per key; keys without known features get the standardised zeros."""
    packed = sparse.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("_m"))
    spec = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(m).alias("m"), F.lit(s).alias("s")) for f, m, s in columns])
    value = lambda c: (F.coalesce(F.try_element_at("_m", c["f"]), F.lit(0.0)) - c["m"]) / c["s"]
    return rows.join(packed, key, "left").withColumn("_spec", spec).withColumn(
        name, F.transform("_spec", lambda c: F.when(F.col("_m").isNull(), -c["m"] / c["s"]).otherwise(value(c)))
    ).drop("_m", "_spec")


# --- dense blocks ---------------------------------------------------------------------------------

def block_moments(vectors: DataFrame, x: str, weight: str | None = None) -> DataFrame:
    """Weighted mean and population SD per dimension of a dense block."""
    w = F.col("_w")
    rows = vectors.select((F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"), F.posexplode(x).alias("dim", "v"))
    sums = rows.groupBy("dim").agg(F.sum("_w").alias("n"), F.sum(w * F.col("v")).alias("s"), F.sum(w * F.col("v") * F.col("v")).alias("ss"))
    mean = F.col("s") / F.col("n")
    return sums.select("dim", mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))).alias("scale"))


def standardize_block(vectors: DataFrame, x: str, moments: DataFrame, name: str = "x") -> DataFrame:
    """Dense block minus mean over scale; constant dimensions are dropped. One moment row per dimension."""
    got = moments.orderBy("dim").collect()
    spec = F.array(*[F.struct(F.lit(r["dim"]).alias("d"), F.lit(r["mean"]).alias("m"), F.lit(r["scale"]).alias("s")) for r in got if r["scale"] > 1e-12])
    return vectors.withColumn("_spec", spec).withColumn(
        name, F.transform("_spec", lambda c: (F.get(F.col(x), c["d"]).cast("double") - c["m"]) / c["s"])
    ).drop("_spec")


def concat_blocks(a: DataFrame, b: DataFrame, key: str, name: str = "x") -> DataFrame:
    """Early fusion: both standardised blocks of an entity as one vector."""
    return a.select(key, F.col("x").alias("_a")).join(b.select(key, F.col("x").alias("_b")), key).select(key, F.concat("_a", "_b").alias(name))


def fit_projection(train: DataFrame, x: str, components: int):
    """Principal axes of distinct training vectors from their Gram: (mean, axes, variances).

    Only the d x d matrix reaches the driver. Axes point so that their largest entry is positive.
    """
    import numpy as np

    from .gram import accumulate, unpack

    rows = train.select(F.col(x).cast("array<double>").alias("x"), F.lit(1.0).alias("n"), F.lit(0.0).alias("sy"), F.lit(0.0).alias("syy"))
    m = unpack(accumulate(rows, []).toPandas())
    if components > min(len(m["mx"]), int(m["n"]) - 1):
        raise ValueError("more components than the training vectors can span")
    values, axes = np.linalg.eigh(m["sxx"] / (m["n"] - 1))
    top = np.argsort(values)[::-1][:components]
    axes = axes[:, top]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(components)])
    return m["mx"], axes, values[top]


def project(rows: DataFrame, x: str, mean, axes, keep: list[str], name: str = "pc") -> DataFrame:
    """Scores on the fitted axes for all rows, by matrix product per Arrow batch."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            flat = batch.column("_x").flatten().to_numpy(zero_copy_only=False)
            z = (flat.reshape(batch.num_rows, -1) - mean) @ axes if batch.num_rows else np.empty((0, axes.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(list(z), pa.list_(pa.float64()))], names=[*keep, name])

    slim = rows.select(*keep, F.col(x).cast("array<double>").alias("_x"))
    types = dict(slim.dtypes)
    return slim.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in keep), f"{name} array<double>"]))


def rank_lower_bound(sample: DataFrame, x: str) -> int:
    """Rank of the centred Gram of a bounded, evenly spaced sample: a lower bound for the whole."""
    import numpy as np

    from .gram import accumulate, unpack

    rows = sample.select(F.col(x).cast("array<double>").alias("x"), F.lit(1.0).alias("n"), F.lit(0.0).alias("sy"), F.lit(0.0).alias("syy"))
    values = np.linalg.eigvalsh(unpack(accumulate(rows, []).toPandas())["sxx"])
    return int((values > values.max() * len(values) * np.finfo(float).eps).sum())
