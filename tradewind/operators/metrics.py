"""Error metrics per transaction and per entity, as additive sums over wide prediction columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_models(df: DataFrame, keep: list[str], models: list[str], fields: dict[str, str], name: str = "model") -> DataFrame:
    """Wide per-model columns to one row per model; ``fields`` maps output name to a column prefix."""
    rows = F.array(*[
        F.struct(F.lit(m).alias(name), *[F.col(f"{prefix}{m}").alias(out) for out, prefix in fields.items()]) for m in models
    ])
    return df.select(*keep, F.inline(rows))


def entity_sums(df: DataFrame, by: list[str], cluster: str, y: str, models: list[str], prefix: str = "p_") -> DataFrame:
    """Sufficient sums per (by, cluster): n, target moments, and squared and absolute error per model."""
    e = {m: F.col(y) - F.col(f"{prefix}{m}") for m in models}
    return df.groupBy(*by, cluster).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(y).alias("mean_y"),
        F.var_pop(y).alias("var_y"),
        *[F.sum(e[m] * e[m]).alias(f"sse_{m}") for m in models],
        *[F.sum(F.abs(e[m])).alias(f"sae_{m}") for m in models],
    )


def score(df: DataFrame, by: list[str], cluster: str, y: str, models: list[str], prefix: str = "p_") -> DataFrame:
    """RMSE, MAE, R2 (null when the target is constant) and equal-entity RMSE, one row per model.

    One shuffle on (by, cluster) with map-side sums; the second level works on entity sums.
    """
    return score_sums(entity_sums(df, by, cluster, y, models, prefix), by, models)


def score_sums(sums: DataFrame, by: list[str], models: list[str]) -> DataFrame:
    total = sums.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("n_entities"),
        F.sum(F.col("n") * F.col("mean_y")).alias("_sy"),
        F.sum(F.col("n") * (F.col("var_y") + F.col("mean_y") * F.col("mean_y"))).alias("_syy"),
        *[F.sum(f"sse_{m}").alias(f"sse_{m}") for m in models],
        *[F.sum(f"sae_{m}").alias(f"sae_{m}") for m in models],
        *[F.avg(F.col(f"sse_{m}") / F.col("n")).alias(f"emse_{m}") for m in models],
    )
    sst = F.col("_syy") - F.col("_sy") * F.col("_sy") / F.col("n")
    long = long_models(total.withColumn("sst", sst), [*by, "n", "n_entities", "sst"], models, {"sse": "sse_", "sae": "sae_", "emse": "emse_"})
    return long.select(
        *by, "model", "n", "n_entities",
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
        (F.col("sae") / F.col("n")).alias("mae"),
        r_squared(F.col("sse"), F.col("sst"), F.col("n")).alias("r2"),
        F.sqrt("emse").alias("entity_rmse"),
    )


def r_squared(sse: Column, sst: Column, n: Column) -> Column:
    """1 - SSE/SST, null for a constant target (SST zero up to rounding)."""
    return F.when(sst / n > 1e-15, 1 - sse / sst)


def balanced_score(df: DataFrame, by: list[str], cluster: str, y: str, models: list[str], prefix: str = "p_") -> DataFrame:
    """Metrics with every entity weighted equally (row weight 1/count), from entity sums alone."""
    sums = entity_sums(df, by, cluster, y, models, prefix)
    total = sums.groupBy(*by).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_entities"),
        F.avg("mean_y").alias("_m"), F.avg(F.col("var_y") + F.col("mean_y") * F.col("mean_y")).alias("_m2"),
        *[F.avg(F.col(f"sse_{m}") / F.col("n")).alias(f"mse_{m}") for m in models],
        *[F.avg(F.col(f"sae_{m}") / F.col("n")).alias(f"mae_{m}") for m in models],
    ).withColumn("sst", F.col("_m2") - F.col("_m") * F.col("_m"))
    long = long_models(total, [*by, "n", "n_entities", "sst"], models, {"mse": "mse_", "mae": "mae_"})
    return long.select(
        *by, "model", "n", "n_entities", F.sqrt("mse").alias("rmse"), "mae",
        F.when(F.col("sst") > 1e-15, 1 - F.col("mse") / F.col("sst")).alias("r2"), F.sqrt("sst").alias("target_sd"),
    )


def rollup_entities(sums: DataFrame, keys: list[str], cluster: str, models: list[str]) -> DataFrame:
    """Merge sums of finer groups (say subgroups) into coarser ones without another pass over rows."""
    n_mean = F.sum(F.col("n") * F.col("mean_y")) / F.sum("n")
    second = F.sum(F.col("n") * (F.col("var_y") + F.col("mean_y") * F.col("mean_y"))) / F.sum("n")
    return sums.groupBy(*keys, cluster).agg(
        F.sum("n").alias("n"), n_mean.alias("mean_y"), (second - n_mean * n_mean).alias("var_y"),
        *[F.sum(f"sse_{m}").alias(f"sse_{m}") for m in models], *[F.sum(f"sae_{m}").alias(f"sae_{m}") for m in models],
    )
