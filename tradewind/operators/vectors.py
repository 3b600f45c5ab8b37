"""Audits of embedding tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimension_audit(df: DataFrame, vector: str) -> DataFrame:
    """Per dimension: range, NaN and infinities, and whether it never varies. Combines map-side."""
    v = F.col("v")
    return (
        df.select(F.posexplode(vector).alias("dim", "v")).withColumn("v", v.cast("double")).groupBy("dim").agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.count_if(F.isnan("v")).alias("n_nan"),
            F.count_if(v == float("inf")).alias("n_pos_inf"), F.count_if(v == float("-inf")).alias("n_neg_inf"), (F.min("v") == F.max("v")).alias("is_constant"),
        )
    )
