"""Gram statistics: the one aggregate every linear family needs, for a whole grid at once.

A row carries a feature vector ``x`` and the counted sufficient sums of its target: ``n`` (weight),
``sy`` and ``syy``. For a trade n = 1; for an entity n is its trade count, which gives the same
Gram as the expanded rows. With z = (1, x) the result holds, per group, row i of sum(n z z') next
to sum(sy z_i), so a group is d + 1 rows whatever the data size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def entity_targets(rows: DataFrame, by: list[str], entity: str, y: str) -> DataFrame:
    """Counted target sums per (by, entity)."""
    return rows.groupBy(*by, entity).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("sy"), F.sum(F.col(y) * F.col(y)).alias("syy")
    )


def accumulate(df: DataFrame, by: list[str], x: str = "x", n: str = "n", sy: str = "sy", syy: str = "syy") -> DataFrame:
    """Columns (by, i, g, b, c): Gram row i as an array, its target sum, and sum(syy) on row 0.

    Each task folds its rows into one matrix per group with a matrix product; the partial matrices
    are summed row-wise by Spark, so no single task merges them all.
    """
    key = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in by]) if by else F.lit("")
    slim = df.select(key.alias("key"), F.col(x).cast("array<double>").alias("x"), F.col(n).cast("double").alias("n"), F.col(sy).cast("double").alias("sy"), F.col(syy).cast("double").alias("syy"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = batch.column("key").to_pandas().to_numpy()
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            z = np.column_stack([np.ones(batch.num_rows), flat.reshape(batch.num_rows, -1)])
            num = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "sy", "syy")}
            for k in np.unique(keys):
                at = keys == k
                zk = z[at]
                full = np.zeros((z.shape[1], z.shape[1] + 2))
                full[:, :-2] = (zk * num["n"][at][:, None]).T @ zk
                full[:, -2] = zk.T @ num["sy"][at]
                full[0, -1] = num["syy"][at].sum()
                sums[k] = sums[k] + full if k in sums else full
        for k, full in sums.items():
            d = len(full)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * d), pa.array(range(d), pa.int32()), pa.array(list(full), pa.list_(pa.float64()))], names=["key", "i", "v"]
            )

    parts = slim.mapInArrow(partial, "key string, i int, v array<double>")
    total = parts.groupBy("key", "i").agg(Summarizer.sum(array_to_vector("v")).alias("v")).withColumn("v", vector_to_array("v"))
    names = F.split("key", "\u0001")
    types = dict(df.dtypes)
    return total.select(
        *[names[k].cast(types[c]).alias(c) for k, c in enumerate(by)],
        "i", F.slice("v", 1, F.size("v") - 2).alias("g"), F.element_at("v", -2).alias("b"), F.element_at("v", -1).alias("c"),
    )


def accumulate_columns(df: DataFrame, by: list[str], xs: list[str], n: str = "n", sy: str = "sy", syy: str = "syy") -> DataFrame:
    """The same result for a handful of feature columns, as plain JVM sums in one aggregate."""
    z = [F.lit(1.0), *[F.col(c) for c in xs]]
    d = len(z)
    aggs = [F.sum(F.col(n) * z[i] * z[j]).alias(f"g_{i}_{j}") for i in range(d) for j in range(i, d)]
    aggs += [F.sum(F.col(sy) * z[i]).alias(f"b_{i}") for i in range(d)] + [F.sum(syy).alias("c")]
    wide = df.groupBy(*by).agg(*aggs)
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("i"), F.array(*[F.col(f"g_{min(i, j)}_{max(i, j)}") for j in range(d)]).alias("g"),
            F.col(f"b_{i}").alias("b"), (F.col("c") if i == 0 else F.lit(0.0)).alias("c"),
        )
        for i in range(d)
    ])
    return wide.select(*by, F.inline(rows))


def before(grams: DataFrame, by: list[str], order: str) -> DataFrame:
    """Grams of everything strictly before each value of ``order``: prefix sums of every cell, so no row is read again.

    Cells are summed by (by, i, place), one number per value of ``order`` each; the first value, with
    nothing before it, has no Gram.
    """
    cells = grams.select(*by, order, "i", F.posexplode(F.concat("g", F.array("b", "c"))).alias("at", "v"))
    earlier = W.partitionBy(*by, "i", "at").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    sums = cells.withColumn("v", F.sum("v").over(earlier)).filter("v IS NOT NULL")
    rows = sums.groupBy(*by, order, "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("v"))
    return rows.select(*by, order, "i", F.slice("v", F.lit(1), F.size("v") - 2).alias("g"), F.element_at("v", -2).alias("b"), F.element_at("v", -1).alias("c"))


def unpack(pdf) -> dict:
    """Centred moments of one group from its Gram rows."""
    pdf = pdf.sort_values("i")
    g = np.vstack(pdf["g"].to_numpy())
    b = pdf["b"].to_numpy(dtype=float)
    n = g[0, 0]
    mx, my = g[0, 1:] / n, b[0] / n
    return dict(
        n=n, mx=mx, my=my, sxx=g[1:, 1:] - n * np.outer(mx, mx), sxy=b[1:] - n * mx * my, syy=float(pdf["c"].sum()) - n * my * my,
    )


GRAM_SCHEMA = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("g", T.ArrayType(T.DoubleType())), T.StructField("b", T.DoubleType()), T.StructField("c", T.DoubleType())])
