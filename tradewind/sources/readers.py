"""Scans with fixed schemas and the checks that belong to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_text_csv(spark: SparkSession, path: str, columns: list[str], multi_line: bool = False) -> DataFrame:
    """CSV as text columns chosen by header name, nothing inferred; blanks stay '' and never become null.

    Files may hold further columns in any order; a missing one raises, and so does a file whose header
    differs from the first one's. A byte-order mark in the header is dropped. ``multi_line`` accepts
    line ends inside quotes, at the price of one task per file.
    """
    reader = spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False).option("escape", '"')
    raw = reader.option("multiLine", multi_line).csv(path)
    raw = raw.toDF(*[c.removeprefix("\ufeff").strip() for c in raw.columns])
    if lost := [c for c in columns if c not in raw.columns]:
        raise ValueError(f"columns {lost} are not in the header {raw.columns}")
    return raw.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped, malformed ones fail the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_trait_documents(spark: SparkSession, path: str, traits: list[str]) -> DataFrame:
    """Nested documents with an attribute array, one column per trait plus duplicate flags."""
    docs = spark.read.schema(
        "entity bigint, metadata struct<attributes array<struct<trait_type string, value string>>, image string>"
    ).json(path)
    return flatten_traits(docs, traits)


def flatten_traits(docs: DataFrame, traits: list[str]) -> DataFrame:
    attributes = F.col("metadata.attributes")
    kinds = F.transform(attributes, lambda a: a["trait_type"])
    value = lambda name: F.try_element_at(F.filter(attributes, lambda a: a["trait_type"] == name), F.lit(1))["value"]
    flat = docs.select(
        "entity", *[value(t).alias(t) for t in traits],
        (F.size(F.array_distinct(kinds)) < F.size(kinds)).alias("duplicate_trait"),
        F.col("metadata.image").alias("image"),
    )
    repeated = flat.groupBy("entity").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("entity", F.lit(True).alias("duplicate_entity"))
    return flat.join(repeated, "entity", "left").withColumn("duplicate_entity", F.coalesce("duplicate_entity", F.lit(False)))


def flatten_json_map(df: DataFrame, keep: list[str], column: str) -> DataFrame:
    """A JSON object column as (key, value) rows."""
    parsed = F.from_json(column, T.MapType(T.StringType(), T.StringType()))
    return df.select(*keep, F.explode(parsed).alias("key", "value"))


def vector_checks(vectors: DataFrame, registry: DataFrame, key: str, vector: str) -> DataFrame:
    """One row: size, distinct ids, dimensions, non-finite entries, and ids missing or unexpected."""
    v = vectors.select(key, F.size(vector).alias("d"), F.exists(vector, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))).alias("bad"))
    ids = v.groupBy(key).agg(F.count(F.lit(1)).alias("c"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.max("bad").alias("bad"))
    both = ids.join(registry.select(key).distinct().withColumn("listed", F.lit(True)), key, "full_outer")
    return both.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"),
        F.count("c").alias("n_ids"),
        F.count_if(F.col("c") > 1).alias("n_duplicated"),
        F.min("lo").cast("bigint").alias("min_dim"),
        F.max("hi").cast("bigint").alias("max_dim"),
        F.count_if(F.col("bad")).alias("n_nonfinite"),
        F.count_if(F.col("c").isNull()).alias("n_missing"),
        F.count_if(F.col("listed").isNull()).alias("n_extra"),
    )


def bundle_checks(rows: DataFrame, row_id: str, cluster: str, numbers: list[str]) -> DataFrame:
    """One row: rows, repeated ids, non-finite numbers, clusters, rows without a cluster."""
    per_id = rows.groupBy(row_id).agg(
        F.count(F.lit(1)).alias("c"),
        F.count_if(sum_flags([~finite(n) for n in numbers])).alias("bad"),
        F.count_if(F.col(cluster).isNull()).alias("orphan"),
        F.first(cluster).alias("k"),
    )
    per_cluster = per_id.groupBy("k").agg(
        F.sum("c").alias("c"), F.count_if(F.col("c") > 1).alias("r"), F.sum("bad").alias("bad"), F.sum("orphan").alias("orphan")
    )
    return per_cluster.agg(
        F.sum("c").alias("n_rows"), F.sum("r").alias("repeated_ids"), F.sum("bad").alias("nonfinite_rows"),
        F.count("k").alias("n_clusters"), F.sum("orphan").alias("rows_without_cluster"),
    )


def finite(name: str):
    c = F.col(name)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def sum_flags(flags):
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out


def time_bounds(df: DataFrame, us: str, cutoff_us: int) -> DataFrame:
    return df.agg(
        F.min(us).alias("first_us"), F.max(us).alias("last_us"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(us) >= F.lit(cutoff_us)).alias("n_after_cutoff"),
    )


def select_datasets(catalog: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    """Requested ids with their catalog entry; ids the catalog lacks are labelled unknown."""
    known = requested.join(catalog, key, "inner").withColumn("status", F.lit("ok"))
    unknown = requested.join(catalog, key, "left_anti").withColumn("status", F.lit("unknown"))
    return known.unionByName(unknown, allowMissingColumns=True)
