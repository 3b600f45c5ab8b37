"""Set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import in_window
from ..operators.verify import gap
from ..sources.sinks import union_all
from ..sources.tables import FOLD_CTES, FOLDS, PREDS, TARGETS, TRADES
from .registry import query


@query("set1", """SELECT 'part_only' AS side, count(*) AS n FROM (SELECT p_partkey FROM part EXCEPT SELECT vec_id FROM embeddings)
UNION ALL SELECT 'vector_only', count(*) FROM (SELECT vec_id FROM embeddings EXCEPT SELECT p_partkey FROM part)""")
def set1(t):
    a, b = t.read("part").select(F.col("p_partkey").alias("id")), t.read("embeddings").select(F.col("vec_id").alias("id"))
    count = lambda df, side: df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"))
    return count(a.subtract(b), "part_only").unionByName(count(b.subtract(a), "vector_only"))


@query("set2", f"""WITH {PREDS} SELECT count(*) AS n_rows, count(*) FILTER (WHERE seen) AS n_seen, count(*) FILTER (WHERE NOT seen) AS n_unseen, 0::BIGINT AS shared_rows, 0::BIGINT AS shared_entities, 0::BIGINT AS uncovered_rows FROM preds""")
def set2(t):
    """Seen and unseen rows partition the evaluation set, on rows and on entities."""
    rows = t.preds.select("source_row", "entity", "seen")
    seen, unseen = rows.filter("seen"), rows.filter("NOT seen")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    shared = n(seen.select("source_row").intersect(unseen.select("source_row")), "shared_rows")
    entities = n(seen.select("entity").intersect(unseen.select("entity")), "shared_entities")
    uncovered = n(rows.select("source_row").exceptAll(seen.select("source_row").unionByName(unseen.select("source_row"))), "uncovered_rows")
    totals = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("seen").alias("n_seen"), F.count_if(~F.col("seen")).alias("n_unseen"))
    # Four one-row results side by side.
    key = lambda df: df.withColumn("_one", F.lit(1))
    return key(totals).join(key(shared), "_one").join(key(entities), "_one").join(key(uncovered), "_one").drop("_one")


@query("set3", f"""WITH {FOLD_CTES} SELECT fold, 0::BIGINT AS overlap, max(us) FILTER (WHERE role = 'train') AS last_train_us, min(us) FILTER (WHERE role = 'valid') AS first_valid_us,
  max(us) FILTER (WHERE role = 'train') < min(us) FILTER (WHERE role = 'valid') AS ordered FROM fold_rows GROUP BY 1""")
def set3(t):
    rows = t.fold_rows
    ids = rows.groupBy("fold", "source_row").agg(F.min("role").alias("lo"), F.max("role").alias("hi"), F.max(F.when(F.col("role") == "train", F.col("us"))).alias("a"), F.min(F.when(F.col("role") == "valid", F.col("us"))).alias("b"))
    out = ids.groupBy("fold").agg(F.count_if(F.col("lo") != F.col("hi")).alias("overlap"), F.max("a").alias("last_train_us"), F.min("b").alias("first_valid_us"))
    return out.withColumn("ordered", F.col("last_train_us") < F.col("first_valid_us"))


@query("set4", """SELECT n_nationkey AS id, n_name AS name, n_regionkey AS parent FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region""")
def set4(t):
    a = t.read("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent"))
    b = t.read("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return union_all([a, b])


@query("set5", f"""WITH {PREDS} SELECT seen, count(*) AS n, 0::BIGINT AS unmatched, true AS agrees FROM preds GROUP BY 1""")
def set5(t):
    """Every derived evaluation row agrees with its base target on the shared columns."""
    j = t.preds.select("source_row", "seen", "y").join(t.targets.select("source_row", F.col("y").alias("base_y")), "source_row", "left")
    return j.groupBy("seen").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("base_y").isNull()).alias("unmatched"), F.bool_and(F.col("y") == F.col("base_y")).alias("agrees"))


@query("set6", """WITH q AS (SELECT DISTINCT concat(year(o_orderdate), 'Q', quarter(o_orderdate)) AS quarter FROM orders WHERE o_orderdate >= '1998-01-01' AND o_orderdate < '1999-07-01'
UNION SELECT DISTINCT concat(year(o_orderdate), 'Q', quarter(o_orderdate)) FROM orders WHERE o_orderdate >= '1999-01-01' AND o_orderdate < '2000-01-01') SELECT quarter FROM q""")
def set6(t):
    """Union of two quarter schedules without repeats."""
    q = F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("quarter")
    o = t.read("orders")
    a = o.filter(in_window(F.col("o_orderdate"), "1998-01-01", "1999-07-01")).select(q).distinct()
    b = o.filter(in_window(F.col("o_orderdate"), "1999-01-01", "2000-01-01")).select(q).distinct()
    return a.unionByName(b).distinct()
