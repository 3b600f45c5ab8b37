"""Trade-log cleaning: duplicate flags, the exclusion waterfall, pair and eligibility rules.

Flags that depend on other rows come from grouped counts joined back, not from windows keyed by the
group: counts combine on the map side, so a group of copies holding a third of the log costs one
row per task before the shuffle, and the join back can be split by adaptive execution.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import digest
from .temporal import halo_shards


def exact_extra_lines(df: DataFrame, columns: list[str], line: str) -> DataFrame:
    """Lines of every copy of a fully equal row but the one with the smallest ``line``."""
    # As 32 bytes; the text form would be shuffled at twice the size.
    narrow = df.select(line, F.coalesce(F.unhex(digest(*columns)), F.lit(bytearray())).alias("_digest"))
    copies = narrow.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"), F.min(line).alias("_first")).filter("_n > 1")
    return narrow.join(copies, "_digest").filter(F.col(line) != F.col("_first")).select(line)


def shared_key_lines(df: DataFrame, keys: list[str], line: str, distinct: str | None = None) -> DataFrame:
    """Lines whose key occurs more than once (or with more than one ``distinct`` value)."""
    if distinct is None:
        groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    else:
        groups = df.select(*keys, distinct).distinct().groupBy(*keys).agg(F.count(distinct).alias("_n"))
    return df.select(line, *keys).join(groups.filter("_n > 1").select(*keys), keys).select(line)


def attach_flags(df: DataFrame, line: str, flagged: dict[str, DataFrame]) -> DataFrame:
    """Boolean columns from lists of flagged lines.

    The key shuffles behind each list carry only the key and the line; the wide log itself meets all
    lists in one join on the unique line, which no group size can skew.
    """
    named = [lines.withColumn("_flag", F.lit(name)) for name, lines in flagged.items()]
    every = reduce(lambda a, b: a.unionByName(b), named)
    wide = every.groupBy(line).agg(*[F.bool_or(F.col("_flag") == n).alias(n) for n in flagged])
    return df.join(wide, line, "left").withColumns({n: F.coalesce(n, F.lit(False)) for n in flagged})


def flag_exact_extras(df: DataFrame, columns: list[str], line: str, name: str = "exact_extra") -> DataFrame:
    return attach_flags(df, line, {name: exact_extra_lines(df, columns, line)})


def flag_shared(df: DataFrame, keys: list[str], line: str, name: str, distinct: str | None = None) -> DataFrame:
    return attach_flags(df, line, {name: shared_key_lines(df, keys, line, distinct)})


def repeated_id(key: str, shared: str, extra: str) -> Column:
    """Missing id, or an id that repeats, on any row that is not already an exact extra."""
    blank = F.col(key).isNull() | (F.trim(key) == "")
    return (blank | F.col(shared)) & ~F.col(extra)


def waterfall(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Ordered exclusion: every rule's flag on the full frame, and the first one that hits."""
    flagged = df.select("*", *[F.coalesce(c, F.lit(False)).alias(f"flag_{n}") for n, c in rules])
    reason = F.coalesce(*[F.when(F.col(f"flag_{n}"), F.lit(n)) for n, _ in rules])
    step = F.coalesce(*[F.when(F.col(f"flag_{n}"), F.lit(i + 1)) for i, (n, _) in enumerate(rules)], F.lit(len(rules) + 1))
    return flagged.withColumn("first_exclusion", F.coalesce(reason, F.lit("clean"))).withColumn("step", step).withColumn(
        "base_clean", reason.isNull()
    )


def waterfall_flow(ledger: DataFrame, rules: list[str], entity: str) -> DataFrame:
    """Per rule: rows flagged, rows excluded at the step, rows and entities left after it.

    One pass over the ledger grouped by entity. An entity survives a step when any of its rows does,
    so its last surviving step is the maximum of its rows' steps; a histogram of that is enough.
    """
    n = len(rules)
    by_entity = ledger.groupBy(entity).agg(
        F.max("step").alias("_last"),
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(f"flag_{r}")).alias(f"_f{i}") for i, r in enumerate(rules)],
        *[F.count_if(F.col("step") == i + 1).alias(f"_e{i}") for i in range(n)],
    )
    totals = by_entity.agg(
        F.sum("_rows").alias("_rows"),
        *[F.sum(f"_f{i}").alias(f"_f{i}") for i in range(n)],
        *[F.sum(f"_e{i}").alias(f"_e{i}") for i in range(n)],
        *[F.count_if((F.col("_last") > i + 1) & F.col(entity).isNotNull()).alias(f"_k{i}") for i in range(n)],
    )
    left = lambda i: F.col("_rows") - sum((F.col(f"_e{j}") for j in range(1, i + 1)), F.col("_e0"))
    rows = F.array(*[
        F.struct(
            F.lit(i + 1).cast("bigint").alias("step"), F.lit(r).alias("rule"), F.col(f"_f{i}").alias("flagged"),
            F.col(f"_e{i}").alias("excluded"), left(i).alias("remaining_rows"), F.col(f"_k{i}").alias("remaining_entities"),
        )
        for i, r in enumerate(rules)
    ])
    return totals.select(F.inline(rows))


def flag_reverse_pairs(
    df: DataFrame, entity: str, us: str, order: list[str], buyer: str, seller: str, within: int, name: str = "reverse_pair", shard: int | None = None
) -> DataFrame:
    """Trade whose parties are those of the entity's previous trade swapped, 0 < gap <= ``within``.

    A previous trade further back than ``within`` cannot flag, so a halo of that length makes the
    lag exact inside (entity, shard) slices and no entity is ever ordered as a whole.
    """
    shard = shard or max(30 * within, 1)
    prev = W.partitionBy(entity, "_shard").orderBy(us, *order)
    lagged = halo_shards(df, us, within, shard).withColumn("_p", F.lag(F.struct(us, buyer, seller)).over(prev)).filter("_core")
    gap = F.col(us) - F.col(f"_p.{us}")
    low = lambda c: F.lower(c.cast("string"))
    hit = (
        (gap > 0) & (gap <= F.lit(within))
        & (low(F.col(buyer)) == low(F.col(f"_p.{seller}"))) & (low(F.col(seller)) == low(F.col(f"_p.{buyer}")))
    )
    return lagged.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_p", "_shard", "_core")


def issue_list(conditions: dict[str, Column]) -> Column:
    """Sorted, comma-joined names of the failed checks of one asset; empty when it is sound."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in sorted(conditions.items())])), ",")


def inventory_diff(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, labelled missing (expected only) or extra (actual only)."""
    missing = expected.select(key).distinct().join(actual, key, "left_anti").withColumn("kind", F.lit("missing"))
    extra = actual.select(key).distinct().join(expected, key, "left_anti").withColumn("kind", F.lit("extra"))
    return missing.unionByName(extra)


def cell_diff(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Cells that differ between two tables; a row missing on one side is reported once."""
    a = left.select(key, F.struct(*columns).alias("a"))
    b = right.select(key, F.struct(*columns).alias("b"))
    both = a.join(b, key, "full_outer")
    absent = F.when(F.col("a").isNull(), F.lit("left")).when(F.col("b").isNull(), F.lit("right"))
    cells = F.when(
        absent.isNotNull(),
        F.array(F.struct(F.concat(F.lit("missing_"), absent).alias("column"), F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"))),
    ).otherwise(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").cast("string").alias("a"), F.col(f"b.{c}").cast("string").alias("b")) for c in columns
    ]))
    listed = both.select(key, F.explode(cells).alias("x")).select(key, F.col("x.column").alias("column"), F.col("x.a").alias("left_value"), F.col("x.b").alias("right_value"))
    return listed.filter(F.col("column").startswith("missing_") | ~F.col("left_value").eqNullSafe(F.col("right_value")))
