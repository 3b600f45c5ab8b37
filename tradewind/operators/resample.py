"""Paired cluster bootstrap from sufficient sums: draws, replicates, intervals and their labels.

A draw takes as many clusters as there are, with replacement. Slot ``s`` of draw ``d`` picks cluster
``int(md5('<seed>:<d>:<s // 4>')[8*(s % 4) : +8], 16) % G``: reproducible in any SQL engine and equal
for every model, which is what makes the comparison paired. The modulo bias is at most G / 2**32.
Cluster numbers are 0-based ranks of the cluster key, so the order of the key is part of the draw.

Size is G * B slots, and none of them is ever a row: a task of ``bootstrap`` takes a few draws, makes the
slots of each once, keeps how often every cluster was drawn as a byte, and reads the sums through once,
adding them up by these counts. The sums are not shuffled, and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.md5 import numbered_digests
from ..functions.ranking import dense_index
from ..session import written


def cluster_stats(df: DataFrame, by: list[str], cluster: str, y: str, models: list[str], prefix: str = "p_") -> DataFrame:
    """n and squared-error sums per (by, cluster), numbered from 0 in cluster order, written once."""
    e = {m: F.col(y) - F.col(f"{prefix}{m}") for m in models}
    sums = df.groupBy(*by, F.col(cluster).alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("sum_y"), F.sum(F.col(y) * F.col(y)).alias("sum_yy"),
        *[F.sum(e[m] * e[m]).alias(f"sse_{m}") for m in models],
    )
    fixed = written(sums, "cluster_stats")
    size = fixed.groupBy(*by).agg(F.count(F.lit(1)).alias("g"))
    numbered = dense_index(fixed, "cluster", "cluster", "idx", by=by)
    sized = numbered.join(size, by) if by else numbered.join(F.broadcast(size))
    return written(sized, "numbered_stats")


#: Clusters in one row of sums, counts a task keeps (a byte each; one draw at least), clusters it adds up at once.
BLOCK_CLUSTERS, TASK_SLOTS, ADD_CLUSTERS = 1 << 8, 1 << 28, 1 << 14


def times_drawn(g: int, low: int, high: int, seed: int) -> list[np.ndarray]:
    """How often each of ``g`` clusters is picked by the ``g`` slots of every draw from ``low`` up to ``high``."""
    out, slots = [], np.empty(g, dtype=np.int64)
    for words in numbered_digests((b"%d:%d:" % (seed, draw) for draw in range(low, high)), -(-g // 4)):
        # Slot 4 * q + i is word i of digest q; which slot picks a cluster does not matter here, only how many do.
        done = 0
        for i, word in enumerate(words):
            some = slots[done : done + (g - i + 3) // 4]
            np.remainder(word[: len(some)], np.uint32(g), out=some, casting="unsafe")
            done += len(some)
        times = np.bincount(slots, minlength=g)
        out.append(times.astype(np.min_scalar_type(times.max())))
    return out


def bootstrap(stats: DataFrame, by: list[str], models: list[str], n_draws: int, seed: int, block_clusters: int = BLOCK_CLUSTERS, task_slots: int = TASK_SLOTS) -> DataFrame:
    """Per (by, draw) and model: transaction RMSE and equal-entity RMSE of the drawn clusters.

    The same as :func:`replicates` of :func:`draw_slots`, without a row per slot. Every slot is made once, by
    the one task of its draw. Memory of a task is a byte for each cluster and draw it has (as many draws as
    ``task_slots`` allows, at least one), the slots of one draw and a few rows of sums. A cluster whose sum is null
    for a model does not count for it. No groups, no rows.
    """
    sums = [f"sse_{m}" for m in models]
    key = [f for f in stats.schema.fields if f.name in by]
    key.sort(key=lambda f: by.index(f.name))
    block = T.StructType([*key, T.StructField("g", T.LongType()), T.StructField("idx", T.BinaryType()), T.StructField("packed", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes: dict[tuple, int] = {}
            keys = zip(*(batch.column(c).to_pylist() for c in by)) if by else [()] * len(batch)
            of = np.array([codes.setdefault(k, len(codes)) for k in keys], dtype=np.int64)
            idx = batch.column("idx").to_numpy(zero_copy_only=False)
            table = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("n", *sums)], axis=1)
            rows = [np.flatnonzero(of == c) for c in codes.values()]
            rows = [r[i : i + block_clusters] for r in rows for i in range(0, len(r), block_clusters)]
            first = pa.array([r[0] for r in rows], pa.int64())
            packed = [pa.array([v[r].tobytes() for r in rows], pa.binary()) for v in (idx, table)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(first) for c in (*by, "g")), *packed], names=block.names)

    partial = [f"{x}_{m}" for m in models for x in ("_s", "_e", "_k")]
    result = T.StructType([*key, T.StructField("draw", T.LongType()), T.StructField("_n", T.DoubleType()), *[T.StructField(c, T.DoubleType()) for c in partial]])

    def draws(rows: Iterator) -> Iterator[tuple]:
        times: dict[tuple, list[np.ndarray]] = {}
        total: dict[tuple, np.ndarray] = {}
        waiting: dict[tuple, list] = {}

        def add(k: tuple) -> None:
            idx, packed = (b"".join(x) for x in zip(*waiting.pop(k)))
            at, table = np.frombuffer(idx, dtype=np.int64), np.frombuffer(packed, dtype=np.float64).reshape(-1, 1 + len(models))
            n, sse = table[:, :1], table[:, 1:]
            known = ~np.isnan(sse)
            each = np.stack((np.where(known, sse, 0), np.where(known, sse / n, 0), known.astype(np.float64)), axis=2)
            wide = np.concatenate((n, each.reshape(len(table), -1)), axis=1)
            total[k] += np.stack([t[at] for t in times[k]]).astype(np.float64) @ wide

        low = high = 0
        for row in rows:
            k, low, high = tuple(row[c] for c in by), row["low"], min(row["low"] + a_task, n_draws)
            if k not in times:
                times[k], total[k] = times_drawn(row["g"], low, high, seed), np.zeros((high - low, 1 + len(partial)))
            mine = waiting.setdefault(k, [])
            mine.append((row["idx"], row["packed"]))
            if len(mine) * len(row["idx"]) >= 8 * ADD_CLUSTERS:
                add(k)
        for k in list(waiting):
            add(k)
        for k, sums_of in total.items():
            for draw, values in zip(range(low, high), sums_of.tolist()):
                yield (*k, draw, *values)

    spark = stats.sparkSession
    clusters = stats.count()
    a_task = max(1, min(-(-n_draws // (4 * spark.sparkContext.defaultParallelism)), task_slots // max(clusters, 1)))
    blocks = written(stats.select(*by, "g", "idx", "n", *sums).mapInArrow(pack, block), "sum_blocks")
    # A task is one range of draws and reads all blocks, which so are neither shuffled nor copied.
    tasks = spark.range(0, n_draws, a_task, -(-n_draws // a_task)).withColumnRenamed("id", "low")
    pairs = blocks.coalesce(1).hint("shuffle_replicate_nl").crossJoin(tasks)
    # As plain rows, each is a batch of its own; an Arrow batch would hold very many blocks at once.
    added = spark.createDataFrame(pairs.rdd.mapPartitions(draws), result, verifySchema=False)
    root = lambda top, under: F.when(F.col(under) > 0, F.sqrt(F.col(top) / F.col(under)))
    some = lambda m, c: F.when(F.col(f"_k_{m}") > 0, c)
    return added.select(
        *by, "draw",
        *[some(m, root(f"_s_{m}", "_n")).alias(f"rmse_{m}") for m in models],
        *[root(f"_e_{m}", f"_k_{m}").alias(f"entity_rmse_{m}") for m in models],
    )


def draw_slots(stats: DataFrame, by: list[str], n_draws: int, seed: int) -> DataFrame:
    """(by, draw, idx): one row per slot of every draw."""
    # A small table grows n_draws-fold here, so it is spread over an explicit number of tasks first.
    spread = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fours = stats.filter(F.col("idx") % 4 == 0).repartition(spread, "idx").select(
        *by, "g", F.col("idx").alias("slot"), F.expr("idx div 4").alias("quad"), F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("draw")
    )
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("draw"), F.col("quad")).cast("binary"))
    parts = F.array(*[F.substring("_md5", 8 * i + 1, 8) for i in range(4)])
    slots = fours.withColumn("_md5", key).select(*by, "g", "slot", "draw", F.posexplode(parts).alias("k", "hex"))
    picked = slots.filter(F.col("slot") + F.col("k") < F.col("g"))
    return picked.select(*by, F.col("draw").cast("bigint").alias("draw"), (F.conv("hex", 16, 10).cast("bigint") % F.col("g")).alias("idx"))


def replicates(stats: DataFrame, slots: DataFrame, by: list[str], models: list[str]) -> DataFrame:
    """Per (by, draw) and model: transaction RMSE and equal-entity RMSE of the drawn clusters.

    ``slots`` is a draw table, supplied or from :func:`draw_slots`; for generated draws :func:`bootstrap`
    gives the same without the table.
    """
    # Slots are made rows whose number Spark underestimates, so neither side may become a broadcast.
    j = slots.join(stats.select(*by, "idx", "n", *[f"sse_{m}" for m in models]).hint("merge"), [*by, "idx"])
    sums = j.groupBy(*by, "draw").agg(
        F.sum("n").alias("_n"),
        *[F.sum(f"sse_{m}").alias(f"_s_{m}") for m in models],
        *[F.avg(F.col(f"sse_{m}") / F.col("n")).alias(f"_e_{m}") for m in models],
    )
    return sums.select(
        *by, "draw",
        *[F.sqrt(F.col(f"_s_{m}") / F.col("_n")).alias(f"rmse_{m}") for m in models],
        *[F.sqrt(F.col(f"_e_{m}")).alias(f"entity_rmse_{m}") for m in models],
    )


def long_replicates(reps: DataFrame, keep: list[str], models: list[str], metrics: list[str]) -> DataFrame:
    rows = F.array(*[
        F.struct(F.lit(k).alias("metric"), F.lit(m).alias("model"), F.col(f"{k}_{m}").alias("value")) for k in metrics for m in models
    ])
    return reps.select(*keep, "draw", F.inline(rows))


def deltas(reps: DataFrame, keep: list[str], contrasts: list[tuple[str, str, str]], metrics: list[str]) -> DataFrame:
    """Per draw and contrast: candidate minus reference, and improvement in percent of the reference."""
    rows = F.array(*[
        F.struct(
            F.lit(kind).alias("kind"), F.lit(cand).alias("candidate"), F.lit(ref).alias("reference"), F.lit(k).alias("metric"),
            (F.col(f"{k}_{cand}") - F.col(f"{k}_{ref}")).alias("delta"),
            F.try_divide(100 * (F.col(f"{k}_{ref}") - F.col(f"{k}_{cand}")), F.col(f"{k}_{ref}")).alias("improvement"),
        )
        for kind, cand, ref in contrasts for k in metrics
    ])
    return reps.select(*keep, "draw", F.inline(rows))


def level_probs(levels: dict[str, float]) -> list[float]:
    return [p for level in levels.values() for p in ((1 - level / 100) / 2, 1 - (1 - level / 100) / 2)]


def intervals(changes: DataFrame, keys: list[str], levels: dict[str, float]) -> DataFrame:
    """Linear-percentile intervals of delta and improvement; a group holds one row per draw."""
    probs = F.array(*[F.lit(p) for p in level_probs(levels)])
    agg = changes.groupBy(*keys).agg(
        F.percentile("delta", probs).alias("_d"), F.percentile("improvement", probs).alias("_u"),
        F.avg((F.col("delta") < 0).cast("double")).alias("share_better"),
        F.count(F.lit(1)).alias("n_draws"), (F.max("delta") - F.min("delta")).alias("spread"),
    )
    cols = []
    for i, name in enumerate(levels):
        cols += [F.col("_d")[2 * i].alias(f"ci{name}_low"), F.col("_d")[2 * i + 1].alias(f"ci{name}_high")]
        cols += [F.col("_u")[2 * i].alias(f"gain{name}_low"), F.col("_u")[2 * i + 1].alias(f"gain{name}_high")]
    return agg.select(*keys, "n_draws", "share_better", "spread", *cols)


def empirical_p(changes: DataFrame, keys: list[str], bonferroni: int = 2) -> DataFrame:
    """Two-sided share of draws on the other side of zero with +1 smoothing, and its correction."""
    below, above = F.count_if(F.col("delta") <= 0), F.count_if(F.col("delta") >= 0)
    p = F.least(F.lit(1.0), 2 * (F.least(below, above) + 1) / (F.count(F.lit(1)) + 1))
    out = changes.groupBy(*keys).agg(p.alias("p_value"))
    return out.withColumn("p_adjusted", F.least(F.lit(1.0), bonferroni * F.col("p_value")))


def status(n_clusters: Column, target_sd: Column, spread: Column) -> Column:
    return (
        F.when((n_clusters < 2) | (target_sd <= 0) | spread.isNull(), "interval_unavailable")
        .when(spread == 0, "degenerate_contrast").otherwise("ok")
    )


def conclusion(low: Column, high: Column) -> Column:
    return F.when(low > 0, "higher").when(high < 0, "lower").when(low.isNotNull(), "includes_zero")


def threshold_label(low: Column, high: Column, percent: float) -> Column:
    """Where an improvement interval lies relative to a practical threshold."""
    t = F.lit(float(percent))
    return F.when(low >= t, "improves").when(high <= -t, "worsens").when((low > -t) & (high < t), "within").otherwise("inconclusive")


def row_expansion(df: DataFrame, stats: DataFrame, slots: DataFrame, by: list[str], cluster: str, y: str, models: list[str], n_draws: int) -> DataFrame:
    """The first draws recomputed from expanded rows instead of cluster sums: both metrics, each from the rows alone."""
    first = slots.filter(F.col("draw") < n_draws).join(stats.select(*by, "idx", F.col("cluster").alias(cluster)), [*by, "idx"])
    # A cluster drawn k times weighs its rows k times; one row per (draw, cluster) keeps the join flat.
    times = first.groupBy(*by, "draw", cluster).agg(F.count(F.lit(1)).alias("k"))
    rows = df.join(times, [*by, cluster])
    e = {m: F.col(y) - F.col(f"p_{m}") for m in models}
    each = rows.groupBy(*by, "draw", cluster, "k").agg(*[F.avg(e[m] * e[m]).alias(f"_{m}") for m in models])
    equal = each.groupBy(*by, "draw").agg(*[F.sqrt(F.sum(F.col("k") * F.col(f"_{m}")) / F.sum("k")).alias(f"direct_entity_{m}") for m in models])
    direct = rows.groupBy(*by, "draw").agg(*[F.sqrt(F.sum(F.col("k") * e[m] * e[m]) / F.sum("k")).alias(f"direct_{m}") for m in models])
    return direct.join(equal, [*by, "draw"])
