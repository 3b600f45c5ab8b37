"""Past-only window features: everything known strictly before a moment, ties excluded together.

No operator here keys a window on the market alone. Work is cut into (market, time shard) slices;
a slice is completed either by a halo of the neighbouring rows a frame can reach, or by the totals
of earlier shards, so a market holding a third of all trades still spreads over many tasks.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import DAY_US
from ..session import written


def halo_shards(df: DataFrame, us: str, back: int, shard: int, ahead: bool = False) -> DataFrame:
    """Assign rows to time shards and copy those a neighbouring shard's frames can reach.

    Adds ``_shard`` and ``_core`` (true in the row's own shard). With ``ahead`` the copies serve
    look-ahead frames of earlier shards, otherwise look-back frames of later ones.
    """
    own = F.floor(F.col(us) / F.lit(shard)).cast("bigint")
    reach = F.floor((F.col(us) + F.lit(-back if ahead else back)) / F.lit(shard)).cast("bigint")
    first, last = (reach, own) if ahead else (own, reach)
    return df.withColumn("_shard", F.explode(F.sequence(first, last))).withColumn("_core", F.col("_shard") == own)


def strictly_before(
    df: DataFrame, by: list[str], at: str, sums: list[str], maxima: list[str], shard: int
) -> DataFrame:
    """Running sums and maxima over all rows of the group with a strictly smaller ``at``.

    Two levels: totals per shard are accumulated over the short list of shards, then added to the
    running value inside the shard. Rows must be unique per (by, at).
    """
    cut = df.withColumn("_shard", F.floor(F.col(at) / F.lit(shard)).cast("bigint"))
    totals = cut.groupBy(*by, "_shard").agg(
        *[F.sum(c).alias(f"_t_{c}") for c in sums], *[F.max(c).alias(f"_t_{c}") for c in maxima]
    )
    earlier = W.partitionBy(*by).orderBy("_shard").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_shard",
        *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums],
        *[F.max(f"_t_{c}").over(earlier).alias(f"_o_{c}") for c in maxima],
    )
    inside = W.partitionBy(*by, "_shard").orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    local = cut.select(
        "*",
        *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{c}") for c in sums],
        *[F.max(c).over(inside).alias(f"_i_{c}") for c in maxima],
    )
    return local.join(offsets, [*by, "_shard"]).select(
        *[c for c in df.columns],
        *[(F.col(f"_i_{c}") + F.col(f"_o_{c}")).alias(f"{c}_before") for c in sums],
        *[F.greatest(f"_i_{c}", f"_o_{c}").alias(f"{c}_before") for c in maxima],
    )


def past_only_support(
    df: DataFrame, market: str, us: str, entity: str, window: int = 20 * DAY_US, shard: int | None = None
) -> DataFrame:
    """Per (market, us): trades and distinct entities in ``[us - window, us)`` and the latest of them.

    Both counts are differences of running sums. A trade counts for moments in ``(us, us+window]``.
    An entity counts once per window through its latest trade in it: a trade stops counting when the
    entity trades again (of equal moments all but one stop at once). So nothing is collected, no frame is
    re-scanned, and the rows are shuffled once, to the slices of their entity.
    """
    shard = shard or 3 * window
    look = W.partitionBy(market, entity, "_shard").orderBy(us)
    spans = (
        halo_shards(df.select(market, us, entity), us, window, shard, ahead=True)
        .withColumn("_next", F.lead(us).over(look))
        .filter("_core")
        .withColumn("_until", F.least(F.col("_next"), F.col(us) + F.lit(window)))
    )
    events = spans.select(
        market,
        F.explode(
            F.array(
                F.struct(F.col(us).alias("pos"), F.lit(1).cast("bigint").alias("dn"), F.lit(1).alias("de"), F.col(us).alias("seen")),
                F.struct((F.col(us) + F.lit(window)).alias("pos"), F.lit(-1).cast("bigint").alias("dn"), F.lit(0).alias("de"), F.lit(None).cast("bigint").alias("seen")),
                F.struct(F.col("_until").alias("pos"), F.lit(0).cast("bigint").alias("dn"), F.lit(-1).alias("de"), F.lit(None).cast("bigint").alias("seen")),
            )
        ).alias("e"),
    ).groupBy(market, F.col("e.pos").alias("pos")).agg(
        F.sum("e.dn").alias("dn"), F.sum("e.de").alias("de"), F.max("e.seen").alias("seen")
    )
    # Read twice below; written, they are computed once.
    run = strictly_before(written(events, "support_events"), [market], "pos", ["dn", "de"], ["seen"], shard)
    return run.filter(F.col("seen").isNotNull()).select(
        market,
        F.col("pos").alias(us),
        F.col("dn_before").alias("prior_n"),
        F.col("de_before").alias("prior_entities"),
        F.when(F.col("seen_before") >= F.col("pos") - F.lit(window), F.col("seen_before")).alias("prior_us"),
    )


def past_only_stat(
    df: DataFrame,
    market: str,
    us: str,
    value: str,
    window: int = 20 * DAY_US,
    stat: str = "median",
    name: str = "baseline",
    shard: int | None = None,
) -> DataFrame:
    """Per (market, us): exact median or mean of ``value`` over ``[us - window, us)``.

    Rows are first counted per (market, us, value), then framed inside halo shards.
    """
    shard = shard or 3 * window
    if stat == "median":
        points = df.groupBy(market, us, value).agg(F.count(F.lit(1)).alias("_c"))
        over = lambda w: F.percentile(value, F.lit(0.5), F.col("_c")).over(w)
    elif stat == "mean":
        points = df.groupBy(market, us).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
        over = lambda w: F.sum("_s").over(w) / F.sum("_c").over(w)
    else:
        raise ValueError(f"unknown statistic {stat!r}")
    frame = W.partitionBy(market, "_shard").orderBy(us).rangeBetween(-window, -1)
    framed = halo_shards(points, us, window, shard).withColumn(name, over(frame)).filter("_core")
    return framed.groupBy(market, us).agg(F.first(name).alias(name))


def sliding_medians(values: Sequence[float], first: Sequence[int], last: Sequence[int]) -> np.ndarray:
    """Median of ``values[first[k]:last[k]]`` for every k (NaN where empty); both ends never fall as k rises.

    NaN counts as the greatest value. Each value enters and leaves one sorted list once.
    """
    held: list[float] = []
    lo = hi = 0
    medians = np.full(len(first), np.nan)
    for k, (a, b) in enumerate(zip(first, last)):
        for v in values[hi:b]:
            if v == v:
                insort(held, v)
        for v in values[lo:a]:
            if v == v:
                del held[bisect_left(held, v)]
        lo, hi, n = a, b, b - a
        if n and n // 2 < len(held):
            medians[k] = (held[(n - 1) // 2] + held[n // 2]) / 2
    return medians


def sliding_distinct(values: Sequence, first: Sequence[int], last: Sequence[int]) -> np.ndarray:
    """Number of distinct ``values[first[k]:last[k]]`` for every k, under the same terms."""
    held: Counter = Counter()
    lo = hi = 0
    distinct = np.zeros(len(first), dtype=np.int64)
    for k, (a, b) in enumerate(zip(first, last)):
        held.update(values[hi:b])
        for v in values[lo:a]:
            held[v] -= 1
            if not held[v]:
                del held[v]
        lo, hi = a, b
        distinct[k] = len(held)
    return distinct


def past_only_median_sorted(
    df: DataFrame, market: str, us: str, value: str, window: int = 20 * DAY_US, name: str = "baseline", shard: int | None = None
) -> DataFrame:
    """Same result as ``past_only_stat`` for fine stamps, where a frame is re-read at every moment.

    Each (market, shard) slice keeps its window's values in one sorted list, entered and left by
    bisection, so a row costs two list updates instead of a visit per moment of its window.
    """
    shard = shard or 3 * window
    types = dict(df.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(us)
        moments = np.unique(pdf[us].to_numpy()[pdf["_core"].to_numpy()])
        # A null value has a moment but no place in a window; NaN has one, as the greatest.
        pdf = pdf[pdf["_known"]]
        at = pdf[us].to_numpy()
        first, last = np.searchsorted(at, moments - window), np.searchsorted(at, moments)
        medians = sliding_medians(pdf[value].astype(float).tolist(), first.tolist(), last.tolist())
        return pd.DataFrame({market: key[0], us: moments, name: medians, "_n": last - first})

    rows = df.select(market, us, value, F.col(value).isNotNull().alias("_known"))
    slices = halo_shards(rows, us, window, shard).groupBy(market, "_shard")
    out = slices.applyInPandas(run, f"{market} {types[market]}, {us} bigint, {name} double, _n bigint")
    return out.withColumn(name, F.when(F.col("_n") > 0, F.coalesce(name, F.lit(float("nan"))))).drop("_n")


def past_only_median_by_count(
    df: DataFrame, market: str, us: str, value: str, window: int = 20 * DAY_US, name: str = "baseline", cells: int = 64
) -> DataFrame:
    """Same result as ``past_only_stat`` for markets too hot to frame, when moments are coarse (days).

    Selection by counting: values fall into quantile cells of their market; additive cell counts per
    moment locate the cell that holds the middle rank; only the rows of that cell are then ordered.
    No task ever holds the values of a window. Cost grows with moments per window, so use it for
    daily stamps and the framed form for fine ones.
    """
    probs = [i / cells for i in range(1, cells)]
    points = df.groupBy(market, us, value).agg(F.count(F.lit(1)).alias("_c"))
    cuts = df.groupBy(market).agg(F.percentile_approx(value, probs, 20 * cells).alias("_cuts"))
    celled = points.join(cuts, market).withColumn(
        "_cell", F.size(F.filter("_cuts", lambda x: x < F.col(value)))
    ).drop("_cuts")
    moments = points.select(market, us).distinct()
    day = lambda c: F.floor(c / F.lit(DAY_US)).cast("bigint")
    probes = moments.select(
        F.col(market).alias("_m"), F.col(us).alias("_at"),
        F.explode(F.sequence(day(F.col(us) - F.lit(window)), day(F.col(us)))).alias("_day"),
    )
    inside = lambda d: (
        d.withColumn("_day", day(F.col(us)))
        .join(probes, (F.col(market) == F.col("_m")) & d_day(d) & (F.col(us) < F.col("_at")) & (F.col(us) >= F.col("_at") - F.lit(window)))
    )

    def d_day(_):
        return probes["_day"] == F.floor(F.col(us) / F.lit(DAY_US)).cast("bigint")

    counts = (
        inside(celled.groupBy(market, us, "_cell").agg(F.sum("_c").alias("_c")))
        .groupBy("_m", "_at", "_cell").agg(F.sum("_c").alias("_c"))
    )
    across = W.partitionBy("_m", "_at")
    placed = (
        counts.withColumn("_n", F.sum("_c").over(across))
        .withColumn("_to", F.sum("_c").over(across.orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_from", F.col("_to") - F.col("_c"))
        .withColumn("_r0", F.floor((F.col("_n") - 1) / 2).cast("bigint"))
        .withColumn("_r1", F.ceil((F.col("_n") - 1) / 2).cast("bigint"))
    )
    hit = lambda r: (F.col(r) >= F.col("_from")) & (F.col(r) < F.col("_to"))
    chosen = placed.filter(hit("_r0") | hit("_r1")).select("_m", "_at", "_cell", "_from", "_r0", "_r1")
    held = (
        inside(celled).join(chosen, ["_m", "_at", "_cell"])
        .groupBy("_m", "_at", "_cell", "_from", "_r0", "_r1", value).agg(F.sum("_c").alias("_c"))
    )
    order = W.partitionBy("_m", "_at", "_cell").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    ranked = held.withColumn("_to", F.col("_from") + F.sum("_c").over(order)).withColumn("_from", F.col("_to") - F.col("_c"))
    median = ranked.groupBy("_m", "_at").agg(
        F.max(F.when(hit("_r0"), F.col(value))).alias("_a"), F.max(F.when(hit("_r1"), F.col(value))).alias("_b")
    ).select(F.col("_m").alias(market), F.col("_at").alias(us), ((F.col("_a") + F.col("_b")) / 2).alias(name))
    return moments.join(median, [market, us], "left")


def attach(df: DataFrame, features: DataFrame, market: str, us: str) -> DataFrame:
    """Join per-moment features back to the trades."""
    return df.join(features, [market, us], "left")


def carried_lag(df: DataFrame, by: list[str], us: str, order: list[str], columns: list[str], shard: int) -> DataFrame:
    """Previous row's ``columns`` per group in time order, cut into time shards.

    Inside a shard it is a lag; the first row of a shard takes the last row of the nearest earlier
    shard, found over per-shard summaries.
    """
    cut = df.withColumn("_shard", F.floor(F.col(us) / F.lit(shard)).cast("bigint"))
    row = F.struct(*columns)
    last = cut.groupBy(*by, "_shard").agg(F.max_by(row, F.struct(us, *order)).alias("_last"))
    carry = last.select(*by, "_shard", F.lag("_last").over(W.partitionBy(*by).orderBy("_shard")).alias("_carry"))
    inner = W.partitionBy(*by, "_shard").orderBy(us, *order)
    local = cut.withColumn("_prev", F.lag(row).over(inner))
    joined = local.join(carry, [*by, "_shard"]).withColumn("_p", F.coalesce("_prev", "_carry"))
    return joined.select(*df.columns, *[F.col(f"_p.{c}").alias(f"prev_{c}") for c in columns])
