"""Gradient-boosted trees of many folds and configurations, grown from histograms.

Features are cut into bins once, and rows of equal bins are added up, as no tree can part them. The squared
loss lets an entity stand for all its trades by its count and target sum. A model is a (fit, configuration)
pair. While the distinct rows fit one task (``BOOST_ROWS``), every model is grown whole by a task of its own;
of more, every pass over the rows returns one sum of (model, leaf, feature, bin) gradients and counts for all
models at once, and the driver sees only these sums, whose size does not depend on the number of rows. Both
ways grow by the same steps. Leaves grow best gain first; the left child of a split is counted, the right one
is its parent's remainder. Of each feature only the bins beside its most frequent one are counted; that one is
the leaf's remainder, so a one-hot feature costs its ones only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Trees after which the kept predictions are made from the written rows; bytes of sums the driver adds without a tree of adders.
REBUILD_EVERY, FLAT_REDUCE = 25, 8 << 20
#: Distinct rows up to which a task grows a whole model.
BOOST_ROWS = 250_000


@dataclass(frozen=True)
class Growth:
    """``by_depth`` splits whole levels down to ``depth``, otherwise the best leaves until there are ``leaves``."""

    rate: float
    leaves: int
    l2: float
    min_rows: float = 20.0
    by_depth: bool = False

    @property
    def depth(self) -> int:
        return int(np.log2(self.leaves + 1)) if self.by_depth else self.leaves


def bin_edges(rows: DataFrame, x: str, bins: int = 255) -> list[np.ndarray]:
    """Cut values of each feature: its distinct values, or quantiles of them where there are more than ``bins``."""
    probs = F.array(*[F.lit((i + 1) / bins) for i in range(bins)])
    cells = rows.select(F.posexplode(x).alias("f", "v")).where("v is not null and not isnan(v)")
    per = cells.groupBy("f").agg(F.percentile_approx("v", probs, 40 * bins).alias("cuts")).orderBy("f").collect()
    found = {r["f"]: np.unique(np.array(r["cuts"], dtype=np.float64)) for r in per}
    return [found.get(i, np.zeros(1)) for i in range(max(found, default=-1) + 1)]


def _cells(rows: DataFrame, key: str, x: str, n: str, s: str, edges: list[np.ndarray]) -> DataFrame:
    """Every row with its bins as bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                features = pa.array([b.tobytes() for b in _binned(_wide(batch.column("x")), edges)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("key"), features, batch.column("n"), batch.column("s")], names=["key", "features", "n", "s"])

    kind = rows.schema[key].dataType.simpleString()
    doubles = [F.col(c).cast("array<double>").alias(a) for c, a in ((x, "x"), (n, "n"), (s, "s"))]
    return rows.select(F.col(key).alias("key"), *doubles).mapInArrow(cut, f"key {kind}, features binary, n array<double>, s array<double>")


def _packed(groups: DataFrame) -> DataFrame:
    """One row for each batch of distinct rows: number of rows, bins, counts and sums as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                parts = (b"".join(batch.column("features").to_pylist()), _wide(batch.column("n")).tobytes(), _wide(batch.column("s")).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64()), *(pa.array([v], pa.binary()) for v in parts)], names=["r", "bins", "n", "s"])

    return groups.select("features", "n", "s").mapInArrow(pack, "r long, bins binary, n binary, s binary")


class _Trees:
    """One tree of every model, as arrays (model, node); a leaf is its own child."""

    def __init__(self, models: int, nodes: int):
        self.feature, self.cut = np.zeros((models, nodes), dtype=np.int32), np.zeros((models, nodes), dtype=np.int32)
        self.left = np.tile(np.arange(nodes, dtype=np.int32), (models, 1))
        self.right, self.value, self.depth = self.left.copy(), np.zeros((models, nodes)), 0

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        """Place of every row's node, counted through the nodes of all models (row, model)."""
        models, nodes = self.feature.shape
        base, rows = np.arange(models) * nodes, (np.arange(len(bins)) * bins.shape[1])[:, None]
        flat, feature, cut = bins.ravel(), self.feature.ravel(), self.cut.ravel()
        child = np.stack((self.right + base[:, None], self.left + base[:, None]), axis=-1).ravel()
        at = np.tile(base, (len(bins), 1))
        for _ in range(self.depth):
            goes = flat.take(feature.take(at) + rows) <= cut.take(at)
            at = child.take(2 * at + goes)
        return at

    def add_to(self, p: np.ndarray, bins: np.ndarray) -> None:
        p += self.value.ravel().take(self.leaf(bins))


@dataclass(frozen=True)
class _Block:
    """Rows of one packed batch; (``row``, ``place``) are the cells beside each feature's usual bin, places counted through all bins."""

    bins: np.ndarray
    n: np.ndarray
    s: np.ndarray
    p: np.ndarray
    row: np.ndarray
    place: np.ndarray

    def after(self, tree: _Trees) -> _Block:
        p = self.p.copy()
        tree.add_to(p, self.bins)
        return replace(self, p=p)


def _unpacked(row, fits: int, start: np.ndarray, trees: list[_Trees]) -> tuple:
    n = np.frombuffer(row["n"]).reshape(-1, fits)
    bins = np.frombuffer(row["bins"], dtype=np.uint8).reshape(len(n), -1)
    p = np.tile(start, (len(n), 1))
    for tree in trees:
        tree.add_to(p, bins)
    return bins, n, np.frombuffer(row["s"]).reshape(-1, fits), p


def _block(unpacked: tuple, usual: np.ndarray, first: np.ndarray) -> _Block:
    row, feature = np.nonzero(unpacked[0] != usual)
    return _Block(*unpacked, row, unpacked[0][row, feature] + first[feature])


def _totals(row, fits: int, first: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Target sums and counts of every fit, and rows in every bin."""
    bins, n, s, _ = _unpacked(row, fits, np.zeros(1), [])
    return s.sum(0), n.sum(0), np.bincount((bins + first).ravel(), minlength=total)


def _histogram(blocks: Iterator[_Block], tree: _Trees, slot: np.ndarray, begin: np.ndarray, fit: np.ndarray, total: int) -> Iterator[np.ndarray]:
    """Sums of gradient and count by (slot, bin of feature), and of the whole slot as last bin, usual bins left out.

    ``slot`` numbers the wanted nodes of each model from 0 (-1: not wanted); model m has the slots from ``begin[m]``.
    """
    out = np.zeros((begin[-1], total + 1, 2))
    for b in blocks:
        at = slot.ravel().take(tree.leaf(b.bins))
        for m in np.flatnonzero(np.diff(begin)):
            count = b.n[:, fit[m]]
            weights = (count * b.p[:, m] - b.s[:, fit[m]], count)
            mine = np.where(count > 0, at[:, m], -1)
            rows, size = np.flatnonzero(mine >= 0), begin[m + 1] - begin[m]
            of = mine.take(b.row)
            cells = np.flatnonzero(of >= 0)
            cell, on = of[cells] * (total + 1) + b.place[cells], b.row[cells]
            for k, weight in enumerate(weights):
                to = out[begin[m] : begin[m + 1], :, k]
                to += np.bincount(cell, weights=weight[on], minlength=size * (total + 1)).reshape(size, -1)
                to[:, total] += np.bincount(mine[rows], weights=weight[rows], minlength=size)
    yield out


def _completed(hist: np.ndarray, first: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """Histograms by (slot, bin) with each feature's usual bin as the slot's remainder."""
    cells, whole = hist[:, :-1].copy(), hist[:, -1:]
    cells[:, first + usual] = whole - np.add.reduceat(cells, first, axis=1)
    return cells


@dataclass(frozen=True)
class _Shape:
    """What growing needs of the models and the bins; ``fit`` and ``grown`` are the fit and the growth of each model."""

    fit: np.ndarray
    grown: list[Growth]
    width: np.ndarray
    usual: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.width)[:-1]))

    @property
    def total(self) -> int:
        return int(self.width.sum())

    @property
    def nodes(self) -> int:
        return 2 * max(1 << c.depth if c.by_depth else c.leaves for c in self.grown) - 1


def _boosted(shape: _Shape, trees: int, passes: Callable[[list[_Trees]], Callable]) -> list[_Trees]:
    """All trees of all models. ``passes`` is told the trees so far and gives what sums the wanted nodes of the next one."""
    fit, grown, width, first, total = shape.fit, shape.grown, shape.width, shape.first, shape.total
    l2, least, rate = (np.array([getattr(c, a) for c in grown]) for a in ("l2", "min_rows", "rate"))
    budget, deepest = np.array([c.leaves if not c.by_depth else 1 << c.depth for c in grown]), np.array([c.depth for c in grown])
    # A cut after the last bin of a feature parts nothing.
    usable = np.ones(total, dtype=bool)
    usable[first + width - 1] = False
    feature_of = np.repeat(np.arange(len(width)), width)
    before, later = np.where(first > 0, first - 1, 0), first[:, None] > 0

    def best(hist: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
        """Gain, cut and left sums of the best split of each slot; ``of`` is its model."""
        sums = np.cumsum(hist, axis=1)
        left = sums - np.where(later, sums[:, before], 0)[:, feature_of]
        whole = sums[:, width[0] - 1][:, None]
        right = whole - left
        score = lambda a: a[..., 0] ** 2 / np.maximum(a[..., 1] + l2[of][:, None], 1e-300)
        gain = score(left) + score(right) - score(whole)
        ok = usable & (left[..., 1] >= least[of][:, None]) & (right[..., 1] >= least[of][:, None])
        gain = np.where(ok, gain, -np.inf)
        at = gain.argmax(axis=1)
        one = np.arange(len(hist))
        return gain[one, at], at, left[one, at], whole[:, 0]

    ensemble: list[_Trees] = []
    for _ in range(trees):
        sums, tree = passes(ensemble), _Trees(len(fit), shape.nodes)

        def histograms(want: list[tuple[int, int]], tree=tree, sums=sums) -> np.ndarray:
            """Of the wanted nodes, which are in order of their models."""
            begin = np.searchsorted([m for m, _ in want], np.arange(len(fit) + 1))
            slot = np.full((len(fit), shape.nodes), -1, dtype=np.int64)
            for i, (m, node) in enumerate(want):
                slot[m, node] = i - begin[m]
            return _completed(sums(tree, slot, begin), first, shape.usual)

        # Open leaves of each model by node: histogram, gain, cut, left sums, own sums, depth.
        leaves: list[dict[int, tuple]] = [{} for _ in fit]
        used, size = np.ones(len(fit), dtype=int), np.ones(len(fit), dtype=int)

        def opened(places: list[tuple[int, int]], hist: np.ndarray, depth: list[int], tree=tree, leaves=leaves) -> None:
            of = np.array([m for m, _ in places])
            for place, *found, d in zip(places, hist, *best(hist, of), depth):
                leaves[place[0]][place[1]] = (*found, d)
                g, h = found[4]
                tree.value[place] = -rate[place[0]] * g / max(h + l2[place[0]], 1e-300)

        roots = [(m, 0) for m in range(len(fit))]
        opened(roots, histograms(roots), [0] * len(fit))
        while True:
            chosen = []
            for m in range(len(fit)):
                may = [(v[1], -node) for node, v in leaves[m].items() if v[1] > 1e-12 and v[5] < deepest[m]]
                chosen += [(m, -node) for _, node in sorted(may, reverse=True)[: budget[m] - used[m]]]
            if not chosen:
                break
            lefts, parents = [], []
            for m, node in chosen:
                hist, _, cut, left, whole, depth = leaves[m].pop(node)
                a, b = int(size[m]), int(size[m]) + 1
                size[m], used[m] = size[m] + 2, used[m] + 1
                tree.feature[m, node], tree.cut[m, node] = feature_of[cut], cut - first[feature_of[cut]]
                tree.left[m, node], tree.right[m, node], tree.depth = a, b, max(tree.depth, depth + 1)
                for child, (g, h) in ((a, left), (b, whole - left)):
                    tree.value[m, child] = -rate[m] * g / max(h + l2[m], 1e-300)
                lefts.append((m, a))
                parents.append((hist, depth + 1))
            # Children need sums only where their tree may still grow.
            more = [i for i, (m, _) in enumerate(lefts) if used[m] < budget[m] and parents[i][1] < deepest[m]]
            if not more:
                break
            places = [lefts[i] for i in more]
            hist = histograms(places)
            rest = np.stack([parents[i][0] for i in more]) - hist
            depth = [parents[i][1] for i in more]
            opened(places, hist, depth)
            opened([(m, node + 1) for m, node in places], rest, depth)
        ensemble.append(tree)
    return ensemble


class _OwnRows:
    """All distinct rows for one model, with the node of the growing tree that each is in."""

    def __init__(self, bins: np.ndarray, n: np.ndarray, s: np.ndarray, start: float, shape: _Shape):
        self.bins, self.n, self.s, self.shape, self.p = bins, n, s, shape, np.full(len(n), start)
        self.trained = np.flatnonzero(n > 0)
        row, feature = np.nonzero(bins[self.trained] != shape.usual)
        self.row, self.place = self.trained[row], bins[self.trained[row], feature] + shape.first[feature]
        self.at, self.begin = np.zeros(len(n), dtype=np.int64), np.arange(len(n)) * bins.shape[1]

    def down(self, tree: _Trees) -> None:
        """One step: rows of nodes that were split go to a child, those of a leaf stay."""
        goes = self.bins.ravel().take(self.begin + tree.feature[0].take(self.at)) <= tree.cut[0].take(self.at)
        self.at = np.where(goes, tree.left[0].take(self.at), tree.right[0].take(self.at)).astype(np.int64)

    def after(self, tree: _Trees) -> None:
        """Predictions with the tree whose last splits are not yet gone down."""
        self.down(tree)
        self.p += tree.value[0].take(self.at)
        self.at = np.zeros(len(self.n), dtype=np.int64)

    def passes(self, ensemble: list[_Trees]) -> Callable:
        if ensemble:
            self.after(ensemble[-1])
        weights, total = (self.n * self.p - self.s, self.n), self.shape.total

        def sums(tree: _Trees, slot: np.ndarray, begin: np.ndarray) -> np.ndarray:
            self.down(tree)
            out, mine = np.empty((begin[-1], total + 1, 2)), slot[0].take(self.at)
            of = mine.take(self.row)
            cells = np.flatnonzero(of >= 0)
            cell, on = of[cells] * (total + 1) + self.place[cells], self.row[cells]
            rows = self.trained[mine[self.trained] >= 0]
            for k, weight in enumerate(weights):
                out[:, :, k] = np.bincount(cell, weights=weight[on], minlength=out[:, :, k].size).reshape(begin[-1], -1)
                out[:, total, k] += np.bincount(mine[rows], weights=weight[rows], minlength=begin[-1])
            return out

        return sums


def _grown_alone(packed: DataFrame, fits: int, start: np.ndarray, shape: _Shape, trees: int) -> DataFrame:
    """(features, p): a task a model, which reads all distinct rows."""

    def grow(rows: Iterator) -> Iterator[tuple]:
        parts, model = [], 0
        for row in rows:
            model = row["model"]
            parts.append([np.frombuffer(row["bins"], dtype=np.uint8).reshape(row["r"], -1), *(np.frombuffer(row[c]).reshape(-1, fits)[:, shape.fit[model]] for c in ("n", "s"))])
        if parts:
            bins, n, s = map(np.concatenate, zip(*parts))
            mine = _Shape(np.zeros(1, dtype=int), [shape.grown[model]], shape.width, shape.usual)
            own = _OwnRows(bins, n, s, start[model], mine)
            ensemble = _boosted(mine, trees, own.passes)
            if ensemble:
                own.after(ensemble[-1])
            for i in range(0, len(bins), 10_000):
                yield model, [b.tobytes() for b in bins[i : i + 10_000]], own.p[i : i + 10_000].tolist()

    spark, models = packed.sparkSession, len(shape.fit)
    pairs = packed.coalesce(1).hint("shuffle_replicate_nl").crossJoin(spark.range(0, models, 1, models).withColumnRenamed("id", "model"))
    found = spark.createDataFrame(pairs.rdd.mapPartitions(grow), "model long, features array<binary>, z array<double>", verifySchema=False)
    each = written(found.select("model", F.inline(F.arrays_zip("features", "z"))), "model_scores")
    return each.groupBy("features").agg(F.transform(F.array_sort(F.collect_list(F.struct("model", "z"))), lambda m: m["z"]).alias("p"))


def _grown_together(packed: DataFrame, fits: int, start: np.ndarray, shape: _Shape, trees: int) -> DataFrame:
    """(features, p): all models at once, a pass over all rows for every round of splits."""
    source, context = packed.rdd, packed.sparkSession.sparkContext
    parts_of, held = source.getNumPartitions(), []

    def passes(ensemble: list[_Trees]) -> Callable:
        if len(ensemble) % REBUILD_EVERY == 0:
            # Made from the written rows and all trees so far, so the lineage stays short.
            known = context.broadcast((start, list(ensemble)))
            state = source.map(lambda r, known=known: _block(_unpacked(r, fits, *known.value), shape.usual, shape.first))
        else:
            state = held[-1].map(lambda b, last=ensemble[-1]: b.after(last))
        held.append(state.persist(StorageLevel.MEMORY_AND_DISK))

        def sums(tree: _Trees, slot: np.ndarray, begin: np.ndarray) -> np.ndarray:
            parts = state.mapPartitions(lambda b: _histogram(b, tree, slot, begin, shape.fit, shape.total))
            flat = parts_of * begin[-1] * (shape.total + 1) * 16 <= FLAT_REDUCE
            out = parts.reduce(lambda a, b: a + b) if flat else parts.treeReduce(lambda a, b: a + b)
            for old in held[:-1]:
                old.unpersist()
            del held[:-1]
            return out

        return sums

    everything = context.broadcast((start, _boosted(shape, trees, passes)))
    for old in held:
        old.unpersist()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bins, _, _, p = _unpacked(row, fits, *everything.value)
                yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in bins], pa.binary()), pa.array(list(p), pa.list_(pa.float64()))], names=["features", "p"])

    return packed.mapInArrow(predict, "features binary, p array<double>")


def boost(rows: DataFrame, key: str, x: str, n: str, s: str, configs: list[Growth], trees: int = 300, bins: int = 255) -> DataFrame:
    """(key, p): predictions of all models for every row, models ordered by fit, then configuration.

    ``n`` and ``s`` are arrays with each fit's count and target sum of the row; a row of count 0 is not
    trained on, only predicted. ``x`` is an array of numbers, null counting as NaN and so as the greatest;
    rows must have equally long ones. A fit without any count predicts 0. An empty table gives an empty result.
    """
    edges = bin_edges(rows, x, bins)
    kind = rows.schema[key].dataType.simpleString()
    sizes = rows.select(F.size(n).alias("fits")).first()
    if sizes is None or not edges:
        return rows.limit(0).select(F.col(key).cast(kind).alias("key"), F.lit(None).cast("array<double>").alias("p"))
    fits = sizes["fits"]
    cells = written(_cells(rows, key, x, n, s, edges), "binned")
    added = cells.groupBy("features").agg(*[F.array(*[F.sum(F.col(c)[i]) for i in range(fits)]).alias(c) for c in ("n", "s")])
    groups = written(added, "bin_groups")
    # Few rows are read by every task, more are dealt evenly over all.
    alone = groups.count() <= BOOST_ROWS
    packed = written(_packed(groups if alone else groups.repartition(groups.sparkSession.sparkContext.defaultParallelism, "features")), "packed_groups")
    width = np.array([max(1, len(e)) for e in edges])
    first, total = np.concatenate(([0], np.cumsum(width)[:-1])), int(width.sum())
    level = packed.rdd.map(lambda r: _totals(r, fits, first, total)).treeReduce(lambda a, b: tuple(map(np.add, a, b)))
    fit = np.repeat(np.arange(fits), len(configs))
    start = np.where(level[1] > 0, level[0] / np.maximum(level[1], 1e-300), 0.0)[fit]
    usual = np.array([level[2][a : a + w].argmax() for a, w in zip(first, width)], dtype=np.uint8)
    shape = _Shape(fit, [c for _ in range(fits) for c in configs], width, usual)
    predicted = (_grown_alone if alone else _grown_together)(packed, fits, start, shape, trees)
    return cells.select("key", "features").join(predicted, "features").select("key", "p")


# --- bagged forests --------------------------------------------------------------------------------

#: Rows of a node that one task grows further by itself; larger nodes are cut from sums of all tasks.
LOCAL_ROWS = 50_000
#: Distinct rows of a task that are summed before they are passed on, trees whose rows are dealt together, predictions a task remembers.
BAG_GROUPS, DEAL_TREES, KNOWN_ROWS = 8_000, 50, 100_000
#: What is known of a grown node; a leaf has feature -1.
NODE = (("node", "<i8"), ("feature", "<i4"), ("cut", "<i4"), ("mean", "<f8"))
#: Chances of at most 0, 1, 2, ... draws of a row, Poisson of mean 1.
DRAWS = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, k + 1)) for k in range(18)])


@dataclass(frozen=True)
class Bagged:
    """Growth of a forest: ``share`` of the features tried at a node, ``least`` draws in a leaf, levels below the root."""

    share: float
    least: int
    depth: int = 12
    seed: int = 1729


def _uniform(*parts) -> np.ndarray:
    """Numbers in [0, 1) that depend on the given integers (broadcast) alone."""
    h = np.zeros(1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            h = h + np.asarray(p).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return (h >> np.uint64(11)) * 2.0**-53


def _binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e[:-1], values[:, f], side="left") for f, e in enumerate(edges)], axis=1).astype(np.uint8)


def _wide(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def bag(rows: DataFrame, key: str, x: str, n: str, s: str, edges: list[np.ndarray], trees: int, seed: int = 1729) -> DataFrame:
    """(features, draws, n, s): for every distinct row of bins what each tree draws of it.

    A tree takes every row a Poisson number of times that depends on its key, the tree and ``seed`` alone, with
    its count ``n`` and target sum ``s``. Rows of equal bins never part in a tree, so they stand together.
    """
    types = ((np.dtype("<i4"), 0), (np.dtype("<f8"), 1), (np.dtype("<f8"), 2))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[bytes, int] = {}
        sums = [np.zeros((BAG_GROUPS, trees), dtype=d) for d, _ in types]

        def out() -> pa.RecordBatch:
            held = len(groups)
            done = pa.RecordBatch.from_arrays([pa.array(list(groups), pa.binary()), *(pa.array([v.tobytes() for v in a[:held]], pa.binary()) for a in sums)], names=["features", "draws", "n", "s"])
            groups.clear()
            for a in sums:
                a[:held] = 0
            return done

        for batch in batches:
            for start in range(0, len(batch), 2000):
                part = batch.slice(start, 2000)
                keys, count, target = (part.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n", "s"))
                distinct, of = np.unique(_binned(_wide(part.column("x")), edges), axis=0, return_inverse=True)
                drawn = np.searchsorted(DRAWS, _uniform(seed, keys.view(np.uint64)[:, None], np.arange(trees)), side="right").astype(np.int32)
                order = np.argsort(of.ravel(), kind="stable")
                begin = np.searchsorted(of.ravel()[order], np.arange(len(distinct)))
                if len(groups) + len(distinct) > BAG_GROUPS:
                    yield out()
                at = [groups.setdefault(row.tobytes(), len(groups)) for row in distinct]
                for a, v in zip(sums, (drawn, drawn * count[:, None], drawn * target[:, None])):
                    a[at] += np.add.reduceat(v[order], begin, axis=0)
        if groups:
            yield out()

    def add(group: pa.Table) -> pa.Table:
        total = [np.sum([np.frombuffer(v, dtype=d) for v in group.column(i + 1).to_pylist()], axis=0, dtype=d) for d, i in types]
        return pa.table({"features": group.column("features")[:1], **{c: pa.array([v.tobytes()], pa.binary()) for c, v in zip(("draws", "n", "s"), total)}})

    shape = "features binary, draws binary, n binary, s binary"
    inputs = rows.where(F.col(n) > 0).select(F.xxhash64(key).alias("key"), F.col(x).cast("array<double>").alias("x"), F.col(n).cast("double").alias("n"), F.col(s).cast("double").alias("s"))
    return inputs.mapInArrow(draw, shape).groupBy("features").applyInArrow(add, shape)


@dataclass(frozen=True)
class _Layout:
    """Bins of all features side by side."""

    width: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.width)[:-1])).astype(np.int64)

    @property
    def total(self) -> int:
        return int(self.width.sum())


class _Sums:
    """Sums by (node, bin) of some rows; as in boosting only the cells beside each feature's usual bin are read."""

    def __init__(self, bins: np.ndarray, layout: _Layout):
        self.first, self.total = layout.first, layout.total
        self.usual = np.array([np.bincount(b).argmax() for b in bins.T], dtype=np.uint8)
        self.row, feature = np.nonzero(bins != self.usual)
        self.place = bins[self.row, feature] + self.first[feature]

    def of(self, at: np.ndarray, nodes: int, weights: tuple[np.ndarray, ...]) -> np.ndarray:
        """(node, bin, weight) for rows whose node ``at`` is not -1."""
        of, rows = at.take(self.row), np.flatnonzero(at >= 0)
        cells = np.flatnonzero(of >= 0)
        cell, on = of[cells] * self.total + self.place[cells], self.row[cells]
        out = np.empty((nodes, self.total, len(weights)))
        for k, w in enumerate(weights):
            hist = np.bincount(cell, weights=w[on], minlength=nodes * self.total).reshape(nodes, -1)
            whole = np.bincount(at[rows], weights=w[rows], minlength=nodes)
            hist[:, self.first + self.usual] = whole[:, None] - np.add.reduceat(hist, self.first, axis=1)
            out[:, :, k] = hist
        return out


def _cuts(sums: np.ndarray, tree: int, ids: np.ndarray, layout: _Layout, how: Bagged) -> tuple[np.ndarray, ...]:
    """Of each node: feature (-1: none parts it), cut, mean, and rows on the left and in all (last weight)."""
    first, width, features = layout.first, layout.width, len(layout.width)
    feature_of = np.repeat(np.arange(features), width)
    running = np.cumsum(sums, axis=1)
    base = np.where(first[:, None] > 0, running[:, np.maximum(first - 1, 0)], 0)
    left, whole = running - base[:, feature_of], running[:, width[0] - 1]
    right = whole[:, None] - left
    ok = (left[..., 0] >= how.least) & (right[..., 0] >= how.least)
    ok[:, first + width - 1] = False
    tried = int(np.ceil(how.share * features))
    if tried < features:
        chance = _uniform(how.seed, tree, ids[:, None], np.arange(features))
        may = np.zeros(chance.shape, dtype=bool)
        np.put_along_axis(may, np.argpartition(chance, tried - 1, axis=1)[:, :tried], True, axis=1)
        ok &= may[:, feature_of]
    score = lambda a: a[..., 2] ** 2 / np.maximum(a[..., 1], 1e-300)
    own = score(whole)
    # Rounded, so that cuts of equal parts tie however their sums were added, and the first one is taken.
    gain = np.where(ok, np.round((score(left) + score(right) - own[:, None]) / np.maximum(own, 1.0)[:, None], 10), -np.inf)
    one, at = np.arange(len(sums)), gain.argmax(axis=1)
    parts = (gain[one, at] > 0) & (ids < 1 << how.depth)
    return np.where(parts, feature_of[at], -1), at - first[feature_of[at]], whole[:, 2] / np.maximum(whole[:, 1], 1e-300), left[one, at, -1], whole[:, -1]


def _grow(tree: int, root: int, bins: np.ndarray, weights: tuple[np.ndarray, ...], layout: _Layout, how: Bagged) -> tuple[np.ndarray, ...]:
    """Nodes below and with ``root`` (children of i are 2i and 2i+1) from all its rows: ids, features, cuts, means."""
    cells, at, ids, grown = _Sums(bins, layout), np.zeros(len(bins), dtype=np.int64), np.array([root]), []
    while len(ids):
        feature, cut, mean, *_ = _cuts(cells.of(at, len(ids), weights), tree, ids, layout, how)
        grown.append((ids, feature, cut, mean))
        child = np.cumsum(feature >= 0) - 1
        rows = np.flatnonzero(at >= 0)
        node = at[rows]
        goes = bins[rows, np.maximum(feature[node], 0)] > cut[node]
        at[rows] = np.where(feature[node] >= 0, 2 * child[node] + goes, -1)
        parents = ids[feature >= 0]
        ids = np.stack((2 * parents, 2 * parents + 1), axis=1).ravel()
    return tuple(map(np.concatenate, zip(*grown)))


def _routed(bins: np.ndarray, splits: dict[int, tuple[int, int]], depth: int) -> np.ndarray:
    """The node each row reaches by the splits known so far."""
    at = np.ones(len(bins), dtype=np.int64)
    for _ in range(depth if splits else 0):
        for node in set(np.unique(at).tolist()) & splits.keys():
            rows = np.flatnonzero(at == node)
            at[rows] = 2 * node + (bins[rows, splits[node][0]] > splits[node][1])
    return at


class ForestModel:
    """Means of the leaves a row reaches, averaged over the trees."""

    def __init__(self, trees: _Trees, edges: list[np.ndarray], x: str = "x"):
        self.trees, self.edges, self.x = trees, edges, x

    def predict(self, bins: np.ndarray) -> np.ndarray:
        parts = (bins[i : i + 2000] for i in range(0, len(bins), 2000))
        return np.concatenate([np.empty(0), *(self.trees.value.ravel().take(self.trees.leaf(b)).mean(axis=1) for b in parts)])

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the prediction ``p``; a task predicts rows of equal bins once."""
        shared, edges = rows.sparkSession.sparkContext.broadcast(self), self.edges

        def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known: dict[bytes, float] = {}
            for values in batches:
                bins = _binned(np.stack(values.to_numpy()).astype(np.float64), edges) if len(values) else np.empty((0, len(edges)), dtype=np.uint8)
                keys = [b.tobytes() for b in bins]
                if len(known) > KNOWN_ROWS:
                    known.clear()
                new = {k: i for i, k in enumerate(keys) if k not in known}
                known.update(zip(new, shared.value.predict(bins[list(new.values())]).tolist()))
                yield pd.Series([known[k] for k in keys], dtype="float64")

        return rows.withColumn("p", F.pandas_udf(predicted, "double")(F.col(self.x)))


def forest(bagged: DataFrame, edges: list[np.ndarray], how: Bagged, trees: int) -> ForestModel:
    """All trees of a forest from the rows of ``bag``, grown together.

    Nodes of more than ``LOCAL_ROWS`` rows are cut level by level from sums that the tasks make and one task a
    tree adds up; the rows of a smaller node are then brought together once and one task grows all below it.
    The driver sees the trees only.
    """
    layout = _Layout(np.array([max(1, len(e)) for e in edges]))
    splits: list[dict[int, tuple[int, int]]] = [{} for _ in range(trees)]
    found: list[dict[int, tuple]] = [{} for _ in range(trees)]
    context, width = bagged.sparkSession.sparkContext, len(edges)

    def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        wide = lambda c, d: np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=d).reshape(len(batch), -1)
        return wide("features", np.uint8), (wide("draws", "<i4"), wide("n", "<f8"), wide("s", "<f8"))

    def large(open_: list[list[int]]) -> list:
        """Cuts of the open nodes of every tree."""
        known = context.broadcast((splits, open_))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            splits, open_ = known.value
            for batch in batches:
                if not len(batch):
                    continue
                bins, weights = unpacked(batch)
                cells = _Sums(bins, layout)
                for tree, ids in enumerate(open_):
                    if ids:
                        number = np.full(2 << how.depth, -1)
                        number[ids] = np.arange(len(ids))
                        mine = [w[:, tree] for w in weights]
                        drawn = mine[0] > 0
                        at = np.where(drawn, number[_routed(bins, splits[tree], how.depth)], -1)
                        yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([cells.of(at, len(ids), (*mine, drawn.astype(float))).tobytes()], pa.binary())], names=["tree", "sums"])

        def cut(group: pa.Table) -> pa.Table:
            tree = group.column("tree")[0].as_py()
            ids = np.array(known.value[1][tree])
            total = np.zeros(len(ids) * layout.total * 4)
            for v in group.column("sums").to_pylist():
                total += np.frombuffer(v)
            feature, at, mean, left, rows = _cuts(total.reshape(len(ids), layout.total, 4), tree, ids, layout, how)
            return pa.table({"tree": pa.array([tree] * len(ids), pa.int32()), "node": ids, "feature": feature, "cut": at, "mean": mean, "left": left, "rows": rows})

        shape = "tree int, node long, feature long, cut long, mean double, left double, rows double"
        return bagged.mapInArrow(sums, "tree int, sums binary").groupBy("tree").applyInArrow(cut, shape).collect()

    sizes = bagged.count()
    open_ = [[1] if sizes > LOCAL_ROWS else [] for _ in range(trees)]
    while any(open_):
        cuts, open_ = large(open_), [[] for _ in range(trees)]
        for r in cuts:
            # A node that came out small is cut again with all below it, by one task.
            if r["rows"] > LOCAL_ROWS or r["feature"] < 0:
                found[r["tree"]][r["node"]] = (r["feature"], r["cut"], r["mean"])
                if r["feature"] >= 0:
                    splits[r["tree"]][r["node"]] = (r["feature"], r["cut"])
                    open_[r["tree"]] += [2 * r["node"] + k for k, rows in enumerate((r["left"], r["rows"] - r["left"])) if rows > LOCAL_ROWS]
        open_ = [sorted(ids) for ids in open_]
    known = context.broadcast((splits, [{i for i, v in f.items() if v[0] < 0} for f in found]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits, done = known.value
        for batch in batches:
            for start in range(0, len(batch), 2000):
                bins, weights = unpacked(batch.slice(start, 2000))
                for begin in range(0, trees, DEAL_TREES):
                    out = []
                    for tree in range(begin, min(trees, begin + DEAL_TREES)):
                        drawn = np.flatnonzero(weights[0][:, tree])
                        at = _routed(bins[drawn], splits[tree], how.depth)
                        for node in np.unique(at).tolist():
                            rows = drawn[at == node]
                            if node not in done[tree]:
                                out.append((tree, node, bins[rows].tobytes(), *(w[rows, tree].tobytes() for w in weights)))
                    if out:
                        types = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
                        yield pa.RecordBatch.from_arrays([pa.array(c, d) for c, d in zip(zip(*out), types)], names=["tree", "node", "features", "draws", "n", "s"])

    def grow(group: pa.Table) -> pa.Table:
        tree, root = (group.column(c)[0].as_py() for c in ("tree", "node"))
        flat = lambda c, d: np.frombuffer(b"".join(group.column(c).to_pylist()), dtype=d)
        bins = flat("features", np.uint8).reshape(-1, width)
        # In one order however they came, so that sums are the same in every run.
        order = np.lexsort(bins.T)
        weights = tuple(flat(c, d)[order].astype(float) for c, d in (("draws", "<i4"), ("n", "<f8"), ("s", "<f8")))
        grown = _grow(tree, root, bins[order], weights, layout, how)
        return pa.table({"tree": pa.array([tree], pa.int32()), **{c: pa.array([v.astype(d).tobytes()], pa.binary()) for (c, d), v in zip(NODE, grown)}})

    dealt = bagged.mapInArrow(deal, "tree int, node long, features binary, draws binary, n binary, s binary")
    grown: list[list[tuple]] = [[tuple(map(np.array, zip(*((i, *v) for i, v in f.items()))))] if f else [] for f in found]
    for r in dealt.groupBy("tree", "node").applyInArrow(grow, "tree int, " + ", ".join(f"{c} binary" for c, _ in NODE)).collect():
        grown[r["tree"]].append(tuple(np.frombuffer(r[c], dtype=d) for c, d in NODE))

    model = _Trees(trees, max(1, *(sum(len(part[0]) for part in parts) for parts in grown)))
    model.depth = how.depth
    for tree, parts in enumerate(grown):
        if parts:
            ids, feature, cut, mean = map(np.concatenate, zip(*parts))
            order = np.argsort(ids)
            ids, feature, cut = ids[order], feature[order], cut[order]
            model.value[tree, : len(ids)] = mean[order]
            at = np.flatnonzero(feature >= 0)
            model.feature[tree, at], model.cut[tree, at] = feature[at], cut[at]
            model.left[tree, at], model.right[tree, at] = np.searchsorted(ids, 2 * ids[at]), np.searchsorted(ids, 2 * ids[at] + 1)
    return ForestModel(model, edges)
