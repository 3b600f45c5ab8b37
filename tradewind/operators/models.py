"""Regressors fitted from Gram statistics, squared-insensitive SVR, tree presets, residual correction.

Solving happens inside tasks, one group (fold, condition, market) per task, on d x d matrices. Only
the SVR iterates on the driver, which gets one d x d matrix from Spark per step.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import gram as G
from . import trees as T

# The hyper-parameter grids of the linear and tree families.
GRID: dict[str, list[dict]] = {
    "ols": [{}],
    "ridge": [{"alpha": 10.0**e} for e in range(-2, 7)],
    "elasticnet": [{"alpha": a, "l1_ratio": r} for a in (0.001, 0.01, 0.1, 1.0, 10.0) for r in (0.1, 0.5, 0.9)],
    "pls": [{"components": k} for k in (8, 16, 32, 64)],
    "svr": [{"C": c, "epsilon": e} for c in (0.01, 0.1, 1.0) for e in (0.1, 0.2)],
}
BOOSTED = [{"learning_rate": r, "max_leaf_nodes": m, "l2": g} for r in (0.05, 0.1) for m in (15, 31) for g in (1, 10)]
FOREST = [{"max_features": f, "min_samples_leaf": m} for f in (0.5, 1.0) for m in (1, 5, 20)]
TREE_GRID = {"hist_gradient": BOOSTED, "xgb_like": BOOSTED, "lgbm_like": BOOSTED, "forest": FOREST}
TREES = 300
RESIDUAL_ALPHAS = [0.0, 1e2, 1e3, 1e4, 1e5, 1e6]


# --- solvers on centred moments -----------------------------------------------------------------

def _min_norm(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(a)
    keep = values > max(values.max(), 0.0) * len(values) * np.finfo(float).eps
    return vectors[:, keep] @ ((vectors[:, keep].T @ b) / values[keep])


def solve_ridge(m: dict, alpha: float) -> np.ndarray:
    return np.linalg.solve(m["sxx"] + alpha * np.eye(len(m["sxy"])), m["sxy"])


def solve_elasticnet(m: dict, alpha: float, l1_ratio: float, tol: float = 1e-10, max_iter: int = 20_000) -> tuple[np.ndarray, bool]:
    """Coordinate descent on SSE/(2n) + alpha*(l1*|b| + (1-l1)/2*b'b), using moments only."""
    s, left = m["sxx"] / m["n"], m["sxy"] / m["n"]
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    own = s.diagonal().tolist()
    usable = [j for j, v in enumerate(own) if v > 0]
    beta = np.zeros(len(left))
    for _ in range(max_iter):
        widest = 0.0
        for j in usable:
            old = float(beta[j])
            pull = float(left[j]) + own[j] * old
            new = (pull - l1 if pull > l1 else pull + l1 if pull < -l1 else 0.0) / (own[j] + l2)
            if new != old:
                left = left - s[j] * (new - old)
                beta[j] = new
                widest = max(widest, abs(new - old))
        if widest <= tol * max(1.0, float(np.abs(beta).max(initial=0.0))):
            return beta, True
    return beta, False


def solve_pls(m: dict, components: int) -> tuple[np.ndarray, int]:
    """Univariate partial least squares from covariances; returns the coefficients and components found."""
    s, left = m["sxx"], m["sxy"].copy()
    scale = np.linalg.norm(m["sxy"])
    loads, turns, beta = [], [], np.zeros(len(left))
    for _ in range(components):
        size = np.linalg.norm(left)
        if size <= 1e-12 * max(scale, 1e-300):
            break
        turn = left / size
        for p, r in zip(loads, turns):
            turn = turn - (p @ (left / size)) * r
        energy = turn @ s @ turn
        if energy <= 1e-14 * np.trace(s):
            break
        load = s @ turn / energy
        weight = turn @ m["sxy"] / energy
        beta = beta + weight * turn
        left = left - load * weight * energy
        loads.append(load)
        turns.append(turn)
    return beta, len(turns)


def solve(m: dict, family: str, config: dict) -> tuple[np.ndarray, bool, str]:
    """Coefficients, validity and the reason for an invalid fit."""
    ok, why = True, ""
    if family == "ols":
        beta = _min_norm(m["sxx"], m["sxy"])
    elif family == "ridge":
        beta = solve_ridge(m, config["alpha"])
    elif family == "elasticnet":
        beta, ok = solve_elasticnet(m, config["alpha"], config["l1_ratio"])
        why = "" if ok else "not converged"
    elif family == "pls":
        beta, found = solve_pls(m, config["components"])
        ok = found == config["components"]
        why = "" if ok else f"{found} of {config['components']} components"
    else:
        raise ValueError(f"unknown family {family!r}")
    if not np.isfinite(beta).all():
        ok, why = False, "not finite"
    return beta, ok, why


FIT_FIELDS = "family string, config_index bigint, config string, n double, coef array<double>, intercept double, valid boolean, reason string"


def fit_grid(grams: DataFrame, by: list[str], grid: list[tuple[str, int, dict]]) -> DataFrame:
    """Every configuration of the grid for every group, solved from the group's one Gram."""
    types = {f.name: f.dataType for f in grams.schema.fields}
    ddl = ", ".join([*(f"{c} {types[c].simpleString()}" for c in by), FIT_FIELDS])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = G.unpack(pdf)
        mine = pdf["_family"].iloc[0]
        rows = []
        for family, index, config in grid:
            if family != mine:
                continue
            beta, ok, why = solve(m, family, config)
            rows.append({
                **{c: pdf[c].iloc[0] for c in by}, "family": family, "config_index": index, "config": json.dumps(config, sort_keys=True), "n": m["n"],
                "coef": beta.tolist(), "intercept": float(m["my"] - m["mx"] @ beta), "valid": bool(ok), "reason": why,
            })
        return pd.DataFrame(rows)

    # Grams are small and solving is not: one task per (group, family), not one per megabyte.
    families = sorted({f for f, _, _ in grid})
    keyed = grams.withColumn("_family", F.explode(F.array(*[F.lit(f) for f in families])))
    tasks = grams.sparkSession.sparkContext.defaultParallelism
    return keyed.repartition(tasks, *by, "_family").groupBy(*by, "_family").applyInPandas(run, ddl)


def fit_choices(grams: DataFrame, choices: DataFrame, by: list[str]) -> DataFrame:
    """One fit per row of ``choices`` (by, candidate, family, config as JSON, columns), from the group's Gram cut to those columns.

    Returns by, candidate, coef (as wide as the Gram, zero where a column is not used), intercept, valid
    and reason. A choice whose group has no Gram, and an empty table, give no row.
    """
    types = {f.name: f.dataType for f in grams.schema.fields}
    ddl = ", ".join([*(f"{c} {types[c].simpleString()}" for c in by), "candidate bigint, coef array<double>, intercept double, valid boolean, reason string"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, first = G.unpack(pdf), pdf.iloc[0]
        use = np.array(first["columns"], dtype=int)
        beta, ok, why = solve({**m, "sxx": m["sxx"][np.ix_(use, use)], "sxy": m["sxy"][use]}, first["family"], json.loads(first["config"]))
        coef = np.zeros(len(m["sxy"]))
        coef[use] = beta
        row = {"candidate": first["candidate"], "coef": coef.tolist(), "intercept": float(m["my"] - m["mx"] @ coef), "valid": bool(ok), "reason": why}
        return pd.DataFrame([{**{c: first[c] for c in by}, **row}])

    wanted = choices.select(*by, "candidate", "family", "config", "columns")
    return grams.join(wanted, by).groupBy(*by, "candidate").applyInPandas(run, ddl)


def grid(*families: str) -> list[tuple[str, int, dict]]:
    return [(f, i, c) for f in families for i, c in enumerate(GRID[f])]


def dot(x: str, coef: str):
    return F.aggregate(F.zip_with(x, coef, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def predict(vectors: DataFrame, fits: DataFrame, by: list[str], x: str = "x") -> DataFrame:
    """Linear predictions per (vector row, fit): entities are scored once, trades joined later.

    With ``by`` the fits meet vectors of the same group. Without, the fit table (one row per
    configuration, so bounded by the grid) is nested into every vector row.
    """
    cols = ["family", "config_index", "coef", "intercept"]
    if by:
        j = vectors.join(fits.select(*by, *cols), by)
    else:
        nested = fits.agg(F.collect_list(F.struct(*cols)).alias("_fits"))
        j = vectors.join(F.broadcast(nested)).withColumn("_f", F.explode("_fits"))
        j = j.select(*vectors.columns, "_f.*")
    return j.withColumn("p", dot(x, "coef") + F.col("intercept")).drop("coef", "intercept")


# --- squared epsilon-insensitive linear SVR ------------------------------------------------------

def svr_cells(rows: DataFrame, vectors: DataFrame, entity: str, y: str) -> DataFrame:
    """(x, y, k): each distinct target of each entity with the entity's vector and its count.

    Written once; every step of every configuration reads it, so rows and vectors meet in one join.
    """
    counted = rows.groupBy(entity, F.col(y).cast("double").alias("_y")).agg(F.count(F.lit(1)).cast("double").alias("k"))
    joined = vectors.select(entity, F.col("x").cast("array<double>").alias("x")).join(counted, entity)
    return written(joined.select("x", F.col("_y").alias("y"), "k"), "svr-cells")


def svr_sums(cells: DataFrame, points: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One pass: the squared loss at every point (rows, intercept last), and for the first point the
    sums of residual x feature and the Gram of the rows outside the tube.

    A batch meets all points in one matrix product. Tasks send one (d + 1)-square matrix each, summed
    row by row; what reaches the driver is one such matrix.
    """
    width = points.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, pull, loss = np.zeros((width, width)), np.zeros(width), np.zeros(len(points))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            z = np.column_stack([x, np.ones(batch.num_rows)])
            k = batch.column("k").to_numpy()
            raw = z @ points.T - batch.column("y").to_numpy()[:, None]
            outside = np.sign(raw) * np.maximum(np.abs(raw) - epsilon, 0.0)
            loss += k @ (outside * outside)
            pull += z.T @ (k * outside[:, 0])
            gram += (z * (k * (np.abs(raw[:, 0]) > epsilon))[:, None]).T @ z
        rows = [*np.column_stack([gram, pull]), loss]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["i", "v"])

    parts = cells.select("x", "y", "k").mapInArrow(partial, "i int, v array<double>")
    total = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).orderBy("i").collect()
    if not total:
        return np.zeros(len(points)), np.zeros(width), np.zeros((width, width))
    matrix = np.array([r["v"] for r in total[:-1]])
    return np.array(total[-1]["v"]), matrix[:, -1], matrix[:, :-1]


def _certificate(beta: np.ndarray, C: float, sums: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict:
    loss, pull, gram = sums
    gradient = beta + 2 * C * pull
    norm = float(np.linalg.norm(gradient))
    return dict(objective=0.5 * float(beta @ beta) + C * float(loss[0]), gradient=gradient, gradient_norm=norm, gap_bound=norm * norm / 2, hessian=2 * C * gram + np.eye(len(beta)))


def svr_certificate(rows: DataFrame, vectors: DataFrame, entity: str, y: str, beta: np.ndarray, C: float, epsilon: float) -> dict:
    """Objective 0.5 b'b + C sum(residual^2) at ``beta``, intercept regularised, with gradient and Hessian.

    The problem is 1-strongly convex, so half the squared gradient norm bounds the objective's gap.
    """
    return _certificate(beta, C, svr_sums(svr_cells(rows, vectors, entity, y), beta[None, :], epsilon))


def fit_svr(
    rows: DataFrame, vectors: DataFrame, entity: str, y: str, dims: int, C: float, epsilon: float, tol: float = 1e-6, max_iter: int = 5000, halvings: int = 50, cells: DataFrame | None = None
) -> dict:
    """Newton steps until the gradient certificate holds.

    The pass that tries a full step also returns the certificate there and the objective at the next
    three halvings, so a step costs one job unless it must be shortened. A fit without an acceptable
    step among ``halvings`` or beyond ``max_iter`` comes back as not valid.
    """
    cells = svr_cells(rows, vectors, entity, y) if cells is None else cells
    beta = np.zeros(dims + 1)
    at = _certificate(beta, C, svr_sums(cells, beta[None, :], epsilon))
    history = [(at["objective"], at["gradient_norm"])]
    while at["gradient_norm"] > tol and len(history) <= max_iter:
        move = -np.linalg.solve(at["hessian"], at["gradient"])
        fall, slack = float(at["gradient"] @ move), 1e-12 * max(1.0, abs(at["objective"]))
        taken = None
        for first in range(0, halvings, 4):
            lengths = 0.5 ** np.arange(first, min(first + 4, halvings))
            points = beta + lengths[:, None] * move
            sums = svr_sums(cells, points, epsilon)
            values = 0.5 * (points * points).sum(axis=1) + C * sums[0]
            good = np.flatnonzero(values <= at["objective"] + 1e-4 * lengths * fall + slack)
            if len(good):
                taken = points[good[0]]
                after = _certificate(taken, C, sums if good[0] == 0 else svr_sums(cells, taken[None, :], epsilon))
                break
        if taken is None or np.array_equal(taken, beta):
            break
        beta, at = taken, after
        history.append((at["objective"], at["gradient_norm"]))
    return dict(beta=beta, valid=at["gradient_norm"] <= tol, iterations=len(history) - 1, **at, history=history)


# --- trees ---------------------------------------------------------------------------------------

def tree_settings(family: str, config: dict, trees: int = TREES) -> dict:
    """Spark ML settings playing the role of a tree configuration.

    Spark grows by depth, not by leaves: 15 and 31 leaves become depths 4 and 5. It has no L2 on leaf
    values: the stronger penalty becomes a minimum of ten rows per leaf. Same role, other numbers.
    """
    depth = int(np.log2(config["max_leaf_nodes"] + 1))
    extra = {"maxBins": 255} if family != "hist_gradient" else {}
    return {"maxIter": trees, "stepSize": config["learning_rate"], "maxDepth": depth, "minInstancesPerNode": config["l2"], **extra}


def fit_tree(train: DataFrame, family: str, config: dict, features: str = "features", label: str = "z", weight: str | None = None, seed: int = 1729, trees: int = TREES, edges: list[np.ndarray] | None = None):
    """Gradient-boosted trees from Spark ML, or a forest from the rows of ``trees.bag`` (and their bins' ``edges``), for one configuration."""
    if family == "forest":
        return T.forest(train, edges, T.Bagged(config["max_features"], config["min_samples_leaf"], seed=seed), trees)
    from pyspark.ml.regression import GBTRegressor

    model = GBTRegressor(featuresCol=features, labelCol=label, predictionCol="p", seed=seed, **tree_settings(family, config, trees))
    return (model.setWeightCol(weight) if weight else model).fit(train)


# --- residual correction -------------------------------------------------------------------------

def residual_grid(train_grams: DataFrame, by: list[str], alphas: list[float] = RESIDUAL_ALPHAS) -> DataFrame:
    """Ridge fits of past-only residuals for each alpha; alpha 0 means no correction at all."""
    fits = fit_grid(train_grams, by, [("ridge", i, {"alpha": a}) for i, a in enumerate(alphas) if a > 0])
    none = fits.filter(F.col("config_index") == 1).select(
        *[
            F.lit(0).cast("bigint").alias(c) if c == "config_index" else F.lit('{"alpha": 0.0}').alias(c) if c == "config"
            else F.transform("coef", lambda _: F.lit(0.0)).alias(c) if c == "coef" else F.lit(0.0).alias(c) if c == "intercept" else F.col(c)
            for c in fits.columns
        ]
    )
    return fits.unionByName(none)
