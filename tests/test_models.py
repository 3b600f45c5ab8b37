import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.operators import features as X
from tradewind.operators import gram as G
from tradewind.operators import models as L
from tradewind.operators.features import MAD_SCALE, robust_parameters
from tradewind.functions.scalars import robust_asinh, robust_sinh

RNG = np.random.default_rng(11)
XS = RNG.normal(size=(60, 5))
TOKEN = RNG.integers(0, 60, 400)
Y = XS[TOKEN] @ np.array([0.5, -1.0, 0.0, 0.3, 0.0]) + RNG.normal(size=400) * 0.3


def rows_and_vectors(spark):
    rows = spark.createDataFrame([(int(k), float(v)) for k, v in zip(TOKEN, Y)], "entity bigint, y double")
    vec = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(XS)], "entity bigint, x array<double>")
    return rows, vec


@pytest.fixture(scope="module")
def fits(spark):
    rows, vec = rows_and_vectors(spark)
    grams = G.accumulate(G.entity_targets(rows, [], "entity", "y").join(vec, "entity"), [])
    got = L.fit_grid(grams, [], [*L.grid("ols", "ridge", "elasticnet"), ("pls", 1, {"components": 1}), ("pls", 5, {"components": 5}), ("pls", 6, {"components": 6})])
    return {(r["family"], r["config_index"]): r for r in got.collect()}


def centred():
    x = XS[TOKEN]
    return x - x.mean(axis=0), Y - Y.mean()


def test_ols_and_ridge_closed_form(fits):
    x, y = centred()
    assert np.allclose(fits[("ols", 0)]["coef"], np.linalg.lstsq(x, y, rcond=None)[0])
    for i, c in enumerate(L.GRID["ridge"]):
        assert np.allclose(fits[("ridge", i)]["coef"], np.linalg.solve(x.T @ x + c["alpha"] * np.eye(5), x.T @ y))


def test_elasticnet_optimality(fits):
    x, y = centred()
    for i, c in enumerate(L.GRID["elasticnet"]):
        b = np.array(fits[("elasticnet", i)]["coef"])
        g = x.T @ (y - x @ b) / len(y) - c["alpha"] * (1 - c["l1_ratio"]) * b
        l1 = c["alpha"] * c["l1_ratio"]
        assert np.all(np.abs(g[b == 0]) <= l1 + 1e-8) and np.allclose(g[b != 0], l1 * np.sign(b[b != 0]), atol=1e-8)


def test_pls_components(fits):
    x, y = centred()
    w = x.T @ y / np.linalg.norm(x.T @ y)
    assert np.allclose(fits[("pls", 1)]["coef"], w * (w @ x.T @ y) / (w @ x.T @ x @ w))
    assert np.allclose(fits[("pls", 5)]["coef"], fits[("ols", 0)]["coef"])
    assert fits[("pls", 5)]["valid"] and not fits[("pls", 6)]["valid"]


@pytest.mark.parametrize("C,epsilon", [(0.1, 0.1), (1.0, 0.2)])
def test_svr_reaches_its_certificate(spark, C, epsilon):
    rows, vec = rows_and_vectors(spark)
    got = L.fit_svr(rows.cache(), vec.cache(), "entity", "y", 5, C, epsilon)
    z = np.column_stack([XS[TOKEN], np.ones(len(Y))])
    raw = z @ got["beta"] - Y
    res = np.sign(raw) * np.maximum(np.abs(raw) - epsilon, 0)
    assert got["valid"] and np.linalg.norm(got["beta"] + 2 * C * z.T @ res) <= 2e-6
    assert np.isclose(got["objective"], 0.5 * got["beta"] @ got["beta"] + C * res @ res)


def test_counted_ridge_example(spark):
    """Three features of which one is constant; counted entity sums must equal expanded rows."""
    feats = [[3.0, -2.0, 9.0], [1.5, 0.5, 9.0], [-4.0, 6.0, 9.0], [2.0, 2.0, 9.0]]
    token, y = [0, 1, 1, 1, 2, 2, 3], [1.4, -0.3, 0.7, 0.05, 2.1, -1.6, 0.9]
    vec = spark.createDataFrame(list(enumerate(feats)), "entity bigint, v array<double>")
    rows = spark.createDataFrame(list(zip(token, y)), "entity bigint, y double")
    counts = rows.groupBy("entity").agg(F.count("*").alias("w"))
    z = X.standardize_block(vec, "v", X.block_moments(vec.join(counts, "entity"), "v", "w")).select("entity", "x")
    assert len(z.first()["x"]) == 2
    fit = L.fit_grid(G.accumulate(G.entity_targets(rows, [], "entity", "y").join(z, "entity"), []), [], [("ridge", 0, {"alpha": 3.5})]).first()
    e = np.array([feats[i] for i in token])[:, :2]
    e = (e - e.mean(axis=0)) / e.std(axis=0)
    yc = np.array(y) - np.mean(y)
    assert np.allclose(fit["coef"], np.linalg.solve(e.T @ e + 3.5 * np.eye(2), e.T @ yc), atol=1e-12)
    p = e @ np.array(fit["coef"]) + fit["intercept"]
    within = sum(((np.array(y)[np.array(token) == k] - np.array(y)[np.array(token) == k].mean()) ** 2).sum() for k in set(token))
    between = sum((np.array(token) == k).sum() * (np.array(y)[np.array(token) == k].mean() - p[np.array(token) == k][0]) ** 2 for k in set(token))
    assert np.isclose(((np.array(y) - p) ** 2).sum(), within + between, atol=1e-12)


def test_robust_asinh_example(spark):
    train = [3.5, -2.25, 0.4, 0.9, -0.7, 1.3, -1.1]
    df = spark.createDataFrame([("m", v) for v in train], "market string, y double")
    par = robust_parameters(df, ["market"], "y").first()
    med = np.median(train)
    assert np.isclose(par["center"], med) and np.isclose(par["scale"], np.median(np.abs(np.array(train) - med)) / MAD_SCALE)
    probe = spark.createDataFrame([(v,) for v in (-30.0, -2.25, 0.3, 4.0, 41.0)], "y double")
    c, s = F.lit(par["center"]), F.lit(par["scale"])
    back = probe.select("y", robust_sinh(robust_asinh(F.col("y"), c, s), c, s).alias("b")).collect()
    assert all(np.isclose(r["y"], r["b"], rtol=1e-11) for r in back)


def test_constant_target_is_an_error(spark):
    df = spark.createDataFrame([("m", 1.0)] * 5, "market string, y double")
    with pytest.raises(Exception, match="target scale is zero"):
        robust_parameters(df, ["market"], "y").collect()


def tokens(spark, rows):
    return spark.createDataFrame(rows, "entity bigint, color string, hat string").withColumn("tokens", X.trait_tokens(["color", "hat"]))


def test_tfidf_example(spark):
    base = [(1, "gold", "crown"), (2, "teal", "crown"), (3, "gold", "veil"), (4, "gold", "crown")]
    idf = {r["feature"]: r["idf"] for r in X.idf_table(tokens(spark, base), "entity", "tokens").collect()}
    want = dict(zip(["color=teal", "color=gold", "hat=crown", "hat=veil"], np.log(5 / np.array([2, 4, 4, 2])) + 1))
    assert {k: round(v, 12) for k, v in idf.items()} == {k: round(float(v), 12) for k, v in want.items()}
    repeated = {r["feature"]: r["idf"] for r in X.idf_table(tokens(spark, base + [base[0]] * 4), "entity", "tokens").collect()}
    assert repeated == idf
    rows = X.tf_idf(tokens(spark, base), tokens(spark, base + [(9, "green", "cap")]), "entity", "tokens")
    got = {r["entity"]: r["s"] for r in rows.groupBy("entity").agg(F.sum(F.col("value") ** 2).alias("s")).collect()}
    assert 9 not in got and all(abs(v - 1) < 1e-12 for v in got.values())


def test_unseen_category_leaves_vocabulary_alone(spark):
    train = tokens(spark, [(i, c, "h") for i, c in enumerate("abab")])
    sparse = X.one_hot(train, tokens(spark, [(7, "new", "h")]), "entity", "tokens")
    assert [(r["feature"]) for r in sparse.collect()] == ["hat=h"]
    weights = train.select("entity", F.lit(1).alias("w"))
    kept = {r["feature"]: r["kept"] for r in X.sparse_moments(X.one_hot(train, train, "entity", "tokens"), weights, "entity", "w").collect()}
    assert kept == {"color=a": True, "color=b": True, "hat=h": False}


def test_projection_matches_svd(spark):
    vec = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(XS)], "entity bigint, x array<double>")
    mean, axes, var = X.fit_projection(vec, "x", 3)
    got = {r["entity"]: r["pc"] for r in X.project(vec, "x", mean, axes, ["entity"]).collect()}
    u, s, vt = np.linalg.svd(XS - XS.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(np.array([got[i] for i in range(60)])), np.abs(u[:, :3] * s[:3])) and np.allclose(var, s[:3] ** 2 / 59)
    assert X.rank_lower_bound(vec, "x") == 5


def test_tree_queries_search_the_whole_grid_on_every_fold(spark, monkeypatch):
    import __spark_entry__ as entry

    name, family, calls = "md9", "forest", []

    class Flat:
        def __init__(self, value):
            self.value = value

        def transform(self, rows):
            return rows.withColumn("p", F.lit(self.value))

    def fit(train, family, config, trees=L.TREES, **_):
        r = train.select("features").first()
        calls.append((family, config, trees, len(r["features"])))
        # One configuration alone predicts the centre; it must win and be the one refitted.
        return Flat(0.0 if config == L.TREE_GRID[family][2] else 3.0)

    monkeypatch.setattr(L, "fit_tree", fit)
    rows = entry.queries()[name](spark, "/root/testdata/sf0.01").collect()
    grid = L.TREE_GRID[family]
    assert sorted(map(str, (c[1] for c in calls[:-1]))) == sorted(map(str, grid * 3)) and calls[-1][1] == grid[2]
    assert all(c[0] == family and c[2] == 300 and c[3] > 2 for c in calls) and {c[3] for c in calls} == {calls[0][3]}
    assert {r["config_index"] for r in rows} == {2} and {r["model"] for r in rows} == {"zero", "tree"}


def test_boosted_query_with_few_trees(spark, monkeypatch):
    from tradewind.plans.models import tree_properties, tree_query
    from tradewind.sources.tables import Tables

    monkeypatch.setitem(L.TREE_GRID, "hist_gradient", L.BOOSTED[:2])
    t = Tables(spark, "/root/testdata/sf0.01")
    rows = tree_query("hist_gradient", 3)(t).collect()
    assert {r["model"] for r in rows} == {"zero", "tree"} and {r["config_index"] for r in rows} <= {0, 1}
    assert [(r["beats_mean"], r["errors_agree"]) for r in tree_properties("hist_gradient", 3)(t).collect()] == [(True, True)] * 2


def plain_boost(x, n, y, rate, l2, least, depth, trees):
    p = np.full(len(y), np.average(y, weights=n))

    def grow(rows, d):
        g, h = (n * (p - y))[rows], n[rows]
        score = lambda m: g[m].sum() ** 2 / (h[m].sum() + l2)
        best = (1e-12, None)
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                left = x[rows, f] <= cut
                if d < depth and h[left].sum() >= least and h[~left].sum() >= least:
                    gain = score(left) + score(~left) - score(np.ones(len(rows), bool))
                    best = max(best, (gain, (f, cut)), key=lambda b: b[0])
        if best[1] is None:
            step[rows] = -rate * g.sum() / (h.sum() + l2)
            return
        left = x[rows, best[1][0]] <= best[1][1]
        grow(rows[left], d + 1)
        grow(rows[~left], d + 1)

    for _ in range(trees):
        step = np.zeros(len(y))
        grow(np.flatnonzero(n > 0), 0)
        p = p + step
    return p


def test_shared_boosting_equals_plain_trees(spark):
    from tradewind.operators import trees as T

    rng = np.random.default_rng(8)
    x, n, y = rng.integers(0, 7, (150, 4)).astype(float), rng.integers(1, 9, (150, 2)).astype(float), rng.normal(size=150)
    rows = spark.createDataFrame([(i, x[i].tolist(), n[i].tolist(), (n[i] * y[i]).tolist()) for i in range(150)], "entity long, x array<double>, n array<double>, s array<double>").repartition(3)
    configs = [T.Growth(0.3, 7, 1.0, 5.0, True), T.Growth(0.1, 4, 10.0, 1.0, True), T.Growth(0.5, 6, 1.0, 2.0)]
    got = {r["key"]: r["p"] for r in T.boost(rows, "entity", "x", "n", "s", configs, trees=12).collect()}
    assert len(got) == 150
    for i in range(2):
        for j, c in enumerate(configs[:2]):
            want = plain_boost(x, n[:, i], y, c.rate, c.l2, c.min_rows, c.depth, 12)
            assert np.allclose([got[k][3 * i + j] for k in range(150)], want, atol=1e-9)
        # Leaf-wise trees keep to their number of leaves: with one tree there are at most six values.
    one = T.boost(rows, "entity", "x", "n", "s", configs, trees=1).collect()
    assert len({round(r["p"][2], 12) for r in one}) == 6
    assert T.boost(rows.limit(0), "entity", "x", "n", "s", configs).count() == 0


def test_models_grown_alone_equal_those_grown_together(spark, monkeypatch):
    from tradewind.operators import trees as T

    rng = np.random.default_rng(12)
    # Few distinct rows, some of no count, one key twice, one null and one feature without a value.
    x, n = rng.integers(0, 3, (400, 4)).astype(float), rng.integers(0, 4, (400, 2)).astype(float)
    s = n * rng.normal(size=(400, 2))
    cells = [(None if i == 7 else i // 2 * 2 if i < 4 else i, [None, *x[i][1:].tolist()] if i == 9 else x[i].tolist(), n[i].tolist(), s[i].tolist()) for i in range(400)]
    rows = spark.createDataFrame(cells, "entity long, x array<double>, n array<double>, s array<double>").repartition(3)
    configs = [T.Growth(0.3, 7, 1.0, 5.0, True), T.Growth(0.5, 9, 1.0, 2.0)]
    of = lambda found: sorted((-1 if r["key"] is None else r["key"], *r["p"]) for r in found.collect())
    jobs, alone = [], T._grown_alone
    monkeypatch.setattr(T, "_grown_alone", lambda packed, *a: (jobs.append(packed), alone(packed, *a))[1])
    got = of(T.boost(rows, "entity", "x", "n", "s", configs, trees=8))
    # No value counts as the greatest.
    distinct = len({(2.0 if c[1][0] is None else c[1][0], *c[1][1:]) for c in cells})
    assert len(jobs) == 1 and sum(r["r"] for r in jobs[0].collect()) == distinct < 100
    monkeypatch.setattr(T, "BOOST_ROWS", 10)
    want = of(T.boost(rows, "entity", "x", "n", "s", configs, trees=8))
    assert len(jobs) == 1 and len(got) == len(want) == 400 and np.allclose(got, want, atol=1e-9)


def test_histograms_read_only_cells_beside_the_usual_bin():
    from tradewind.operators import trees as T

    rng = np.random.default_rng(3)
    hot = np.eye(40)[rng.integers(0, 40, 500)]
    bins = np.column_stack([hot, rng.integers(0, 5, 500)]).astype(np.uint8)
    width = np.array([2] * 40 + [5])
    first, total = np.concatenate(([0], np.cumsum(width)[:-1])), int(width.sum())
    n, s, p = rng.integers(0, 4, (500, 2)).astype(float), rng.normal(size=(500, 2)), rng.normal(size=(500, 3))
    usual, fit = np.array([0] * 40 + [2], dtype=np.uint8), np.array([0, 1, 1])
    block = T._block((bins, n, s, p), usual, first)
    assert len(block.row) == 500 + (bins[:, 40] != 2).sum()
    tree = T._Trees(3, 5)
    tree.feature[:, 0], tree.cut[:, 0], tree.left[:, 0], tree.right[:, 0], tree.depth = 40, 1, 1, 2, 1
    slot, begin = np.full((3, 5), -1), np.array([0, 2, 2, 3])
    slot[0, 1], slot[0, 2], slot[2, 2] = 0, 1, 0
    got = T._completed(next(T._histogram(iter([block]), tree, slot, begin, fit, total)), first, usual)
    for i, (m, low) in enumerate([(0, True), (0, False), (2, False)]):
        on = ((bins[:, 40] <= 1) == low) & (n[:, fit[m]] > 0)
        weights = n[:, fit[m]] * p[:, m] - s[:, fit[m]], n[:, fit[m]]
        for k, w in enumerate(weights):
            want = np.bincount((bins + first)[on].ravel(), weights=np.repeat(w[on], 41), minlength=total)
            assert np.allclose(got[i, :, k], want, atol=1e-9)


def test_residuals_bring_their_masks_along(spark):
    """The cohorts' masks come with the validation rows; the whole targets are not joined again by their row key."""
    from tradewind.plans.models import residual_rows
    from tradewind.sources.tables import Tables

    rows = residual_rows(Tables(spark, "/root/testdata/sf0.01"))
    assert "source_row" not in rows._jdf.queryExecution().optimizedPlan().toString()
    counts = {r["cohort"]: r["count"] for r in rows.groupBy("cohort").count().collect()}
    assert counts["all"] >= counts["no_event"] >= counts["strict"] > 0


def plain_forest(x, n, y, draws, how, trees):
    """Trees grown one node at a time, every cut tried on all rows."""
    from tradewind.operators import trees as T

    p = np.zeros(len(y))
    for tree in range(trees):
        d, w = draws[:, tree], draws[:, tree] * n
        mean = lambda m: (w * y)[m].sum() / w[m].sum()
        score = lambda m: (w * y)[m].sum() ** 2 / w[m].sum()

        def grow(node, seen, drawn):
            tried = np.argsort(T._uniform(how.seed, tree, node, np.arange(x.shape[1])))[: int(np.ceil(how.share * x.shape[1]))]
            best, own = (0.0, None), score(drawn)
            for f in sorted(tried) if node < 1 << how.depth else []:
                for cut in np.unique(x[:, f])[:-1]:
                    low = drawn & (x[:, f] <= cut)
                    high = drawn & ~low
                    if d[low].sum() >= how.least and d[high].sum() >= how.least:
                        gain = np.round((score(low) + score(high) - own) / max(own, 1.0), 10)
                        best = max(best, (gain, (f, cut)), key=lambda b: b[0])
            if best[1] is None:
                p[seen] += mean(drawn) / trees
                return
            low = x[:, best[1][0]] <= best[1][1]
            grow(2 * node, seen & low, drawn & low)
            grow(2 * node + 1, seen & ~low, drawn & ~low)

        grow(1, np.ones(len(y), bool), d > 0)
    return p


@pytest.mark.parametrize("share,least,local", [(1.0, 1, 50_000), (0.5, 5, 50_000), (0.5, 1, 30)])
def test_shared_forest_equals_plain_trees(spark, monkeypatch, share, least, local):
    from tradewind.operators import trees as T

    monkeypatch.setattr(T, "LOCAL_ROWS", local)
    rng = np.random.default_rng(5)
    x, n, y = rng.integers(0, 4, (300, 4)).astype(float), rng.integers(0, 5, 300).astype(float), rng.normal(size=300)
    rows = spark.createDataFrame([(i, x[i].tolist(), float(n[i]), float(n[i] * y[i])) for i in range(300)], "entity long, x array<double>, n double, s double").repartition(3)
    hashes = np.array([r["h"] for r in rows.select("entity", F.xxhash64("entity").alias("h")).orderBy("entity").collect()])
    draws = np.searchsorted(T.DRAWS, T._uniform(1729, hashes.view(np.uint64)[:, None], np.arange(6)), side="right") * (n > 0)[:, None]
    assert abs(draws[n > 0].mean() - 1) < 0.1
    edges, how = T.bin_edges(rows, "x"), T.Bagged(share, least, depth=5)
    bags = T.bag(rows, "entity", "x", "n", "s", edges, 6)
    # Equal rows stand together, with all their draws.
    held = bags.collect()
    assert len(held) == len(np.unique(x[n > 0], axis=0)) and sum(np.frombuffer(r["draws"], dtype="<i4").sum() for r in held) == draws.sum()
    got = {r["entity"]: r["p"] for r in T.forest(bags, edges, how, 6).transform(rows).collect()}
    assert np.allclose([got[i] for i in range(300)], plain_forest(x, n, y, draws, how, 6), atol=1e-9)
