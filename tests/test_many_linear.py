"""Batched linear fits against single fits, kernel maps against exact kernels."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tabsift.operators import kernels as kn
from tabsift.operators import many_linear as many
from tabsift.operators import models as ml
from tabsift.operators.evaluate import roc_auc
from tabsift.operators.split import repeated_stratified_kfold


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(420, 4)) @ rng.normal(size=(4, 4))
    y = (rng.random(420) < 1 / (1 + np.exp(-(x[:, 0] - 0.7 * x[:, 2] - 0.6)))).astype(float)
    df = spark.createDataFrame([(i, float(t), *map(float, r)) for i, (r, t) in enumerate(zip(x, y))], ["id", "target", "a", "b", "c", "d"]).cache()
    return df, x, y


NAMES = ["a", "b", "c", "d"]


def test_grid_equals_single_fits(spark, table):
    """Every point and fold as the engine's own solver finds it, run to the end."""
    df, _, _ = table
    folds = repeated_stratified_kfold(df.select("id", "target"), 3, 2, 1).select("id", "repeat", "fold").cache()
    rows = many.fold_table(ml.assemble(df, NAMES), "features", "target", folds)
    problems = [many.Problem(c, r, k) for c in (0.02, 1.0, 50.0) for r in (0.0, 0.5, 1.0) for k in [(0, 0), (1, 2), None]]
    coef = many.fit_many(rows, problems, 4)
    joined = ml.assemble(df, NAMES).join(folds.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("repeat", "fold"))).alias("f")), "id").cache()
    for p, got in zip(problems, coef):
        part = joined if p.fold is None else joined.where(F.col("f")[F.lit(p.fold[0])] != p.fold[1])
        n = part.count()
        single = LogisticRegression(regParam=1 / (p.strength * n), elasticNetParam=p.l1_ratio, standardization=False, maxIter=2000, tol=1e-13,
                                    labelCol="target", weightCol="weight").fit(ml.class_weights(part, "target"))
        want = [*single.coefficients.toArray(), single.intercept]
        assert got == pytest.approx(want, abs=2e-4 * max(1, np.abs(want).max())), p


def test_grid_search_table(table):
    df, _, _ = table
    folds = repeated_stratified_kfold(df.select("id", "target"), 3, 2, 1).select("id", "repeat", "fold")
    grid = {"penalty": ["l1", "l2"], "C": [0.0001, 1.0], "warm_start": [True, False], "max_iter": [100]}
    model, best, cv = ml.grid_search(df, NAMES, "logistic_regression", grid, folds)
    rows = cv.collect()
    assert len(rows) == 8 and best["C"] == 1.0
    by = {r["params"]: r["mean_score"] for r in rows}
    assert len({round(v, 9) for v in by.values()}) <= 4 and by[str({"penalty": "l1", "C": 0.0001, "warm_start": True, "max_iter": 100})] == 0.5
    pr = ml.predict_scores(model, ml.assemble(df, NAMES), "logistic_regression")
    auc = roc_auc(pr.select(F.lit(0).alias("r"), "id", F.col("target").cast("int").alias("y_true"), "score"), ["r"]).first()["roc_auc"]
    assert auc > 0.75 and pr.select("score_kind").first()[0] == "margin"


def test_separable_and_one_class(spark):
    df = spark.createDataFrame([(i, float(i >= 20), float(i)) for i in range(40)], "id long, target double, a double")
    rows = many.fold_table(ml.assemble(df, ["a"]), "features", "target")
    coef = many.fit_many(rows, [many.Problem(1e4), many.Problem(1e-6)], 1)
    assert np.isfinite(coef).all() and coef[0, 0] > 0
    margins = many.fold_table(ml.assemble(df.withColumn("target", F.lit(1.0)), ["a"]), "features", "target")
    with pytest.warns(UserWarning) if False else np.errstate():
        one = many.fit_many(margins, [many.Problem(1.0)], 1, max_iter=30)
    assert np.isfinite(one).all()


def test_losses_and_slopes():
    m, y = np.linspace(-3, 3, 61), np.tile([0.0, 1.0], 31)[:61]
    for f, width in ((many.logistic_loss, 0.0), (many.hinge_loss, 0.3)):
        value, slope, bend = f(m, y, width)
        up, down = f(m + 1e-6, y, width), f(m - 1e-6, y, width)
        assert slope == pytest.approx((up[0] - down[0]) / 2e-6, abs=1e-5) and (bend >= 0).all()
    hinge = np.maximum(0, 1 - (2 * y - 1) * m)
    assert (np.abs(many.hinge_loss(m, y, 0.1)[0] - hinge) <= 0.1 / 4 + 1e-12).all()


def test_maps_against_exact_kernels():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    exact = kn.exact_kernel("rbf", x, x, 0.2)
    z = kn.RandomFourier(5, 0.2, 4096, 0)(x)
    assert np.abs(z @ z.T - exact).max() < 0.1 and np.abs(z @ z.T - exact).mean() < 0.02
    for coef0 in (0.0, 0.7):
        exact = kn.exact_kernel("poly", x, x, 0.3, coef0)
        z = kn.Monomials(5, 0.3, coef0, 3)(x)
        assert np.allclose(z @ z.T, exact)
        many_sketches = [kn.TensorSketch(5, 0.3, coef0, 3, 512, s)(x) for s in range(40)]
        near = np.mean([t @ t.T for t in many_sketches], axis=0)
        assert np.abs(near - exact).mean() < 0.05 * np.abs(exact).mean() + 0.02
    exact = kn.exact_kernel("sigmoid", x, x, 0.1, 0.2)
    lm = kn.Landmarks("sigmoid", x[:60], 0.1, 0.2)
    z = lm(x)
    assert np.allclose((z * lm.signs) @ z.T, exact, atol=1e-6)
    part = kn.Landmarks("sigmoid", x[:30], 0.1, 0.2)
    z = part(x)
    assert np.abs((z * part.signs) @ z.T - exact).mean() < 0.05


@pytest.fixture(scope="module")
def ring(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 2))
    y = ((x ** 2).sum(axis=1) > 1.3).astype(float)
    return spark.createDataFrame([(i, float(t), *map(float, r)) for i, (r, t) in enumerate(zip(x, y))], ["id", "target", "a", "b"]).cache()


@pytest.mark.parametrize("kernel,least", [("rbf", 0.97), ("poly", 0.9), ("sigmoid", 0.5), ("linear", 0.3)])
def test_kernel_machines(ring, kernel, least):
    """A ring is beyond a line, not beyond kernels; probabilities follow the margin and the class shares."""
    params = {"C": 10.0, "kernel": kernel, "gamma": "scale", "degree": 2, "coef0": 0.0}
    train, test = ring.where("id % 3 > 0"), ring.where("id % 3 = 0")
    model = ml.make_estimator("svm", ml.BINARY, params).fit(ml.class_weights(ml.assemble(train, ["a", "b"]), "target"))
    pr = ml.predict_scores(model, ml.assemble(test, ["a", "b"]), "svm").cache()
    auc = roc_auc(pr.select(F.lit(0).alias("r"), "id", F.col("target").cast("int").alias("y_true"), "score"), ["r"]).first()["roc_auc"]
    assert auc >= least
    row = pr.agg(F.corr("score", "prob1"), F.avg("prob1"), F.avg("target"), F.min("prob1"), F.max("prob1")).first()
    assert 0 <= row[3] <= row[4] <= 1 and abs(row[1] - row[2]) < 0.1
    if kernel in ("rbf", "poly"):
        assert row[0] > 0.6 and {r["score_kind"] for r in pr.select("score_kind").distinct().collect()} == {"margin"}


def test_linear_machine_is_optimal(spark, table):
    """The rounded hinge ends within its rounding of the hinge's own optimum, found by subgradient descent from there."""
    df, x, y = table
    rows = many.fold_table(ml.assemble(df, NAMES), "features", "target")
    coef = many.fit_many(rows, [many.Problem(1.0)], 4, "hinge", balanced=False)[0]
    sign, n = 2 * y - 1, len(y)
    cost = lambda b: np.maximum(0, 1 - sign * (x @ b[:-1] + b[-1])).mean() + (b[:-1] ** 2).sum() / (2 * n)
    best, b = cost(coef), coef.copy()
    for t in range(20000):
        wrong = sign * (x @ b[:-1] + b[-1]) < 1
        g = np.r_[-(sign[wrong, None] * x[wrong]).sum(axis=0) / n + b[:-1] / n, -sign[wrong].sum() / n]
        b = b - 0.05 / np.sqrt(t + 1) * g
        best = min(best, cost(b))
    assert cost(coef) - best < 0.004


def test_platt_against_plain_newton(spark):
    rng = np.random.default_rng(5)
    s = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * s - 0.5)))).astype(int)
    a, b = kn.platt(spark.createDataFrame([(int(t), float(v)) for t, v in zip(y, s)], "y_true int, score double"))
    n1 = y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (300 - n1 + 2))
    p = 1 / (1 + np.exp(-(a * s + b)))
    assert abs(((p - t) * s).sum()) < 1e-4 and abs((p - t).sum()) < 1e-4


def test_unknown_kernel():
    with pytest.raises(ValueError):
        ml.make_estimator("svm", ml.BINARY, {"kernel": "cosine"})


def test_scans_are_spread_and_skip_rows_without_curvature(spark):
    """A table in one partition is dealt to the cores; the curvature of a narrow hinge is that of all rows."""
    from tabsift.operators import many_linear
    from tabsift.operators.positions import SPREAD_ROWS, spread
    rng = np.random.default_rng(6)
    n = 3 * SPREAD_ROWS
    x = rng.normal(size=(n, 3)).round(3)
    y = (x[:, 0] + rng.normal(size=n) > 0).astype(float)
    rows = spread(spark.createDataFrame([([float(v) for v in r], float(t), [0]) for r, t in zip(x, y)], "x array<double>, y double, folds array<int>").coalesce(1))
    assert rows.rdd.getNumPartitions() == min(3, spark.sparkContext.defaultParallelism) and rows.count() == n
    coef = np.array([[0.9, 0.1, -0.2, 0.05]])
    (_, value, grad, curve), = many_linear._scan(rows, [many_linear.Problem(1.0)], [np.ones(2)], coef, "hinge", 0.01, None)
    z = np.column_stack([x, np.ones(n)])
    loss, slope, bend = many_linear.hinge_loss(z @ coef[0], y, 0.01)
    assert 0 < (bend > 0).mean() < 0.1
    assert value == pytest.approx(loss.sum()) and grad == pytest.approx(slope @ z) and curve == pytest.approx(z.T @ (z * bend[:, None]))
