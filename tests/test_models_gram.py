"""Gram-matrix models, boosting and voting against plain algebra."""

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tabsift.operators import models as ml
from tabsift.operators.impute_iterative import bayesian_ridge, iterative_impute
from tabsift.operators.summarise import run_scores, u_counts, upper_tail


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6))
    x[:, 1] = x[:, 0] + 0.3 * x[:, 1]
    y = 3 * x[:, 0] - 2 * x[:, 2] + 0.5 * x[:, 4] + rng.normal(size=400) * 0.3 + 1000
    names = [f"f{i}" for i in range(6)]
    df = spark.createDataFrame([(i, float(v), *map(float, r)) for i, (r, v) in enumerate(zip(x, y))], ["id", "target", *names]).cache()
    return ml.assemble(df, names), x, y, names


def test_omp_matches_least_squares(regression):
    df, x, y, _ = regression
    model = ml.make_estimator("omp", ml.REGRESSION, {"n_nonzero_coefs": 3}).fit(df)
    chosen = np.flatnonzero(model.coefficients.toArray())
    a = np.column_stack([x[:, chosen], np.ones(len(y))])
    best = np.linalg.lstsq(a, y, rcond=None)[0]
    assert len(chosen) == 3 and model.coefficients.toArray()[chosen] == pytest.approx(best[:-1], abs=1e-8) and model.intercept == pytest.approx(best[-1], abs=1e-6)
    row = model.transform(df).orderBy("id").first()
    assert row["prediction"] == pytest.approx(float(x[0] @ model.coefficients.toArray() + model.intercept))


@pytest.mark.parametrize("alpha", [0.001, 0.05, 0.4, 10.0])
def test_lasso_path_is_optimal(regression, alpha):
    """At the end of the path the optimality conditions of the lasso hold, and the engine's own solver agrees."""
    df, x, y, _ = regression
    coef = ml.make_estimator("lassolars", ml.REGRESSION, {"alpha": alpha}).fit(df).coefficients.toArray()
    xc, yc = x - x.mean(axis=0), y - y.mean()
    grad = xc.T @ (yc - xc @ coef) / len(y)
    assert (np.abs(grad) <= alpha + 1e-8).all()
    assert np.allclose(grad[coef != 0], alpha * np.sign(coef[coef != 0]), atol=1e-8)
    other = LinearRegression(regParam=alpha, elasticNetParam=1.0, standardization=False, labelCol="target", maxIter=500, tol=1e-12).fit(df)
    assert coef == pytest.approx(other.coefficients.toArray(), abs=2e-3)


def test_lasso_path_on_random_problems():
    rng = np.random.default_rng(1)
    for _ in range(60):
        p = int(rng.integers(1, 9))
        x = rng.normal(size=(40, p)) @ rng.normal(size=(p, p))
        y = rng.normal(size=40)
        g, c = x.T @ x / 40, x.T @ y / 40
        alpha = float(np.abs(c).max() * rng.uniform(0, 1.1))
        coef = ml.lasso_by_lars(g, c, alpha)
        grad = c - g @ coef
        assert (np.abs(grad) <= alpha + 1e-6).all() and np.allclose(grad[coef != 0], alpha * np.sign(coef[coef != 0]), atol=1e-6)


@pytest.mark.parametrize("name", ["adaboost", "extreme_forest", "forest", "xgboost"])
def test_regressors_learn(regression, name):
    df, _, y, _ = regression
    model = ml.make_estimator(name, ml.REGRESSION, {"n_estimators": 6, "max_depth": 4}, seed=1).fit(df)
    err = ml.predict_scores(model, df, name, ml.REGRESSION).agg(F.avg(F.pow(F.col("score") - F.col("target"), 2))).first()[0]
    assert err < 0.8 * y.var()


@pytest.fixture(scope="module")
def classes(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 3))
    y = ((x[:, 0] > 0.2) ^ (rng.random(500) < 0.1)).astype(float)
    df = spark.createDataFrame([(i, float(t), *map(float, r)) for i, (r, t) in enumerate(zip(x, y))], ["id", "target", "a", "b", "c"])
    return df.cache(), x, y


def test_adaboost_margin_and_weights(classes):
    """The first stump's weight is the textbook value, and the margin is the sum over stumps."""
    df, x, y = classes
    model = ml.make_estimator("adaboost", ml.BINARY, {"n_estimators": 4}).fit(ml.assemble(df, ["a", "b", "c"]))
    j, cut, left, right, alpha = model.stumps[0]
    err = np.mean(np.where(x[:, j] <= cut, left, right) != y)
    assert alpha == pytest.approx(np.log((1 - err) / err))
    got = [r["margin"] for r in model.transform(ml.assemble(df, ["a", "b", "c"])).orderBy("id").collect()]
    want = sum(a * (2 * np.where(x[:, q] <= c, lo, hi) - 1) for q, c, lo, hi, a in model.stumps)
    assert got == pytest.approx(want.tolist()) and model.featureImportances.sum() == pytest.approx(1)
    none = ml.make_estimator("adaboost", ml.BINARY, {"n_estimators": 4}).fit(ml.assemble(df.withColumn("target", F.lit(1.0)), ["a"]))
    assert none.featureImportances.tolist() == [0.0] and none.transform(ml.assemble(df, ["a"])).first()["margin"] == 0.0


def test_voting_uses_probabilities_and_scores_use_the_margin(classes):
    df, _, _ = classes
    models = {"logistic_regression": {"C": 1.0}, "forest": {"n_estimators": 5, "max_depth": 3}, "svm": {"C": 1.0}, "extreme_forest": {"n_estimators": 4, "max_depth": 4}}
    pred = ml.verify_top_n(df.where("id < 350"), df.where("id >= 350"), ["a", "b", "c"], [1, 2, 9], models)
    assert {(r["n_top"], r["model"]) for r in pred.select("n_top", "model").distinct().collect()} == {(n, m) for n in (1, 2) for m in models}
    voted = ml.soft_vote(pred, ["n_top", "id"]).collect()
    assert all(0 <= r["proba"] <= 1 and r["n_models"] == 4 for r in voted)
    plain = ml.soft_vote(pred.drop("prob1"), ["n_top", "id"]).collect()
    assert all(0 <= r["proba"] <= 1 for r in plain)
    acc = {(r["n_top"], r["model"]): r["value"] for r in run_scores(pred, ["n_top", "model"]).where("metric = 'accuracy'").collect()}
    direct = {(r["n_top"], r["model"]): r["a"] for r in pred.groupBy("n_top", "model").agg(F.avg((F.col("y_pred") == F.col("y_true")).cast("double")).alias("a")).collect()}
    assert acc == pytest.approx(direct) and min(acc.values()) > 0.7
    youden = {(r["n_top"], r["model"]): r["value"] for r in run_scores(pred, ["n_top", "model"], youden=True).where("metric = 'balanced_accuracy'").collect()}
    fixed = {(r["n_top"], r["model"]): r["value"] for r in run_scores(pred, ["n_top", "model"]).where("metric = 'balanced_accuracy'").collect()}
    assert all(youden[k] >= fixed[k] - 1e-12 for k in fixed)


def test_depths_that_cannot_be_had(recwarn):
    with pytest.raises(ValueError):
        ml.make_estimator("forest", ml.BINARY, {"max_depth": 50})
    with pytest.raises(ValueError):
        ml.make_estimator("xgboost", ml.REGRESSION, {"max_depth": None})
    assert ml.effective_grid({"max_depth": [5, 50, 100, None], "C": [1]}) == {"max_depth": [5, 30], "C": [1]}
    assert any("at most 30" in str(w.message) for w in recwarn)


def test_u_counts():
    assert u_counts(2, 2) == [1, 1, 2, 1, 1] and u_counts(0, 5) == [1] and sum(u_counts(5, 7)) == 792
    assert sum(u_counts(8, 2000)) > 0 and upper_tail(1, 3, 3) == pytest.approx(0.25)


def test_bayesian_ridge_and_iterative_imputation(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=500) * 0.1
    coef = bayesian_ridge(x.T @ x, x.T @ y, float(y @ y), 500)
    assert coef == pytest.approx([1.0, -2.0, 0.5], abs=0.03)
    rows = [(i, *map(float, r), float(v) if i % 10 else None) for i, (r, v) in enumerate(zip(x + 1e6, y + 1e6))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double").withColumn("part", F.when(F.col("id") % 4 == 0, "test").otherwise("train"))
    out = {r["id"]: r["d"] for r in iterative_impute(df, ["a", "b", "c", "d"], tol=1e-9).collect()}
    assert np.mean([(out[i] - 1e6 - y[i]) ** 2 for i in range(0, 500, 10)]) < 0.05
