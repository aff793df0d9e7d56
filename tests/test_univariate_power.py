"""Univariate grid scores against fitted models, and the power that maximises the likelihood."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsift.operators.models_select import univariate_ranking, univariate_scores
from tabsift.operators.power import fit_lambdas
from tabsift.operators.split import repeated_stratified_kfold


def auc(s, y):
    p, n = s[y == 1], s[y == 0]
    return ((p[:, None] > n[None]).sum() + 0.5 * (p[:, None] == n[None]).sum()) / (len(p) * len(n))


def slope(x, y, c, l1, l2):
    """Proximal gradient on the balanced logistic loss with an elastic penalty on the slope."""
    s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    b = w = 0.0
    step = 1 / (c * 0.25 * (s * (1 + x * x)).sum() + l2)
    for _ in range(20000):
        r = s * (1 / (1 + np.exp(-(b + w * x))) - y)
        b -= step * c * r.sum()
        u = w - step * (c * (r * x).sum() + l2 * w)
        w = np.sign(u) * max(abs(u) - step * l1, 0.0)
    return w


def test_scores_equal_fitted_models(spark):
    rng = np.random.default_rng(12)
    y = (rng.random(90) < 0.35).astype(float)
    x = np.column_stack([y + rng.normal(size=90), -0.4 * y + rng.normal(size=90), rng.normal(size=90).round(1)])
    df = spark.createDataFrame([(i, float(t), *map(float, r)) for i, (r, t) in enumerate(zip(x, y))], ["id", "target", "a", "b", "c"]).cache()
    cs = (0.001, 0.05, 1.0)
    got = {(r["feature"], r["penalty"], r["c"]): r["mean_auc"] for r in univariate_scores(df, ["a", "b", "c"], cs=cs, n_repeats=2, seed=3).collect()}
    folds = {(r["repeat"], r["id"]): r["fold"] for r in repeated_stratified_kfold(df.select("id", "target"), 3, 2, 3).collect()}
    for j, f in enumerate("abc"):
        for p, (l1, l2) in {"l1": (1.0, 0.0), "l2": (0.0, 1.0), "elasticnet": (0.5, 0.5)}.items():
            for c in cs:
                vals = []
                for rep in range(2):
                    for k in range(3):
                        held = np.array([folds[rep, i] == k for i in range(90)])
                        w = slope(x[~held, j], y[~held], c, l1, l2)
                        vals.append(auc(np.sign(w) * (abs(w) > 1e-9) * x[held, j], y[held]))
                assert got[f, p, c] == pytest.approx(np.mean(vals), abs=1e-9), (f, p, c)
    best = {r["feature"]: r["score"] for r in univariate_ranking(df, ["a", "b", "c"], cs=cs, n_repeats=2, seed=3).collect()}
    assert best == {f: pytest.approx(max(v for (g, *_), v in got.items() if g == f)) for f in "abc"}


def loglik(x, lam):
    pos = x >= 0
    out = np.empty_like(x)
    out[pos] = np.log1p(x[pos]) if abs(lam) < 1e-12 else ((x[pos] + 1) ** lam - 1) / lam
    out[~pos] = -np.log1p(-x[~pos]) if abs(lam - 2) < 1e-12 else -((1 - x[~pos]) ** (2 - lam) - 1) / (2 - lam)
    return -len(x) / 2 * np.log(out.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()


def test_powers_maximise_the_likelihood(spark):
    rng = np.random.default_rng(2)
    cols = {"lognormal": rng.lognormal(size=600), "normal": rng.normal(size=600), "left": -rng.gamma(1.0, 1.0, 600) ** 2,
            "steep": 1 - 1e-3 * rng.random(600) ** 8, "constant": np.full(600, 4.0)}
    df = spark.createDataFrame([(i, *[float(v[i]) for v in cols.values()], None) for i in range(600)],
                               "id long, " + ", ".join(f"{c} double" for c in cols) + ", empty double")
    got = fit_lambdas(df, [*cols, "empty"])
    assert "empty" not in got and got["constant"] == 1.0
    for c in ("lognormal", "normal", "left"):
        here = loglik(cols[c], got[c])
        assert all(here >= loglik(cols[c], got[c] + d) - 1e-9 for d in (-1e-3, 1e-3, -0.1, 0.1)), c
    assert abs(got["steep"]) > 3


def test_rfecv_with_grid_and_repeats(spark):
    from tabsift.operators import models_select as ms
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 3))
    y = (x[:, 0] + 0.2 * rng.normal(size=120) > 0).astype(float)
    df = spark.createDataFrame([(i, float(t), *map(float, r)) for i, (r, t) in enumerate(zip(x, y))], ["id", "target", "a", "b", "c"])
    ordered, curve = ms.rfecv(df, ["a", "b", "c"], "logistic_regression", {}, n_repeats=2, grid={"C": [0.1, 1.0]})
    assert ordered[0] == "a" and [r["n_features"] for r in curve.orderBy("n_features").collect()] == [2, 3]
    imp = {r["feature"]: r["importance"] for r in ms.permutation_importance(df, ["a", "b", "c"], n_repeats=2, n_trees=5).collect()}
    assert imp["a"] > 0.2 > max(imp["b"], imp["c"])


def test_likelihoods_of_a_grid_in_one_scan(spark):
    """Parts of many tasks meet at the common mean; nulls are left out, large values cost no digits, a NaN has no likelihood."""
    import numpy as np
    from tabsift.operators.power import _loglik
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=400), 1e9 + rng.normal(size=400), rng.normal(size=400)])
    rows = [(*(float(v) for v in r[:2]), float("nan") if i == 7 else float(r[2]), None) for i, r in enumerate(x)] + [(None, None, 0.5, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    got = _loglik(df, {"a": [-1.0, 0.0, 0.5, 2.0], "b": [1.0, 2.0], "c": [1.0], "d": [1.0]})
    assert got["c"] == [] and "d" not in got
    for j, f in enumerate("ab"):
        for lam, ll in got[f]:
            v = x[:, j]
            with np.errstate(all="ignore"):
                up = np.log1p(v) if lam == 0 else ((v + 1) ** lam - 1) / lam
                down = -np.log1p(-v) if lam == 2 else -((1 - v) ** (2 - lam) - 1) / (2 - lam)
            want = -200 * np.log(np.where(v >= 0, up, down).var()) + (lam - 1) * (np.sign(v) * np.log1p(np.abs(v))).sum()
            assert ll == pytest.approx(want, rel=1e-6, abs=1e-4)
