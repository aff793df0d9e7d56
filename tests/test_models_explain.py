"""Model-side operators: invariants from SURVEY §5 (Shapley additivity, PCA, oversampling, imputation)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsift.operators import explain as xp
from tabsift.operators import models as ml
from tabsift.operators.impute_iterative import iterative_impute
from tabsift.operators.power import yeo_johnson
from tabsift.operators.reduce import pca_scores
from tabsift.operators.resample import random_oversample
from tabsift.operators.split import stratified_split
from tabsift.plans.q_models import model_data


@pytest.fixture(scope="module")
def data(spark, sf):
    return model_data(spark, sf)


def _value(model, spark, rows, top, name="logistic_regression"):
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, " + ", ".join(f"{f} double" for f in top))
    got = ml.predict_scores(model, ml.assemble(frame, top), name).orderBy("id").collect()
    return np.array([r["prob1"] for r in got])


@pytest.mark.parametrize("n_features", [4, 12])
def test_shapley_values_add_up(spark, n_features):
    """They add up to f(x) − mean f(background); with few features they equal the definition."""
    rng = np.random.default_rng(n_features)
    x = rng.normal(size=(120, n_features))
    y = (x[:, 0] - x[:, 1] + 0.5 * x[:, 0] * x[:, 2] + rng.normal(size=120) * 0.3 > 0).astype(float)
    top = [f"f{i}" for i in range(n_features)]
    df = spark.createDataFrame([(i, float(t), *map(float, r)) for i, (r, t) in enumerate(zip(x, y))], ["id", "target", *top]).cache()
    model = ml.make_estimator("forest", ml.BINARY, {"n_estimators": 5, "max_depth": 4}, weight=None).fit(ml.assemble(df, top))
    test = df.where("id < 3")
    phi = xp.shapley_values(model, "forest", test, df.where("id >= 20"), top, background_rows=3)
    got = {}
    for r in phi.collect():
        got.setdefault(r["id"], {})[r["feature"]] = r["phi"]
    from tabsift.functions.portable import hash52
    base = df.where("id >= 20").orderBy(hash52(F.col("id"), F.lit("background")), "id").limit(3).select(*top).collect()
    zero = _value(model, spark, base, top, "forest").mean()
    full = _value(model, spark, x[:3], top, "forest")
    for i in range(3):
        assert sum(got[i].values()) == pytest.approx(full[i] - zero, abs=1e-8)
    if n_features <= 4:
        b = np.array(base)
        v = {}
        for mask in range(1 << n_features):
            keep = np.array([mask >> j & 1 for j in range(n_features)], dtype=bool)
            v[mask] = _value(model, spark, np.where(keep, x[0], b), top, "forest").mean()
        for j in range(n_features):
            want = sum(math.factorial(m.bit_count()) * math.factorial(n_features - m.bit_count() - 1) / math.factorial(n_features) * (v[m | 1 << j] - v[m])
                       for m in range(1 << n_features) if not m >> j & 1)
            assert got[0][top[j]] == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("k", [2, 3, 5, 8])
def test_kernel_solution_over_all_coalitions_is_exact(k):
    masks = xp.coalitions(k)
    assert xp.kernel_solution(masks, k) == pytest.approx(xp.exact_solution(k), abs=1e-8)


def test_sampled_coalitions():
    masks = xp.coalitions(20, 2088, 1)
    assert len(set(masks)) == len(masks) <= 2092 and {0, (1 << 20) - 1} <= set(masks)
    assert all(1 << j in masks and ((1 << 20) - 1) ^ (1 << j) in masks for j in range(20))


def test_linear_shapley_is_the_margin(spark, data):
    _, feats, train, test = data
    top = feats[:4]
    model = ml.make_estimator("logistic_regression", ml.BINARY, {"C": 1.0, "n_rows": train.count()}, weight=None).fit(ml.assemble(train, top))
    sums = {r["id"]: r["s"] for r in xp.linear_shapley(model, test, train, top).groupBy("id").agg(F.sum("phi").alias("s")).collect()}
    margin = {r["id"]: r["score"] for r in ml.predict_scores(model, ml.assemble(test, top), "logistic_regression").collect()}
    mean = ml.predict_scores(model, ml.assemble(train, top), "logistic_regression").agg(F.avg("score")).first()[0]
    assert all(sums[i] == pytest.approx(margin[i] - mean, abs=1e-8) for i in sums)


def test_pca_scores_uncorrelated(spark, data):
    imp, feats, _, _ = data
    s = pca_scores(imp, feats, k=2)
    c = s.agg(F.covar_pop("pc1", "pc2").alias("c"), F.var_pop("pc1").alias("v1"), F.var_pop("pc2").alias("v2")).first()
    assert abs(c.c) < 1e-6 * max(1.0, c.v1) and c.v1 >= c.v2


def test_random_oversample_balances(spark, sf):
    from tabsift.sources.fixtures import doc_features
    train = stratified_split(doc_features(spark, sf), 0.3, 42).where("part = 'train'")
    out = random_oversample(train, 1)
    counts = {r.target: r["count"] for r in out.groupBy("target").count().collect()}
    assert len(set(counts.values())) == 1
    copies = out.where("synthetic = 1").join(train.select("id"), "id", "left_anti").count()
    assert copies == 0  # every copy is a train row


def test_iterative_impute_keeps_observed(spark, sf):
    from tabsift.sources.fixtures import W2_FEATURES, order_features
    d = stratified_split(order_features(spark, sf), 0.3, 7)
    out = iterative_impute(d, W2_FEATURES, max_iter=3)
    assert out.where(" OR ".join(f"{f} IS NULL" for f in W2_FEATURES)).count() == 0
    j = d.alias("a").join(out.alias("b"), "id")
    assert j.where(F.col("a.price").isNotNull() & (F.abs(F.col("a.price") - F.col("b.price")) > 1e-9)).count() == 0


@pytest.mark.parametrize("lam", [0.0, 1.0, 2.0])
def test_yeo_johnson_goldens(spark, lam):
    xs = [-2.0, -0.5, 0.0, 1.0, 3.0]

    def yj(x, l):
        if x >= 0:
            return math.log1p(x) if l == 0 else ((x + 1) ** l - 1) / l
        return -math.log1p(-x) if l == 2 else -((1 - x) ** (2 - l) - 1) / (2 - l)
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.y for r in df.select(yeo_johnson(F.col("x"), F.lit(lam)).alias("y")).collect()]
    assert got == pytest.approx([yj(x, lam) for x in xs])


def test_unknown_estimator_rejected():
    with pytest.raises(ValueError):
        ml.make_estimator("knn", ml.BINARY)
