"""Flat forests against the engine's own trees and against plain recursion."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from tabsift.operators import flat_trees as ft
from tabsift.operators import models as ml
from tabsift.operators.evaluate import roc_auc


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(400, 4)), 2)
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(400) < 0.05)).astype(float)
    rows = [(i, float(t), float(3 * r[0] - r[2] ** 2), *map(float, r)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, ["id", "target", "value", "a", "b", "c", "d"])
    return ml.assemble(df, ["a", "b", "c", "d"]).cache(), x, y, np.array([r[2] for r in rows])


def walk(forest, root, row):
    at = root
    while forest.feature[at] >= 0:
        at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
    return at


def test_engine_trees_as_arrays(data):
    df, x, _, _ = data
    trees = [DecisionTreeRegressor(maxDepth=d, labelCol="value", seed=d).fit(df) for d in (0, 1, 3, 6)]
    forest = ft.flat_regression_trees(trees)
    values = forest.values(x)
    for t, tree in enumerate(trees):
        assert values[:, t].tolist() == [tree.predict(Vectors.dense(r)) for r in x]


def test_weighted_median_is_the_plain_one():
    rng = np.random.default_rng(0)
    values, weights = rng.integers(0, 5, size=(200, 7)).astype(float), rng.random(7)
    for row, got in zip(values, ft.weighted_medians(values, weights)):
        assert got == min(v for v in row if weights[row <= v].sum() >= weights.sum() / 2 - 1e-12)


@pytest.mark.parametrize("criterion,subset,bootstrap", [("gini", "sqrt", False), ("entropy", "all", True), ("variance", "log2", False)])
def test_grown_trees(data, criterion, subset, bootstrap):
    """Leaves hold the weighted means of the rows that end in them, and inner nodes part their rows in two."""
    df, x, y, v = data
    label, target = ("value", v) if criterion == "variance" else ("target", y)
    how = ft.ExtraTrees(5, 4, subset, criterion, 7, "features", label, None, bootstrap)
    rows = df.select("features", label)
    model = how.fit(rows)
    forest, leaves = model.forest, model.forest.nodes(x)
    assert (leaves == [[walk(forest, r, row) for r in forest.roots] for row in x]).all()
    if not bootstrap:
        for t in range(5):
            for leaf in np.unique(leaves[:, t]):
                assert forest.value[leaf] == pytest.approx(target[leaves[:, t] == leaf].mean())
    depth = lambda at: 0 if forest.feature[at] < 0 else 1 + max(depth(forest.left[at]), depth(forest.right[at]))
    assert max(map(depth, forest.roots.tolist())) <= 4
    out = [r[0] for r in model.transform(df).orderBy("id").select("prediction" if criterion == "variance" else "prob1").collect()]
    assert out == pytest.approx(forest.values(x).mean(axis=1).tolist())
    assert model.featureImportances.sum() == pytest.approx(1)


def test_whole_depth_learns_the_rows(data):
    """Without bounds each tree separates all rows that differ; slices of open nodes change nothing."""
    df, x, y, _ = data
    how = lambda: ft.ExtraTrees(3, None, "sqrt", "gini", 5, "features", "target", None)
    model = how().fit(df)
    assert (model.forest.values(x) == y[:, None]).mean() > 0.99 and (np.diff([len(np.unique(c)) for c in model.forest.nodes(x).T]) != 0).any()
    held, ft.SCAN_DOUBLES = ft.SCAN_DOUBLES, 64
    try:
        again = how().fit(df.limit(60))
    finally:
        ft.SCAN_DOUBLES = held
    plain = how().fit(df.limit(60))
    assert sorted(plain.forest.threshold.tolist()) == sorted(again.forest.threshold.tolist()) or len(plain.forest.feature) > 3


def test_weights_and_constant_rows(spark):
    df = spark.createDataFrame([(float(i % 2), 1.0, 3.0 if i % 2 else 1.0) for i in range(8)], "target double, a double, weight double")
    model = ft.ExtraTrees(2, None, "all", "gini", 1, "features", "target", "weight").fit(ml.assemble(df, ["a"]))
    assert model.forest.feature.tolist() == [-1, -1] and model.forest.value.tolist() == pytest.approx([0.75, 0.75]) and model.featureImportances.tolist() == [0.0]


def test_many_trees_in_one_projection(data):
    df, _, _, _ = data
    model = ml.make_estimator("extreme_forest", ml.BINARY, {"n_estimators": 500, "max_depth": 3}, 3).fit(ml.class_weights(df, "target"))
    out = model.transform(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(model.forest.roots) == 500 and plan.count("ArrowEvalPython") == 1
    pred = ml.predict_scores(model, df, "extreme_forest").select(F.lit(0).alias("r"), "id", F.col("target").cast("int").alias("y_true"), "score")
    assert roc_auc(pred, ["r"]).first()["roc_auc"] > 0.8


def test_bootstrap_copies():
    often = np.array([ft.copies(np.arange(20000), t, 3) for t in range(3)])
    assert often.mean() == pytest.approx(1, abs=0.02) and (often == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)
    assert (ft.copies(np.arange(50), 1, 3) == often[1, :50]).all() and (often[0] != often[1]).any()


def test_nested_fits(data):
    """Grids and verifications run extremely randomised trees inside their own concurrent fits."""
    df, _, _, _ = data
    from tabsift.operators.split import repeated_stratified_kfold
    plain = df.drop("features")
    folds = repeated_stratified_kfold(plain.select("id", "target"), 2, 1, 1)
    _, best, cv = ml.grid_search(plain, ["a", "b"], "extreme_forest", {"n_estimators": [3], "max_depth": [2, None]}, folds)
    assert cv.count() == 2 and best["max_depth"] in (2, None)
    pred = ml.verify_top_n(plain.where("id < 300"), plain.where("id >= 300"), ["a", "b"], [2], {"extreme_forest": {"n_estimators": 3, "max_depth": 4}})
    assert pred.count() == 100


@pytest.mark.parametrize("bootstrap", [False, True])
def test_places_written_anew_change_nothing(data, bootstrap):
    """Rows that keep their open nodes grow the forest that a walk from the roots grows; a node takes 16 bytes of the driver."""
    df, x, _, _ = data
    how = lambda: ft.ExtraTrees(4, None, "sqrt", "gini", 5, "features", "target", None, bootstrap).fit(df.limit(120)).forest
    plain, held = how(), ft.RECENT_NODES
    try:
        ft.RECENT_NODES = 10
        again = how()
    finally:
        ft.RECENT_NODES = held
    assert again.feature.tolist() == plain.feature.tolist() and again.left.tolist() == plain.left.tolist() and again.cut.tolist() == pytest.approx(plain.cut.tolist())
    assert again.values(x) == pytest.approx(plain.values(x))
    assert sum(v.nbytes for v in vars(again).values() if v is not None) <= 16 * len(again.feature) + 64
