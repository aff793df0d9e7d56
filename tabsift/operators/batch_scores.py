"""Fitted models as numpy functions of a matrix, for operators that score many variants of a row inside an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.sql import functions as F

from ..session import scratch_path
from .flat_trees import ExtraTreesModel, FlatForest, flat_regression_trees
from .kernels import KernelSVMModel
from .many_linear import LinearScore


def flat_forest(spark, model: RandomForestClassificationModel) -> FlatForest:
    """A random forest as arrays; a leaf's value is its share of class 1. The model is written once and its nodes are read."""
    path = scratch_path(spark, "forest")
    model.save(path)
    n = F.col("nodeData")
    nodes = (spark.read.parquet(f"{path}/data")
             .select("treeID", n["id"].alias("id"), n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"),
                     n["split"]["leftCategoriesOrThreshold"].alias("cut"), n["impurityStats"].alias("stats")).orderBy("treeID", "id").collect())
    place = {(r["treeID"], r["id"]): i for i, r in enumerate(nodes)}
    child = lambda r, c: place[r["treeID"], r[c]] if r[c] >= 0 else -1
    share = [r["stats"][1] / sum(r["stats"]) if len(r["stats"]) > 1 and sum(r["stats"]) else 0.0 for r in nodes]
    return FlatForest([r["feature"] if r["left"] >= 0 else -1 for r in nodes], [r["cut"][0] if r["left"] >= 0 else 0.0 for r in nodes],
                      [child(r, "left") for r in nodes], [child(r, "right") for r in nodes], share,
                      [place[t, 0] for t in sorted({r["treeID"] for r in nodes})])


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -500, 500)))


def probability(spark, model) -> Callable[[np.ndarray], np.ndarray]:
    """The class-1 probability of a fitted classifier as a function of a matrix of its features."""
    from .models import AdaBoostModel
    if isinstance(model, LogisticRegressionModel | LinearScore):
        coef, at = model.coefficients.toArray(), float(model.intercept)
        return lambda x: _sigmoid(x @ coef + at)
    if isinstance(model, KernelSVMModel):
        mapped, weights, at, slope, offset = model.map, model.weights, model.intercept, model.slope, model.offset
        return lambda x: _sigmoid(((mapped(x) if mapped is not None else x) @ weights + at) * slope + offset)
    if isinstance(model, AdaBoostModel):
        stumps = list(model.stumps)
        return lambda x: _sigmoid(2 * sum((a * (2 * np.where(x[:, j] <= cut, lo, hi) - 1) for j, cut, lo, hi, a in stumps), np.zeros(len(x))))
    if isinstance(model, GBTClassificationModel):
        forest, share = flat_regression_trees(model.trees), np.array(model.treeWeights)
        return lambda x: _sigmoid(2 * (forest.values(x) @ share))
    if isinstance(model, RandomForestClassificationModel):
        forest = flat_forest(spark, model)
        return lambda x: forest.values(x).mean(axis=1)
    if isinstance(model, ExtraTreesModel):
        forest = model.forest
        return lambda x: forest.values(x).mean(axis=1)
    raise ValueError(f"no batch form of {type(model).__name__}")
