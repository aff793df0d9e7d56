"""Model training and scoring on ``pyspark.ml`` (ML-*).

Every fit is a distributed ``pyspark.ml`` estimator over a features vector;
loops (boosting rounds, grid points, folds) stay on the driver and each step
is a Spark job. Estimators the reference uses but Spark lacks are re-aimed:

* svm → a linear machine over a kernel's explicit feature map (``kernels``), probabilities by Platt scaling;
* extreme_forest → all trees grown level by level over drawn cuts, as flat arrays (``flat_trees``);
* adaboost → SAMME with depth-1 ``DecisionTreeClassifier`` rounds, AdaBoost.R2 for regression;
* lassolars / omp → least-angle (lasso) path / orthogonal matching pursuit on one Gram matrix.
"""

from __future__ import annotations

import itertools
import math
import warnings

import numpy as np
import pandas as pd
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.portable import sigmoid
from .flat_trees import ExtraTrees, flat_regression_trees, scored, weighted_medians
from .kernels import COMPONENTS, LANDMARKS, KernelSVM
from .many_linear import LinearScore, Problem, fit_many, fold_table, held_out_margins

BINARY = "binary_classification"
REGRESSION = "regression"
CLASSIFIERS = ("logistic_regression", "svm", "forest", "extreme_forest", "adaboost", "xgboost")
REGRESSORS = ("forest", "extreme_forest", "adaboost", "xgboost", "lasso", "lassolars", "elastic_net", "omp")
MARGIN_MODELS = ("logistic_regression", "svm", "adaboost", "xgboost")


def assemble(df: DataFrame, features, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


#: So many classes get their weights from one expression; more (a target that is no class) from a broadcast table.
WEIGHT_CASES = 64


def class_weights(df: DataFrame, target: str = "target", out: str = "weight") -> DataFrame:
    """ML-11: balanced weights n / (2 · n_class) from one aggregate; rows without a class are dropped.

    The weights are literals, so that the fits that read the table later do not count its classes again.
    """
    cls = df.groupBy(target).agg(F.count(F.lit(1)).alias("_nc"))
    rows = cls.limit(WEIGHT_CASES + 1).collect()
    if len(rows) > WEIGHT_CASES:
        tot, k = df.count(), cls.count()
        w = cls.select(target, (F.lit(float(tot)) / (F.lit(float(k)) * F.col("_nc"))).alias(out))
        return df.join(F.broadcast(w), target)
    tot, k = sum(r["_nc"] for r in rows), len(rows)
    weight = F.lit(None).cast("double")
    for r in rows:
        if r[target] is not None:
            weight = F.when(F.col(target) == F.lit(r[target]), F.lit(float(tot) / (float(k) * r["_nc"]))).otherwise(weight)
    return df.where(F.col(target).isNotNull()).select(target, *[c for c in df.columns if c != target], weight.alias(out))


#: The deepest tree that the engine's estimators grow.
MAX_DEPTH = 30


def _rf_depth(d):
    if d is None or int(d) > MAX_DEPTH:
        raise ValueError(f"max_depth {d!r}: trees here are at most {MAX_DEPTH} deep; ask for {MAX_DEPTH} or less")
    return int(d)


def _any_depth(d):
    return None if d is None else int(d)


def effective_grid(grid: dict, name: str = "forest") -> dict:
    """The grid with depths that cannot be had (none, or beyond MAX_DEPTH) set to MAX_DEPTH, said aloud, and equal values once.
    Extremely randomised trees grow as deep as asked for."""
    if "max_depth" not in grid or name == "extreme_forest":
        return grid
    wanted = list(grid["max_depth"])
    used = list(dict.fromkeys(MAX_DEPTH if d is None or d > MAX_DEPTH else d for d in wanted))
    if used != wanted:
        warnings.warn(f"max_depth {wanted} is tried as {used}: trees here are at most {MAX_DEPTH} deep", stacklevel=3)
    return {**grid, "max_depth": used}


def _subset(p: dict, default: str = "sqrt") -> str:
    """``max_features`` as the engine names it: none or 1.0 is all, a share or a count stays a number."""
    m = p.get("max_features", default)
    return "all" if m is None or m == 1.0 else str(m)


def make_estimator(name: str, task: str = BINARY, params: dict | None = None, seed: int = 0,
                   features: str = "features", label: str = "target", weight: str | None = "weight"):
    """Estimator by name and task; unknown combinations are rejected."""
    p = dict(params or {})
    known = CLASSIFIERS if task == BINARY else REGRESSORS
    if name not in known:
        raise ValueError(f"unknown estimator {name!r} for {task}; known: {known}")
    common = dict(featuresCol=features, labelCol=label)
    if task == BINARY:
        wc = {"weightCol": weight} if weight else {}
        if name == "logistic_regression":
            pen = p.get("penalty", "l2")
            enet = {"l1": 1.0, "l2": 0.0, "elasticnet": 0.5}[pen]
            n = p.get("n_rows", 1)
            return LogisticRegression(regParam=1.0 / (float(p.get("C", 1.0)) * n), elasticNetParam=enet,
                                      standardization=False, maxIter=int(p.get("max_iter", 100)), **common, **wc)
        if name == "svm":
            return KernelSVM(float(p.get("C", 1.0)), p.get("kernel", "rbf"), p.get("gamma", "scale"), float(p.get("coef0", 0.0)), int(p.get("degree", 3)),
                             int(p.get("max_iter", 100)), seed, features, label, weight, int(p.get("components", COMPONENTS)), int(p.get("landmarks", LANDMARKS)))
        if name == "extreme_forest":
            return ExtraTrees(int(p.get("n_estimators", 100)), _any_depth(p.get("max_depth")), _subset(p), p.get("criterion", "gini"), seed,
                              features, label, weight, bool(p.get("bootstrap", False)))
        if name == "forest":
            return RandomForestClassifier(numTrees=int(p.get("n_estimators", 100)), impurity=p.get("criterion", "gini"),
                                          maxDepth=_rf_depth(p.get("max_depth", 10)), featureSubsetStrategy=_subset(p),
                                          bootstrap=bool(p.get("bootstrap", True)), seed=seed, cacheNodeIds=True, **common, **wc)
        if name == "xgboost":
            return GBTClassifier(maxIter=int(p.get("n_estimators", 20)), stepSize=float(p.get("learning_rate", 0.1)),
                                 maxDepth=_rf_depth(p.get("max_depth", 3)), featureSubsetStrategy=_subset(p, "all"), seed=seed, **common, **wc)
        if name == "adaboost":
            return AdaBoost(int(p.get("n_estimators", 10)), float(p.get("learning_rate", 1.0)), features, label, seed)
    else:
        if name == "extreme_forest":
            return ExtraTrees(int(p.get("n_estimators", 100)), _any_depth(p.get("max_depth")), _subset(p, "all"), "variance", seed, features, label,
                              None, bool(p.get("bootstrap", False)))
        if name == "forest":
            return RandomForestRegressor(numTrees=int(p.get("n_estimators", 100)), maxDepth=_rf_depth(p.get("max_depth", 10)),
                                         featureSubsetStrategy=_subset(p, "all"), bootstrap=bool(p.get("bootstrap", True)), seed=seed, **common)
        if name == "adaboost":
            return AdaBoostR2(int(p.get("n_estimators", 50)), float(p.get("learning_rate", 1.0)), features, label, seed)
        if name == "xgboost":
            return GBTRegressor(maxIter=int(p.get("n_estimators", 20)), stepSize=float(p.get("learning_rate", 0.1)),
                                maxDepth=_rf_depth(p.get("max_depth", 3)), featureSubsetStrategy=_subset(p, "all"), seed=seed, **common)
        if name == "lassolars":
            return LassoPath(float(p.get("alpha", 1.0)), features, label)
        if name == "lasso":
            return LinearRegression(regParam=float(p.get("alpha", 1.0)), elasticNetParam=1.0, standardization=False, **common)
        if name == "elastic_net":
            return LinearRegression(regParam=float(p.get("alpha", 1.0)), elasticNetParam=float(p.get("l1_ratio", 0.5)),
                                    standardization=False, **common)
        if name == "omp":
            return OMP(p.get("n_nonzero_coefs"), features, label)
    raise ValueError(name)


# ---------------------------------------------------------------- boosting, random cuts and Gram-matrix solvers
def _stump_parts(model) -> tuple[int, float, float, float] | None:
    """(feature, threshold, value left, value right) of a depth-1 tree; None if it is one leaf."""
    root = model._java_obj.rootNode()
    if root.subtreeDepth() == 0:
        return None
    return root.split().featureIndex(), root.split().threshold(), root.leftChild().prediction(), root.rightChild().prediction()


class AdaBoostModel:
    """``stumps``: (feature, threshold, left, right, alpha); alpha's share is the importance of its feature."""

    def __init__(self, stumps, n_features, features):
        self.stumps, self.n_features, self.features = stumps, n_features, features

    def transform(self, df: DataFrame) -> DataFrame:
        """Margin = Σ α_t · (2·pred_t − 1), all stumps in one expression; prob1 = sigmoid(2 · margin)."""
        x = F.col("_x")
        table = F.array(*[F.struct(F.lit(int(j)).alias("j"), F.lit(float(t)).alias("t"), F.lit(a * (2 * lo - 1)).alias("l"), F.lit(a * (2 * hi - 1)).alias("r"))
                          for j, t, lo, hi, a in self.stumps]) if self.stumps else None
        margin = F.aggregate(table, F.lit(0.0), lambda s, q: s + F.when(F.element_at(x, q["j"] + 1) <= q["t"], q["l"]).otherwise(q["r"])) \
            if table is not None else F.lit(0.0)
        return (df.withColumn("_x", vector_to_array(self.features)).withColumn("margin", margin)
                .withColumn("prob1", sigmoid(2 * F.col("margin"))).drop("_x"))

    @property
    def featureImportances(self):
        out = np.zeros(self.n_features)
        for j, *_, a in self.stumps:
            out[j] += a
        return out / out.sum() if out.sum() > 0 else out


class AdaBoost:
    """SAMME boosting of depth-1 trees; each round is one distributed fit plus a weight update projection.

    Lineage is cut every few rounds with ``checkpoint()`` into the shared checkpoint folder.
    """

    def __init__(self, n_estimators=10, learning_rate=1.0, features="features", label="target", seed=0):
        self.n, self.lr, self.features, self.label, self.seed = n_estimators, learning_rate, features, label, seed

    def fit(self, df: DataFrame) -> AdaBoostModel:
        d = df.select(self.features, self.label).withColumn("_w", F.lit(1.0))
        p, stumps = len(d.select(self.features).first()[0]), []
        for t in range(self.n):
            tree = DecisionTreeClassifier(maxDepth=1, featuresCol=self.features, labelCol=self.label, weightCol="_w",
                                          seed=self.seed + t).fit(d)
            parts = _stump_parts(tree)
            if parts is None:
                break
            j, cut, left, right = parts
            pred = F.when(F.element_at(vector_to_array(self.features), j + 1) <= cut, left).otherwise(right)
            wrong = (pred != F.col(self.label)).cast("double")
            row = d.agg(F.sum(F.col("_w") * wrong).alias("e"), F.sum("_w").alias("s")).first()
            err = row["e"] / row["s"]
            if err >= 0.5:
                break
            alpha = self.lr * math.log((1 - err) / max(err, 1e-12))
            stumps.append((j, cut, left, right, alpha))
            if err <= 0:
                break
            d = d.withColumn("_w", F.col("_w") / F.lit(row["s"]) * F.exp(F.lit(alpha) * wrong))
            if (t + 1) % 5 == 0:
                d = d.checkpoint()
        return AdaBoostModel(stumps, p, self.features)


class AdaBoostR2Model:
    """The weighted median of the trees' predictions, all trees walked in one projection."""

    def __init__(self, trees, weights, features):
        self.trees, self.weights, self.features, self.forest = trees, weights, features, flat_regression_trees(trees)

    def transform(self, df: DataFrame) -> DataFrame:
        forest, weights = self.forest, list(self.weights)
        return scored(df, self.features, "prediction", lambda x: weighted_medians(forest.values(x), weights))

    @property
    def featureImportances(self):
        tot = sum(m.featureImportances.toArray() * w for m, w in zip(self.trees, self.weights))
        return tot / tot.sum() if tot.sum() > 0 else tot


class AdaBoostR2:
    """AdaBoost.R2 with linear loss over depth-3 trees: a row's weight falls with its share of the largest error."""

    def __init__(self, n_estimators=50, learning_rate=1.0, features="features", label="target", seed=0, depth=3):
        self.n, self.lr, self.features, self.label, self.seed, self.depth = n_estimators, learning_rate, features, label, seed, depth

    def fit(self, df: DataFrame) -> AdaBoostR2Model:
        d = df.select(self.features, F.col(self.label).cast("double").alias("_y")).withColumn("_w", F.lit(1.0))
        trees, weights = [], []
        for t in range(self.n):
            tree = DecisionTreeRegressor(maxDepth=self.depth, featuresCol=self.features, labelCol="_y", weightCol="_w", seed=self.seed + t).fit(d)
            off = tree.setPredictionCol("_p").transform(d).withColumn("_e", F.abs(F.col("_p") - F.col("_y"))).drop("_p")
            worst = off.agg(F.max("_e")).first()[0] or 0.0
            trees.append(tree)
            if worst <= 0:
                weights.append(1.0)
                break
            row = off.agg(F.sum(F.col("_w") * F.col("_e") / worst).alias("l"), F.sum("_w").alias("s")).first()
            loss = row["l"] / row["s"]
            if loss >= 0.5:
                if len(trees) > 1:
                    trees.pop()
                else:
                    weights.append(1.0)
                break
            beta = loss / (1 - loss)
            weights.append(self.lr * math.log(1 / max(beta, 1e-12)))
            d = off.withColumn("_w", F.col("_w") / F.lit(row["s"]) * F.pow(F.lit(beta), (1 - F.col("_e") / worst) * self.lr)).drop("_e")
            if (t + 1) % 3 == 0:
                d = d.checkpoint()
        return AdaBoostR2Model(trees, weights, self.features)


_POOL = "tabsift-fit"


def concurrently(spark: SparkSession, fn, items, width: int = 4, pool_name: str = _POOL) -> list:
    """Independent fits as concurrent jobs of one session; results in order.

    A fit that is itself one of several runs its own parts one after the other, so at most ``width`` run at once;
    what runs under another ``pool_name`` has that many for each of its threads.
    """
    from concurrent.futures import ThreadPoolExecutor
    from threading import current_thread

    from pyspark import inheritable_thread_target
    if current_thread().name.startswith(pool_name):
        return [fn(i) for i in items]
    with ThreadPoolExecutor(width, pool_name) as pool:
        return list(pool.map(inheritable_thread_target(spark)(fn), items))


class GramModel:
    """A linear model with given coefficients: prediction = intercept + coefficients · x."""

    def __init__(self, coefficients, intercept, features):
        self.coefficients, self.intercept, self.features = DenseVector(coefficients), float(intercept), features

    def transform(self, df: DataFrame) -> DataFrame:
        terms = F.zip_with(vector_to_array(self.features), F.array(*[F.lit(float(c)) for c in self.coefficients]), lambda a, b: a * b)
        return df.withColumn("prediction", F.aggregate(terms, F.lit(self.intercept), lambda s, v: s + v))


def gram_of(df: DataFrame, features: str, label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """(XᵀX, Xᵀy, mean x, mean y, n), centred, from two aggregates: the means, then one pass of products about them."""
    arr = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    p = len(arr.first()["x"])
    row = arr.agg(F.count(F.lit(1)), F.avg("y"), *[F.avg(F.col("x")[j]) for j in range(p)]).first()
    n, my, mx = float(row[0]), row[1], np.array(row[2:], dtype=float)

    def products(batches):
        total = np.zeros((p + 1, p + 1))
        for pdf in batches:
            if len(pdf):
                z = np.column_stack([np.stack(pdf["x"].to_numpy()) - mx, pdf["y"].to_numpy() - my])
                total += z.T @ z
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    full = np.zeros((p + 1, p + 1))
    for r in arr.mapInPandas(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        full[r["i"], r["j"]] = r["v"]
    return full[:p, :p], full[:p, p], mx, my, n


class OMP:
    """Orthogonal matching pursuit on the Gram matrix: one pass over the data, then p-sized algebra. Each step adds the
    feature most correlated (by absolute inner product of centred columns) with the residual and solves least squares anew."""

    def __init__(self, k=None, features="features", label="target"):
        self.k, self.features, self.label = k, features, label

    def fit(self, df: DataFrame) -> GramModel:
        gram, xy, mx, my, _ = gram_of(df, self.features, self.label)
        p = len(xy)
        k = min(self.k or max(1, int(0.1 * p)), p)
        chosen, coef = [], np.zeros(p)
        for _ in range(k):
            left = np.abs(xy - gram @ coef)
            left[chosen] = -1.0
            chosen.append(int(np.argmax(left)))
            coef = np.zeros(p)
            coef[chosen] = np.linalg.lstsq(gram[np.ix_(chosen, chosen)], xy[chosen], rcond=None)[0]
        return GramModel(coef, my - mx @ coef, self.features)


class LassoPath:
    """Least-angle regression in its lasso form on the Gram matrix: the path is followed from all zero to ``alpha``
    (penalty alpha · Σ|b| on half the mean squared error), features entering and leaving as their correlations meet."""

    def __init__(self, alpha=1.0, features="features", label="target"):
        self.alpha, self.features, self.label = alpha, features, label

    def fit(self, df: DataFrame) -> GramModel:
        gram, xy, mx, my, n = gram_of(df, self.features, self.label)
        coef = lasso_by_lars(gram / n, xy / n, self.alpha)
        return GramModel(coef, my - mx @ coef, self.features)


def lasso_by_lars(gram: np.ndarray, xy: np.ndarray, alpha: float) -> np.ndarray:
    """argmin ½ bᵀGb − bᵀxy + alpha Σ|b| along the least-angle path."""
    p = len(xy)
    coef, active, barred = np.zeros(p), [], -1
    level = float(np.abs(xy).max(initial=0.0))
    if level <= alpha:
        return coef
    active = [int(np.argmax(np.abs(xy)))]
    for _ in range(8 * p + 8):
        corr = xy - gram @ coef
        sign = np.sign(corr[active])
        step = np.linalg.lstsq(gram[np.ix_(active, active)], sign, rcond=None)[0]
        move = gram[:, active] @ step  # how each correlation falls per unit of level
        best, event = level - alpha, None
        for j in range(p):
            if j not in active:
                for d, c in ((1 - move[j], level - corr[j]), (1 + move[j], level + corr[j])):
                    if d > 1e-12 and (1e-9 * level if j == barred else -1e-12) <= c / d < best:  # one that has just left does not come back at once
                        best, event = max(c / d, 0.0), ("in", j)
        for i, j in enumerate(active):
            if step[i] * coef[j] < 0 and -coef[j] / step[i] < best:
                best, event = -coef[j] / step[i], ("out", j)
        coef[active] += best * step
        level -= best
        barred = -1
        if event is None:
            break
        if event[0] == "in":
            active.append(event[1])
        else:
            coef[event[1]] = 0.0
            active.remove(event[1])
            barred = event[1]
            if not active:
                break
    return coef


# ---------------------------------------------------------------- scoring
def predict_scores(model, df: DataFrame, name: str, task: str = BINARY, threshold: float | None = None) -> DataFrame:
    """ML-17: ``score`` = margin for margin models, else probability of class 1; ``y_pred`` 0/1.

    ``score_kind`` records which, so summaries can apply a 0 threshold; ``prob1`` is the class-1
    probability in either case (the model's own; for an svm Platt's).
    """
    out = model.transform(df)
    if task == REGRESSION:
        return out.withColumn("score", F.col("prediction")).withColumn("score_kind", F.lit("value"))
    if "prob1" in out.columns:
        prob = F.col("prob1")
    elif "probability" in out.columns:
        prob = vector_to_array("probability")[1]
    else:
        prob = sigmoid(vector_to_array("rawPrediction")[1])
    if "margin" in out.columns:
        score, kind = F.col("margin"), "margin"
    elif name in MARGIN_MODELS and "rawPrediction" in out.columns:
        score, kind = vector_to_array("rawPrediction")[1], "margin"
    else:
        score, kind = prob, "probability"
    thr = threshold if threshold is not None else (0.0 if kind == "margin" else 0.5)
    return (out.withColumn("score", score.cast("double")).withColumn("score_kind", F.lit(kind)).withColumn("prob1", prob.cast("double"))
            .withColumn("y_pred", (F.col("score") >= thr).cast("int")))


# ---------------------------------------------------------------- grids and cross-validation
def param_grid(grid: dict) -> list[dict]:
    """ML-13: Cartesian product of the grid's value lists (small, parameter-sized)."""
    keys = list(grid)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]


def grid_search(df: DataFrame, features, name: str, grid: dict, folds: DataFrame, task: str = BINARY,
                seed: int = 0, label: str = "target"):
    """ML-12: every grid point × every (repeat, fold): fit on the other folds, score the held-out
    fold (AUC for classification, −MAE for regression), mean over folds and repeats, refit the
    best point on all rows. ``folds`` has (id, repeat, fold). Returns (model, best params, cv table).

    Linear models and support vector machines are fitted all at once, one scan a step for every point and fold
    (``many_linear``); points that differ in what has no effect here (warm starts, solvers, step limits) are fitted once."""
    data = assemble(df, features)
    n = df.count()
    points = param_grid(effective_grid(grid, name))
    together = task == BINARY and name in ("logistic_regression", "svm")
    scores = (_together if together else _one_by_one)(data, features, name, points, folds, task, seed, label, n)
    rows = [(gi, str(params), scores.get(gi)) for gi, params in enumerate(points)]
    best_i = max(range(len(rows)), key=lambda i: (rows[i][2] if rows[i][2] is not None else -1e300, -i))
    best = {**points[best_i], "n_rows": n}
    if together and name == "logistic_regression":
        model = logistic_model(data, best, label)
    else:
        model = make_estimator(name, task, best, seed, label=label).fit(class_weights(data, label) if task == BINARY else data)
    cv = df.sparkSession.createDataFrame(rows, "grid_point int, params string, mean_score double")
    return model, best, cv


def _mean_scores(parts) -> dict[int, float]:
    """{grid point: mean of the scores that exist}."""
    per: dict[int, list[float]] = {}
    for gi, s in parts:
        if s is not None and s == s:
            per.setdefault(gi, []).append(s)
    return {gi: math.fsum(v) / len(v) for gi, v in per.items()}


def _one_by_one(data: DataFrame, features, name, points, folds, task, seed, label, n) -> dict[int, float]:
    """One fit a grid point and fold, as concurrent jobs over a written table with the folds of a row as an array."""
    from .evaluate import roc_auc
    from .positions import checkpointed
    by_row = folds.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("repeat", "fold"))).alias("_fold"))
    rows = checkpointed((class_weights(data, label) if task == BINARY else data).join(by_row, "id"))
    keys = folds.select("repeat", "fold").distinct().orderBy("repeat", "fold").collect()

    def fold_score(item):
        gi, k = item
        held = F.col("_fold")[F.lit(k["repeat"])] == k["fold"]
        m = make_estimator(name, task, {**points[gi], "n_rows": n}, seed, label=label).fit(rows.where(~held))
        pr = predict_scores(m, rows.where(held), name, task)
        if task == BINARY:
            s = roc_auc(pr.select(F.lit(0).alias("run_"), "id", F.col(label).cast("int").alias("y_true"), "score"),
                        ["run_"], n).first()["roc_auc"]
        else:
            s = -pr.agg(F.avg(F.abs(F.col("score") - F.col(label)))).first()[0]
        return gi, s

    return _mean_scores(concurrently(data.sparkSession, fold_score, [(gi, k) for gi in range(len(points)) for k in keys]))


#: The share of the absolute part in each penalty.
L1_RATIO = {"l1": 1.0, "l2": 0.0, "elasticnet": 0.5}


def _problem(params: dict, fold=None, active=None) -> Problem:
    return Problem(float(params.get("C", 1.0)), L1_RATIO[params["penalty"]] if "penalty" in params else 0.0, fold, active)


def _together(data: DataFrame, features, name, points, folds, task, seed, label, n) -> dict[int, float]:
    """All points and folds of a kernel in the same scans."""
    from .evaluate import roc_auc
    from .kernels import feature_map
    rows = fold_table(data, "features", label, folds)
    keys = [(int(r["repeat"]), int(r["fold"])) for r in folds.select("repeat", "fold").distinct().orderBy("repeat", "fold").collect()]
    shape = lambda p: tuple(p.get(k, v) for k, v in (("kernel", "rbf"), ("gamma", "scale"), ("coef0", 0.0), ("degree", 3))) if name == "svm" else ()
    parts, width = [], len(list(features))
    for kind in dict.fromkeys(shape(p) for p in points):
        mapped = feature_map(rows, width, *kind, seed=seed) if kind else None
        same: dict[Problem, list[int]] = {}
        for gi, p in enumerate(points):
            if shape(p) == kind:
                same.setdefault(_problem(p if name != "svm" else {"C": p.get("C", 1.0)}), []).append(gi)
        kinds = list(same)
        problems = [Problem(p.strength, p.l1_ratio, k) for p in kinds for k in keys]
        steps = max(int(points[gi].get("max_iter", 100)) for members in same.values() for gi in members)
        coef = fit_many(rows, problems, mapped.width if mapped is not None else width, "hinge" if name == "svm" else "logistic",
                        feature_map=mapped, max_iter=min(steps, 200))
        auc = {r["run"]: r["roc_auc"] for r in roc_auc(held_out_margins(rows, problems, coef, mapped), ["run"], n).collect()}
        parts += [(gi, auc.get(i * len(keys) + j)) for i, p in enumerate(kinds) for gi in same[p] for j in range(len(keys))]
    return _mean_scores(parts)


def logistic_model(data: DataFrame, params: dict, label: str = "target") -> LinearScore:
    """One logistic model on all rows (balanced classes), by the same steps."""
    rows = fold_table(data, "features", label)
    width = len(data.select("features").first()[0])
    coef = fit_many(rows, [_problem(params)], width, max_iter=min(int(params.get("max_iter", 100)), 200))[0]
    return LinearScore(coef[:-1], coef[-1])


def feature_importance(model, features) -> list[tuple[str, float]]:
    """FS-12: tree importances, else |coefficients|, as (feature, importance)."""
    if hasattr(model, "featureImportances"):
        imp = model.featureImportances
        vals = imp.toArray() if hasattr(imp, "toArray") else imp
    elif hasattr(model, "coefficients"):
        vals = [abs(c) for c in model.coefficients.toArray()]
    else:
        raise ValueError("model has neither importances nor coefficients")
    return [(f, float(v)) for f, v in zip(features, vals)]


def soft_vote(pred: DataFrame, keys, model_col: str = "model") -> DataFrame:
    """ML-14: mean class-1 probability over the fitted models per id; label = mean ≥ 0.5.

    The probability is ``prob1`` where the table has it, else the score: through the sigmoid where
    ``score_kind`` says margin, as it is where nothing says so.
    """
    if "prob1" in pred.columns:
        p = F.col("prob1")
    elif "score_kind" in pred.columns:
        p = F.when(F.col("score_kind") == "margin", sigmoid("score")).otherwise(F.col("score"))
    else:
        p = F.col("score")
    g = pred.groupBy(*keys).agg(F.avg(p).alias("proba"), F.countDistinct(model_col).alias("n_models"))
    return g.withColumn("y_pred", (F.col("proba") >= 0.5).cast("int"))


def verify_top_n(train: DataFrame, test: DataFrame, ranking, n_tops, models: dict, task: str = BINARY, seed: int = 0,
                 label: str = "target", key: str = "id") -> DataFrame:
    """ML-16: every model on the first n features of ``ranking``, for every n that the ranking can fill (all of them if
    none can): its predictions of the test rows as one table, written to the shared folder.

    ``models`` is {name: parameters}. Columns: n_top, model, key, y_true, score, score_kind, prob1 (classification)
    and y_pred. Fits run as concurrent jobs.
    """
    tops = [int(n) for n in n_tops if n <= len(ranking)] or [len(ranking)]
    n = train.count()
    weighted = class_weights(train, label) if task == BINARY else train

    def one(item):
        n_top, name = item
        feats = list(ranking[:n_top])
        model = make_estimator(name, task, {**models[name], "n_rows": n}, seed, label=label).fit(assemble(weighted, feats))
        pred = predict_scores(model, assemble(test, feats), name, task)
        kept = ["score", "score_kind", *(["prob1", "y_pred"] if task == BINARY else [])]
        y = F.col(label).cast("int" if task == BINARY else "double").alias("y_true")
        return pred.select(F.lit(n_top).cast("bigint").alias("n_top"), F.lit(name).alias("model"), key, y, *kept)

    tables = concurrently(train.sparkSession, one, [(t, m) for t in tops for m in models])
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    from .positions import checkpointed
    return checkpointed(out)


def vote_regression(pred: DataFrame, keys, model_col: str = "model") -> DataFrame:
    """ML-15: mean prediction over the fitted models per id."""
    return pred.groupBy(*keys).agg(F.avg("score").alias("prediction"), F.countDistinct(model_col).alias("n_models"))

