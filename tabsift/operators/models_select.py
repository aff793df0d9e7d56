"""Model-driven feature selection (FS-3, FS-8…FS-12).

* ``univariate_ranking`` scores every one-feature logistic model of the whole
  grid from class means and one AUC per feature and fold (see there).
* ``permutation_importance`` scores all (feature, repeat) permutations inside
  Arrow batches; a permutation is a keyed bijection of the rows' positions, so
  one narrow exchange brings every row its permuted values.
* ``rfecv`` and ``gbt_recursive_importance`` loop over feature-set sizes on the
  driver; every fit is a distributed ``pyspark.ml`` fit, folds run as
  concurrent Spark jobs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.portable import hash52
from . import models as ml
from .batch_scores import probability
from .evaluate import roc_auc
from .frames import to_long
from .many_linear import fit_many, fold_table, held_out_margins
from .positions import checkpointed, hash_positions
from .split import repeated_stratified_kfold
from .stats import column_centers


# ---------------------------------------------------------------- FS-9
#: The penalties and strengths of the univariate models, and the share of the absolute part in an elastic net.
PENALTIES, STRENGTHS, L1_RATIO = ("l1", "l2", "elasticnet"), tuple(10.0 ** e for e in range(-4, 5)), 0.5


def univariate_scores(train: DataFrame, features, target: str = "target", penalties=PENALTIES, cs=STRENGTHS, n_splits: int = 3,
                      n_repeats: int = 10, seed: int = 0) -> DataFrame:
    """(feature, penalty, c, mean_auc) of one-feature logistic models (intercept, balanced classes) over repeated folds.

    The AUC of a one-feature model depends on its slope's sign alone: it is the feature's own AUC on the held-out
    fold, turned round for a falling slope, one half for none. The sign needs no fit. By convexity the slope has the
    sign of G = n / 4 · (mean of class 1 − mean of class 0) on the training folds, and a penalty with absolute part
    r (1 for l1, L1_RATIO for an elastic net, 0 for l2) keeps it at zero exactly where C · |G| ≤ r. So all
    strengths and penalties come from class means and one AUC per feature and fold, exactly.
    """
    feats = list(features)
    folds = repeated_stratified_kfold(train.select("id", target), n_splits, n_repeats, seed, target=target).select("id", "repeat", "fold")
    centers = column_centers(train, feats)
    shifted = train.select("id", target, *[(F.col(f).cast("double") - F.lit(centers[f])).alias(f) for f in feats])
    long = to_long(shifted, ["id", target], feats).where(F.col("value").isNotNull())
    runs = ["feature", "repeat", "fold"]
    rows = long.join(folds, "id")
    own = rows.groupBy(*runs).agg(*[e for c in (0, 1) for e in (
        F.count(F.when(F.col(target) == c, 1)).alias(f"n{c}"), F.sum(F.when(F.col(target) == c, F.col("value"))).alias(f"s{c}"))])
    w = Window.partitionBy("feature", "repeat")  # the folds of one repeat
    rest = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0))).over(w) - F.coalesce(F.col(c), F.lit(0.0))
    g = own.select(*runs, ((rest("n0") + rest("n1")) / 4 * (F.try_divide(rest("s1"), rest("n1")) - F.try_divide(rest("s0"), rest("n0")))).alias("g"))
    auc = roc_auc(rows.select(*runs, "id", F.col(target).cast("int").alias("y_true"), F.col("value").alias("score")), runs)
    grid = F.explode(F.array(*[F.struct(F.lit(p).alias("penalty"), F.lit(float(c)).alias("c"),
                                        F.lit({"l1": 1.0, "l2": 0.0, "elasticnet": L1_RATIO}[p]).alias("r")) for p in penalties for c in cs]))
    each = auc.join(g, runs).select(*runs, "roc_auc", "g", grid.alias("p")).select("*", "p.*")
    value = (F.when(F.abs("g") * F.col("c") <= F.col("r"), F.when(F.col("roc_auc").isNotNull(), 0.5)).when(F.col("g") > 0, F.col("roc_auc"))
             .when(F.col("g") < 0, 1 - F.col("roc_auc")).when(F.col("roc_auc").isNotNull(), 0.5))
    return each.groupBy("feature", "penalty", "c").agg(F.avg(value).alias("mean_auc"))


def univariate_ranking(train: DataFrame, features, target: str = "target", threshold: float = 0.0, **kw) -> DataFrame:
    """FS-9: (feature, score) best cross-validated AUC over the penalties; kept when score > threshold
    if threshold > 0; best first."""
    s = univariate_scores(train, features, target, **kw)
    best = s.groupBy("feature").agg(F.max("mean_auc").alias("score"))
    return best.where(F.col("score") > threshold) if threshold > 0 else best


# ---------------------------------------------------------------- FS-3
#: Rounds of the keyed bijection.
ROUNDS = 4


def bijection_keys(seed, feature: str, rep: int) -> list[int]:
    """The 24-bit round keys of a permutation."""
    return [int(hashlib.md5(f"{seed}|{feature}|{rep}|{i}".encode()).hexdigest()[:6], 16) for i in range(ROUNDS)]


def half_bits(n: int) -> int:
    """Bits of one half of the smallest even-width block that holds the numbers below ``n`` (at most 20: 10^12 rows)."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def permuted(pos: np.ndarray, n: int, keys: list[int]) -> np.ndarray:
    """A keyed bijection of 0 … n − 1: a Feistel network over a power-of-four block, walked on until it lands below ``n``."""
    h = half_bits(n)
    mask = (1 << h) - 1
    out, todo = pos.astype(np.int64), np.ones(len(pos), dtype=bool)
    while todo.any():
        left, right = out[todo] >> h, out[todo] & mask
        for key in keys:
            v = (right + key) * 362437
            left, right = right, left ^ ((((v ^ (v >> 11)) * 69069) >> 7) & mask)
        out[todo] = (left << h) | right
        todo = out >= n
    return out


def permuted_values(base: DataFrame, features, n_repeats: int, seed) -> DataFrame:
    """(pos, values): for every row its values of all permuted features, ordered by feature and repeat.

    ``base`` has pos (0 … n − 1) and the features. A row sends each value to the row that the bijection names, so
    one exchange of (position, number, value) does all features and repeats; nothing is numbered or sorted for it.
    """
    features, n = list(features), base.count()
    keys = [bijection_keys(seed, f, r) for f in features for r in range(n_repeats)]

    def send(batches):
        for pdf in batches:
            pos = pdf["pos"].to_numpy()
            for k, key in enumerate(keys):
                yield pd.DataFrame({"pos": permuted(pos, n, key), "k": k, "v": pdf[features[k // n_repeats]].to_numpy(dtype=float)})

    sent = base.select("pos", *[F.col(f).cast("double").alias(f) for f in features]).mapInPandas(send, "pos long, k int, v double")
    return sent.groupBy("pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("values"))  # len(keys) a row


def with_positions(train: DataFrame, columns, seed) -> DataFrame:
    """``columns`` and pos: the rows' places in the order of md5(id | seed), written once."""
    n = train.count()
    ids = hash_positions(train.select("id", hash52(F.col("id"), F.lit(str(seed))).alias("_h")), [], "_h", "id", out="pos", max_group_rows=n)
    return checkpointed(train.select(*columns).join(ids.select("id", "pos"), "id"))


def permutation_importance(train: DataFrame, features, target: str = "target", n_repeats: int = 5, seed: int = 0,
                           n_trees: int = 100) -> DataFrame:
    """FS-3: (feature, importance) = baseline AUC − mean AUC after permuting the feature, forest model.

    A batch of rows is scored with one feature after the other replaced; only (run, score) rows leave the task.
    """
    features = list(features)
    base = with_positions(train, ["id", target, *features], seed)
    n, p = base.count(), len(features)
    model = ml.make_estimator("forest", ml.BINARY, {"n_estimators": n_trees, "max_depth": 8, "n_rows": n}, seed,
                              weight=None).fit(ml.assemble(base, features))
    score = probability(train.sparkSession, model)

    def scores(batches):
        for pdf in batches:
            x, y = pdf[features].to_numpy(dtype=float), pdf["y"].to_numpy()
            other = np.stack(pdf["values"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, p * n_repeats))
            yield pd.DataFrame({"run": -1, "y_true": y, "score": score(x)})
            for k in range(p * n_repeats):
                z = x.copy()
                z[:, k // n_repeats] = other[:, k]
                yield pd.DataFrame({"run": k, "y_true": y, "score": score(z)})

    rows = base.join(permuted_values(base, features, n_repeats, seed), "pos").select(
        *[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("int").alias("y"), "values")
    auc = {r["run"]: r["roc_auc"] for r in roc_auc(rows.mapInPandas(scores, "run int, y_true int, score double"), ["run"], n).collect()}
    out = []
    for j, f in enumerate(features):
        mine = [auc.get(j * n_repeats + r) for r in range(n_repeats)]
        known = auc.get(-1) is not None and all(v is not None for v in mine)
        out.append((f, auc[-1] - sum(mine) / n_repeats if known else None))
    return train.sparkSession.createDataFrame(out, "feature string, importance double")


# ---------------------------------------------------------------- FS-10 / FS-11 / FS-12 / FS-13
def _fit(train, feats, name, params, seed, target, n=None, weighted=None):
    """Fit ``name`` on ``feats``; ``weighted`` is ``train`` with class weights already attached."""
    n = n if n is not None else train.count()
    if name == "adaboost":
        d = ml.assemble(train, feats)
    else:
        d = ml.assemble(weighted if weighted is not None else ml.class_weights(train, target), feats)
    return ml.make_estimator(name, ml.BINARY, {**params, "n_rows": n}, seed,
                             weight=None if name == "adaboost" else "weight").fit(d)


def _auc(model, test, feats, name, target, n_test=None):
    pr = ml.predict_scores(model, ml.assemble(test, feats), name)
    return roc_auc(pr.select(F.lit(0).alias("run_"), "id", F.col(target).cast("int").alias("y_true"), "score"),
                   ["run_"], n_test).first()["roc_auc"]


def _rfe_path(train, test, feats, name, params, seed, target, min_features):
    """Eliminate the weakest feature one at a time; score each size on ``test``."""
    feats = list(feats)
    out = []
    n = train.count()
    n_test = test.count() if test is not None else None
    weighted = ml.class_weights(train, target).cache()
    while True:
        model = _fit(train, feats, name, params, seed, target, n, weighted)
        if test is not None:
            out.append((len(feats), _auc(model, test, feats, name, target, n_test)))
        if len(feats) <= min_features:
            weighted.unpersist()
            return out, feats, model
        imp = ml.feature_importance(model, feats)
        weakest = min(imp, key=lambda t: (t[1], -feats.index(t[0])))[0]
        feats.remove(weakest)


def _logistic_paths(rows: DataFrame, n_features: int, params: dict, keys, min_features: int, n: int) -> list[tuple[list[tuple[int, float]], list[int], np.ndarray]]:
    """The elimination paths of all folds side by side: one batch of fits a size. For each key (a fold, or None: all rows, no
    scores) the scores by size, the features left and their coefficients."""
    active = [list(range(n_features)) for _ in keys]
    scores: list[list] = [[] for _ in keys]
    while True:
        problems = [ml._problem(params, k, tuple(a)) for k, a in zip(keys, active)]
        coef = fit_many(rows, problems, n_features, max_iter=min(int(params.get("max_iter", 100)), 200))
        size = len(active[0])
        if keys[0] is not None:
            auc = {r["run"]: r["roc_auc"] for r in roc_auc(held_out_margins(rows, problems, coef), ["run"], n).collect()}
            for q in range(len(keys)):
                scores[q].append((size, auc.get(q)))
        if size <= min_features:
            return [(scores[q], active[q], coef[q]) for q in range(len(keys))]
        for q, feats in enumerate(active):
            feats.remove(min(feats, key=lambda j: (abs(coef[q, j]), -feats.index(j))))


def rfecv(train: DataFrame, features, name: str, params: dict | None = None, target: str = "target", n_splits: int = 3,
          seed: int = 0, min_features: int = 2, n_repeats: int = 1, grid: dict | None = None):
    """FS-10: recursive elimination with cross-validated scores per size; returns
    (features best first, curve DataFrame (n_features, mean_score, std_score)).

    With a ``grid`` the model's parameters are first chosen by a grid search over the same folds; ``n_repeats``
    repeats the folds. Logistic paths advance together, one batch of fits a size; the others run as concurrent jobs."""
    params = params or {}
    base = train.cache()
    folds = repeated_stratified_kfold(base.select("id", target), n_splits, n_repeats, seed, target=target).select("id", "repeat", "fold").cache()
    if grid:
        _, best, _ = ml.grid_search(base, features, name, grid, folds, seed=seed, label=target)
        params = {**params, **{k: v for k, v in best.items() if k != "n_rows"}}
    keys, together = [(r, k) for r in range(n_repeats) for k in range(n_splits)], name == "logistic_regression"
    features = list(features)
    if together:
        table = fold_table(ml.assemble(base, features), "features", target, folds)
        paths = [p for p, _, _ in _logistic_paths(table, len(features), params, keys, min_features, table.count())]
    else:
        d = base.join(folds, "id").cache()

        def one(item):
            repeat, k = item
            mine = d.where(F.col("repeat") == repeat)
            return _rfe_path(mine.where(F.col("fold") != k), mine.where(F.col("fold") == k), features, name, params, seed, target,
                             min_features)[0]
        paths = ml.concurrently(train.sparkSession, one, keys)
        d.unpersist()
    folds.unpersist()
    per = {}
    for path in paths:
        for size, s in path:
            per.setdefault(size, []).append(s if s is not None else float("nan"))
    rows = []
    for size in sorted(per):
        v = [x for x in per[size] if x == x]
        mean = sum(v) / len(v) if v else None
        std = (sum((x - mean) ** 2 for x in v) / len(v)) ** 0.5 if v else None
        rows.append((size, mean, std))
    best = max(rows, key=lambda r: (r[1] if r[1] is not None else -1.0, -r[0]))[0]
    if together:
        _, kept, coef = _logistic_paths(table, len(features), params, [None], best, 0)[0]
        kept, imp = [features[j] for j in kept], {features[j]: abs(coef[j]) for j in kept}
    else:
        _, kept, model = _rfe_path(base, None, features, name, params, seed, target, best)
        imp = dict(ml.feature_importance(model, kept))
    base.unpersist()
    ordered = sorted(kept, key=lambda f: (-imp[f], kept.index(f)))
    curve = train.sparkSession.createDataFrame(rows, "n_features int, mean_score double, std_score double")
    return ordered, curve


def importance_table(train: DataFrame, features, name: str, params: dict | None = None, target: str = "target",
                     seed: int = 0) -> DataFrame:
    """FS-12: (feature, importance) of one fitted model (tree importances or |coefficients|)."""
    model = _fit(train, features, name, params or {}, seed, target)
    return train.sparkSession.createDataFrame(ml.feature_importance(model, features), "feature string, importance double")


# ---------------------------------------------------------------- FS-8
def gbt_recursive_importance(train: DataFrame, features, target: str = "target", seed: int = 0, top_frac: float = 0.5,
                             n_iter: int = 10) -> list[str]:
    """FS-8: boosted-tree importances on shrinking feature sets; the union of each round's top
    features, in order of first selection."""
    feats = list(features)
    chosen: list[str] = []
    while len(feats) >= 2:
        model = _fit(train, feats, "xgboost", {"n_estimators": n_iter, "max_depth": 3}, seed, target)
        imp = sorted(ml.feature_importance(model, feats), key=lambda t: (-t[1], feats.index(t[0])))
        keep = max(1, int(len(feats) * top_frac))
        for f, v in imp[:keep]:
            if v > 0 and f not in chosen:
                chosen.append(f)
        feats = [f for f, _ in imp[:keep]]
        if keep == len(imp):
            break
    return chosen


MODEL_STEPS = {
    "univariate_ranking": lambda tr, feats, p: [r["feature"] for r in univariate_ranking(
        tr, feats, p.get("target", "target"), p.get("univariate_thresh", 0.0)).orderBy(F.desc("score"), "feature").collect()],
    "gbt_recursive_importance": lambda tr, feats, p: gbt_recursive_importance(tr, feats, p.get("target", "target")),
    **{f"fr_{m}": (lambda m: lambda tr, feats, p: rfecv(tr, feats, m, p.get("params", {}).get(m, {}),
                                                        p.get("target", "target"))[0])(m)
       for m in ("logistic_regression", "forest", "extreme_forest", "adaboost", "xgboost")},
}
