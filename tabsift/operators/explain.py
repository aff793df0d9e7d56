"""Explanation (XP-2…XP-4): Shapley values and coefficient tables.

The value of a coalition is the model's mean class-1 score over background rows,
with the coalition's features taken from the explained row. Up to
``EXACT_FEATURES`` features all 2^k coalitions are scored and the values are exact
sums (coalitions are matrices inside an Arrow batch, no row is exploded); beyond, 2k + 2048 coalitions drawn once for all
rows are fitted by the kernel-weighted least squares whose solution adds up to
f(x) − f(background). For a linear score there is a closed form.
"""

from __future__ import annotations

import random
from math import comb, factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.portable import hash52
from .batch_scores import probability

#: Features up to which all coalitions are scored.
EXACT_FEATURES = 11
#: Rows that a task scores at once.
SCORED_ROWS = 1 << 14
#: Background rows (those with the least md5 of their key) over which a coalition's value is averaged.
BACKGROUND_ROWS = 100


def coalitions(k: int, count: int | None = None, seed: int = 0) -> list[int]:
    """Bit masks: all 2^k, or empty, full and ``count`` others: sizes from the outside in as long as all
    subsets of a size fit, then draws by the kernel's weight of their size, each with its complement."""
    full = (1 << k) - 1
    if count is None or count >= full - 1:
        return list(range(full + 1))
    out, left, rng = {0, full}, count, random.Random(seed)
    sizes = list(range(1, k // 2 + 1))
    while sizes:
        s = sizes[0]
        both = comb(k, s) * (1 if 2 * s == k else 2)
        if both > left:
            break
        from itertools import combinations
        for bits in combinations(range(k), s):
            mask = sum(1 << b for b in bits)
            out |= {mask, full ^ mask}
        left -= both
        sizes.pop(0)
    weights = [(k - 1) / (s * (k - s)) for s in sizes]
    while sizes and len(out) < count + 2:
        s = rng.choices(sizes, weights)[0]
        mask = sum(1 << b for b in rng.sample(range(k), s))
        out |= {mask, full ^ mask}
    return sorted(out)


def kernel_solution(masks: list[int], k: int) -> np.ndarray:
    """A k × masks matrix that turns the coalitions' values into Shapley values by kernel-weighted least squares
    under the constraint that they add up to v(all) − v(none)."""
    z = np.array([[m >> j & 1 for j in range(k)] for m in masks], dtype=float)
    size = z.sum(axis=1)
    inner = (size > 0) & (size < k)
    w = np.array([(k - 1) / (comb(k, int(s)) * s * (k - s)) if 0 < s < k else 0.0 for s in size])
    none, full = masks.index(0), masks.index((1 << k) - 1)
    # eliminate the last feature: phi_last = (v_full - v_none) - sum of the others
    x = z[:, :-1] - z[:, -1:]
    target = np.eye(len(masks))
    target[:, none] -= 1.0                       # v(S) - v(none)
    target[:, full] -= z[:, -1]                  # less the last feature's share of the whole
    target[:, none] += z[:, -1]
    xw = x[inner] * w[inner, None]
    beta = np.linalg.lstsq(xw.T @ x[inner], xw.T @ target[inner], rcond=None)[0]
    whole = np.zeros(len(masks))
    whole[full], whole[none] = 1.0, -1.0
    return np.vstack([beta, whole - beta.sum(axis=0)])


def exact_solution(k: int) -> np.ndarray:
    """The same matrix for all 2^k coalitions, by the definition."""
    out = np.zeros((k, 1 << k))
    for mask in range(1 << k):
        s = mask.bit_count()
        for j in range(k):
            if mask >> j & 1:
                out[j, mask] = factorial(s - 1) * factorial(k - s) / factorial(k)
            else:
                out[j, mask] = -factorial(s) * factorial(k - s - 1) / factorial(k)
    return out


def shapley_values(model, name: str, test: DataFrame, background: DataFrame, features, key: str = "id",
                   background_rows: int = BACKGROUND_ROWS, samples: int | None = None, seed: int = 0,
                   both_classes: bool = False) -> DataFrame:
    """XP-2: (id, feature, phi) for the class-1 probability of ``model``; with ``both_classes`` also a
    ``class`` column, where class 0 has the opposite values. ``samples``: coalitions beyond the exact range
    (2k + 2048 unless given)."""
    features = list(features)
    k = len(features)
    exact = k <= EXACT_FEATURES
    masks = coalitions(k, None if exact else (samples or 2 * k + 2048), seed)
    rows = (background.select(*features, hash52(F.col(key), F.lit("background")).alias("_h"), F.col(key).alias("_k"))
            .orderBy("_h", "_k").limit(background_rows).collect())  # a bounded sample
    base = [[None if r[f] is None else float(r[f]) for f in features] for r in rows]
    solve = exact_solution(k) if exact else kernel_solution(masks, k)
    score = probability(test.sparkSession, model)
    chosen = np.array([[m >> j & 1 for j in range(k)] for m in masks], dtype=bool)
    against = np.array(base, dtype=float).reshape(-1, k)
    per = max(1, SCORED_ROWS // max(len(against), 1))  # coalitions scored at once

    def values(batches):
        for pdf in batches:
            out = []
            for x in pdf[features].to_numpy(dtype=float):
                v = [score(np.where(chosen[i:i + per, None, :], x, against[None]).reshape(-1, k)).reshape(-1, len(against)).mean(axis=1)
                     for i in range(0, len(masks), per)]
                out.append(solve @ np.concatenate(v))
            yield pd.DataFrame({key: pdf[key], "phi": [o.tolist() for o in out]})

    if not len(against):
        raise ValueError("no background rows")
    schema = T.StructType([test.schema[key], T.StructField("phi", T.ArrayType(T.DoubleType()))])
    shares = test.select(key, *[F.col(f).cast("double").alias(f) for f in features]).mapInPandas(values, schema)
    names = F.array(*[F.lit(f) for f in features])
    phi = shares.select(key, F.inline(F.arrays_zip(names.alias("feature"), F.col("phi"))))
    if not both_classes:
        return phi
    return phi.select("*", F.explode(F.array(F.lit(1), F.lit(0))).alias("class")).withColumn(
        "phi", F.when(F.col("class") == 1, F.col("phi")).otherwise(-F.col("phi")))


def linear_shapley(model, test: DataFrame, background: DataFrame, features, key: str = "id") -> DataFrame:
    """XP-2 for a linear score: phi = coefficient · (x − mean over all background rows), exactly."""
    features = list(features)
    means = background.agg(*[F.avg(f).alias(f) for f in features]).first()
    coef = model.coefficients.toArray()
    parts = [F.struct(F.lit(f).alias("feature"), (F.lit(float(c)) * (F.col(f) - F.lit(means[f]))).alias("phi")) for f, c in zip(features, coef)]
    return test.select(key, F.inline(F.array(*parts)))


def shap_summary(phi: DataFrame) -> DataFrame:
    """XP-3: mean |phi| per feature (bar chart), best first."""
    return phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))


def shap_heatmap(phi: DataFrame, features, key: str = "id") -> DataFrame:
    """XP-3: one row per explained row, one column per feature, and the row's total (heatmap table)."""
    wide = phi.groupBy(key).pivot("feature", list(features)).agg(F.first("phi"))
    return wide.withColumn("total", sum((F.col(f) for f in features), F.lit(0.0)))


def coefficients_table(spark: SparkSession, model, features) -> DataFrame:
    """XP-4: logistic coefficients per feature plus the intercept."""
    rows = [(f, float(c)) for f, c in zip(features, model.coefficients.toArray())] + [("(intercept)", float(model.intercept))]
    return spark.createDataFrame(rows, "feature string, coefficient double")
