"""Normalisers: fit on train, apply the same parameters to train and test (NO-*).

Only features with more than ``max_levels`` (3) distinct train values are
scaled; the target is never touched. Most scalers are ``(x - shift) / scale``
with a zero scale replaced by 1; their parameters are one small table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import levels_up_to, to_long
from .positions import exact_quantile_grid, quantile_columns, small_side

BOUNDS = 1e-7  # fixed value: closeness to the range ends of the quantile map

SCALERS = ("l1_norm", "l2_norm", "z_score_norm", "min_max_norm", "max_abs_norm", "robust_norm",
           "quantile_norm", "power_norm")


def _train(df: DataFrame, part_col: str = "part") -> DataFrame:
    return df.where(F.col(part_col) == "train") if part_col in df.columns else df


def scalable_features(train: DataFrame, features, by=(), max_levels: int = 3) -> list[str]:
    """Features with more than ``max_levels`` distinct values in train (in every by-group)."""
    rows = levels_up_to(train, features, max_levels, by).collect()  # (by-groups ×) features rows
    low = {r["feature"] for r in rows if r["n_levels"] <= max_levels}
    present = {r["feature"] for r in rows}
    return [f for f in features if f in present and f not in low]


def fit_linear(train: DataFrame, features, method: str, by=()) -> DataFrame:
    """Parameters (by, feature, shift, scale) of the linear scalers."""
    by = list(by)
    long = to_long(train, by, features).where(F.col("value").isNotNull())
    v = F.col("value")
    if method == "robust_norm":
        q = quantile_columns(long, [*by, "feature"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
        params = q.select(*by, "feature", F.col("q50").alias("shift"), (F.col("q75") - F.col("q25")).alias("scale"))
    else:
        g = long.groupBy(*by, "feature")
        if method == "z_score_norm":
            params = g.agg(F.avg(v).alias("shift"), F.stddev_pop(v).alias("scale"))
        elif method == "min_max_norm":
            params = g.agg(F.min(v).alias("shift"), (F.max(v) - F.min(v)).alias("scale"))
        elif method == "max_abs_norm":
            params = g.agg(F.lit(0.0).alias("shift"), F.max(F.abs(v)).alias("scale"))
        elif method == "l1_norm":
            params = g.agg(F.lit(0.0).alias("shift"), F.sum(F.abs(v)).alias("scale"))
        elif method == "l2_norm":
            params = g.agg(F.lit(0.0).alias("shift"), F.sqrt(F.sum(v * v)).alias("scale"))
        else:
            raise ValueError(f"not a linear scaler: {method}")
    return params.select(*by, "feature", F.col("shift").cast("double").alias("shift"),
                         F.when(F.col("scale") == 0, F.lit(1.0)).otherwise(F.col("scale")).cast("double").alias("scale"))


def apply_linear(df: DataFrame, params: DataFrame, features, by=()) -> DataFrame:
    """(x - shift) / scale with the fitted parameters (literals or a broadcast row per by-key)."""
    by = list(by)
    feats = set(features)
    if not by:
        p = {r["feature"]: (r["shift"], r["scale"]) for r in params.collect()}
        return df.select(*[((F.col(c) - F.lit(p[c][0])) / F.lit(p[c][1])).alias(c) if c in feats and c in p
                           else F.col(c) for c in df.columns])
    wide = params.groupBy(*by).pivot("feature", list(features)).agg(
        F.first("shift").alias("s"), F.first("scale").alias("k"))
    j = df.join(small_side(wide), by, "left")
    return j.select(*[((F.col(c) - F.col(f"{c}_s")) / F.col(f"{c}_k")).alias(c) if c in feats else F.col(c)
                      for c in df.columns])


def normalise(df: DataFrame, features, method: str = "z_score_norm", by=(), part_col: str = "part",
              max_levels: int = 3) -> tuple[DataFrame, list[str]]:
    """NO-9: fit on the train part, apply to every row. Returns (frame, scaled features)."""
    if method not in SCALERS:
        raise ValueError(f"unknown normaliser {method!r}")
    train = _train(df, part_col)
    chosen = scalable_features(train, features, by, max_levels)
    if not chosen:
        return df, []
    if method == "quantile_norm":
        return quantile_norm(df, chosen, by, part_col), chosen
    if method == "power_norm":
        from .power import power_norm
        return power_norm(df, chosen, by, part_col), chosen
    params = fit_linear(train, chosen, method, by)
    return apply_linear(df, params, chosen, by), chosen


# ---------------------------------------------------------------- NO-7
def fit_quantile_grid(train: DataFrame, features, by=(), n_quantiles: int = 1000) -> DataFrame:
    """Quantiles of train at min(n_quantiles, n_train) evenly spaced references."""
    by = list(by)
    long = to_long(train, by, features).where(F.col("value").isNotNull())
    n_train = train.count()
    m = max(2, min(n_quantiles, n_train))
    return exact_quantile_grid(long, [*by, "feature"], "value", m, out="qv").withColumnRenamed("prob", "ref")


def _quantile_map_udf(qs, refs):
    """Arrow-batched map of one column through a quantile grid (forward and backward
    linear interpolation averaged; values within BOUNDS of the range ends → 0 / 1)."""
    q = np.asarray(qs, dtype="float64")
    r = np.asarray(refs, dtype="float64")

    @F.pandas_udf("double")
    def qmap(x: pd.Series) -> pd.Series:
        v = x.to_numpy(dtype="float64", na_value=np.nan)
        out = 0.5 * (np.interp(v, q, r) - np.interp(-v, -q[::-1], -r[::-1]))
        out = np.where(v - BOUNDS < q[0], 0.0, out)
        out = np.where(v + BOUNDS > q[-1], 1.0, out)
        out = np.where(np.isnan(v), np.nan, out)
        return pd.Series(np.clip(out, 0.0, 1.0)).where(~np.isnan(v), None)

    return qmap


def quantile_norm(df: DataFrame, features, by=(), part_col: str = "part", n_quantiles: int = 1000) -> DataFrame:
    """NO-7: map each value to [0, 1] through the train quantiles, interpolating linearly.

    The grid (≤ n_quantiles exact quantiles per feature, linear interpolation)
    is fitted on train by Spark; the map itself is a vectorised pandas UDF per
    feature (Arrow batches, map-only, no shuffle) that averages the forward and
    backward interpolation, so a repeated quantile value maps to the middle of
    its references; values within 1e-7 of the train range ends map to 0 or 1.
    """
    if by:
        raise NotImplementedError("quantile_norm fits one grid; split by key first")
    grid = fit_quantile_grid(_train(df, part_col), features, by, n_quantiles)
    per = {}
    for r in grid.collect():  # at most n_quantiles rows per feature
        per.setdefault(r["feature"], []).append((float(r["ref"]), float(r["qv"])))
    exprs = []
    for c in df.columns:
        if c in per:
            g = sorted(per[c])
            exprs.append(_quantile_map_udf([qv for _, qv in g], [ref for ref, _ in g])(F.col(c)).alias(c))
        else:
            exprs.append(F.col(c))
    return df.select(*exprs)
