"""Imputation: fit on the train part, apply to train and test (IMP-*).

Fitted values are a small table (by-keys x features). Without by-keys they
are collected (one number per feature) and applied as literals inside one
projection; with by-keys (e.g. per seed) the table is broadcast after a
size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import to_long
from .positions import exact_quantiles, small_side


def _train(df: DataFrame, part_col: str = "part") -> DataFrame:
    return df.where(F.col(part_col) == "train") if part_col in df.columns else df


def fit_median(train: DataFrame, features, by=()) -> DataFrame:
    """IMP-2 fit: exact median per (by, feature); features empty in train get 0."""
    by = list(by)
    long = to_long(train, by, features)
    med = exact_quantiles(long, [*by, "feature"], "value", [0.5], out="fill").drop("prob")
    names = F.explode(F.array(*[F.lit(f) for f in features])).alias("feature")
    keys = train.select(*by).distinct() if by else train.sparkSession.range(1)
    grid = keys.select(*by, names)  # by-keys x features, both bounded by parameters
    return (grid.join(med, [*by, "feature"], "left")
            .select(*by, "feature", F.coalesce("fill", F.lit(0.0)).alias("fill")))


def apply_fill(df: DataFrame, fills: DataFrame, features, by=()) -> DataFrame:
    """Replace missing cells by the fitted value of their (by, feature)."""
    by = list(by)
    if not by:
        vals = {r["feature"]: r["fill"] for r in fills.collect()}
        return df.select(*[F.coalesce(F.col(c), F.lit(float(vals[c]))).alias(c) if c in vals else F.col(c)
                           for c in df.columns])
    wide = fills.groupBy(*by).pivot("feature", list(features)).agg(F.first("fill"))
    wide = wide.select(*by, *[F.col(f).alias(f"_fill_{f}") for f in features])
    j = df.join(small_side(wide), by, "left")
    return j.select(*[F.coalesce(F.col(c), F.col(f"_fill_{c}")).alias(c) if c in set(features) else F.col(c)
                      for c in df.columns])


def simple_impute(df: DataFrame, features, by=(), part_col: str = "part") -> DataFrame:
    """IMP-2: median of train fills train and test."""
    return apply_fill(df, fit_median(_train(df, part_col), features, by), features, by)


def drop_nan_impute(df: DataFrame, features) -> DataFrame:
    """IMP-1: drop rows with a missing feature, in both parts."""
    return df.na.drop("any", subset=list(features))


def missing_indicator(df: DataFrame, features, suffix: str = "_missing") -> DataFrame:
    """IMP-5: add a 0/1 column per feature, 1 where the cell is missing (target untouched)."""
    return df.select("*", *[F.col(f).isNull().cast("double").alias(f"{f}{suffix}") for f in features])


def fit_mean(train: DataFrame, features, by=()) -> DataFrame:
    by = list(by)
    return (to_long(train, by, features).groupBy(*by, "feature")
            .agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("fill")))


IMPUTERS = ("drop_nan_impute", "simple_impute", "missing_indicator", "iterative_impute", "knn_impute")


def impute(df: DataFrame, method: str, features, by=(), part_col: str = "part", seed: int = 0) -> DataFrame:
    """IMP-6: look up the method, reject unknown ones, fit on train, apply to both parts."""
    if method not in IMPUTERS:
        raise ValueError(f"unknown imputer {method!r}; choose one of {IMPUTERS}")
    if method == "drop_nan_impute":
        return drop_nan_impute(df, features)
    if method == "simple_impute":
        return simple_impute(df, features, by, part_col)
    if method == "missing_indicator":
        return missing_indicator(df, features)
    if method == "iterative_impute":
        from .impute_iterative import iterative_impute
        return iterative_impute(df, features, part_col=part_col, seed=seed)
    from .holes import knn_impute
    return knn_impute(df, features, part_col=part_col)
