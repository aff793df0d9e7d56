"""Profiling and exploration: the tables behind the reference's plots (EX-*)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import drop_low_cardinality
from .frames import levels_map, to_long
from .impute import apply_fill, fit_median
from .positions import quantile_columns
from .scale import apply_linear, fit_linear
from .stats import distances, pair_corr

WHISKERS = 1.5


def explore_prepare(df: DataFrame, features, target: str = "target") -> tuple[DataFrame, list[str]]:
    """EX-1: median impute (fit on all rows) → drop binary and constant → z-score → target re-attached."""
    filled = apply_fill(df, fit_median(df, features), features)
    prof = levels_map(filled, features, 2)
    kept = [f for f in features if prof[f] not in (1, 2)]
    out = drop_low_cardinality(filled, features, (1, 2), prof)
    if kept:
        out = apply_linear(out, fit_linear(out, kept, "z_score_norm"), kept)
    return out.select(*[c for c in out.columns if c != target], target), kept


def corr_to_target(df: DataFrame, features, target: str = "target", method: str = "pearson",
                   key: str = "id") -> DataFrame:
    """EX-2: (feature, corr) rounded to 2 places; sort ascending for display."""
    pc = pair_corr(df, list(features) + [target], method, key)
    return pc.where(F.col("b") == target).select(F.col("a").alias("feature"), F.round("r", 2).alias("corr"))


def corr_matrix(df: DataFrame, features, method: str = "pearson", key: str = "id") -> DataFrame:
    """EX-3: full matrix in long form (a, b, r): both orders plus the diagonal.

    Columns with no or one value and rows/columns that are all missing give no entries.
    """
    pc = pair_corr(df, features, method, key).where(F.col("r").isNotNull())
    diag = (pc.select(F.col("a").alias("f")).union(pc.select(F.col("b").alias("f"))).distinct()
            .select(F.col("f").alias("a"), F.col("f").alias("b"), F.lit(1.0).alias("r")))
    return pc.unionByName(pc.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")).unionByName(diag)


def corr_lower_triangle(df: DataFrame, features, method: str = "pearson", key: str = "id") -> DataFrame:
    """EX-4: entries below the diagonal (row position > column position), as the heatmap mask shows."""
    pos = {f: i for i, f in enumerate(features)}
    m = corr_matrix(df, features, method, key)
    order = F.create_map(*[x for f, i in pos.items() for x in (F.lit(f), F.lit(i))])
    return m.where(order[F.col("a")] > order[F.col("b")])


def feature_distance(df: DataFrame, features) -> DataFrame:
    """EX-5: Euclidean distance between feature columns (input of the cluster map)."""
    return distances(df, features)


def target_summary_binary(df: DataFrame, target: str = "target") -> DataFrame:
    """EX-6: positives, n, percent = round(mean, 2) · 100 (as an integer)."""
    return df.agg(
        F.sum(target).cast("bigint").alias("positives"),
        F.count(F.lit(1)).alias("n"),
        (F.round(F.avg(target), 2) * 100).cast("bigint").alias("percent"),
    )


def target_summary_regression(df: DataFrame, target: str = "target", digits: int | None = 2) -> DataFrame:
    """EX-7: describe(): count, mean, sample std, min, median, max (rounded to ``digits``)."""
    one = df.select(F.lit(0).alias("_g"), F.col(target).cast("double").alias("value"))
    med = quantile_columns(one, ["_g"], "value", {"median": 0.5})
    agg = one.groupBy("_g").agg(
        F.count("value").cast("double").alias("count"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    j = agg.join(med, "_g")
    cols = ["count", "mean", "std", "min", "median", "max"]
    return j.select(*[(F.round(c, digits) if digits is not None else F.col(c)).alias(c) for c in cols])


def box_stats(df: DataFrame, features, by=(), key: str = "id") -> DataFrame:
    """EX-9 (EX-8 with ``by=[target]``): quartiles, mean, whisker ends per feature.

    Whiskers reach the most extreme values still inside q1 − 1.5·iqr and q3 + 1.5·iqr.
    """
    by = list(by)
    long = to_long(df, by, features).where(F.col("value").isNotNull())
    q = quantile_columns(long, [*by, "feature"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    lim = q.withColumn("_lo", F.col("q1") - WHISKERS * iqr).withColumn("_hi", F.col("q3") + WHISKERS * iqr)
    j = long.join(F.broadcast(lim), [*by, "feature"])  # one row per (by, feature): bounded
    v = F.col("value")
    agg = j.groupBy(*by, "feature", "q1", "median", "q3").agg(
        F.avg(v).alias("mean"),
        F.min(F.when(v >= F.col("_lo"), v)).alias("whisker_lo"),
        F.max(F.when(v <= F.col("_hi"), v)).alias("whisker_hi"),
        F.count(F.lit(1)).alias("n"))
    return agg


def outlier_limits(df: DataFrame, features, by=()) -> DataFrame:
    """EX-11: (feature, lower, upper) = q1 − 1.5·iqr, q3 + 1.5·iqr (linear-interpolated quartiles)."""
    by = list(by)
    long = to_long(df, by, features).where(F.col("value").isNotNull())
    q = quantile_columns(long, [*by, "feature"], "value", {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.select(*by, "feature", (F.col("q1") - WHISKERS * iqr).alias("lower"),
                    (F.col("q3") + WHISKERS * iqr).alias("upper"))


def drop_outliers(df: DataFrame, features, limits: DataFrame | None = None) -> DataFrame:
    """EX-12: cells at or beyond a limit (x ≤ lower or x ≥ upper) become missing."""
    limits = limits if limits is not None else outlier_limits(df, features)
    lim = {r["feature"]: (r["lower"], r["upper"]) for r in limits.collect()}  # one pair per feature
    out = []
    for c in df.columns:
        if c in lim:
            lo, hi = lim[c]
            x = F.col(c)
            out.append(F.when((x > F.lit(lo)) & (x < F.lit(hi)), x).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def detect_outliers(df: DataFrame, features, key: str = "id") -> DataFrame:
    """EX-13: flagged cells as rows (id, feature, value, lower, upper, side)."""
    lim = outlier_limits(df, features)
    long = to_long(df, [key], features).where(F.col("value").isNotNull())
    j = long.join(F.broadcast(lim), "feature")  # one row per feature: bounded
    v = F.col("value")
    return (j.where((v <= F.col("lower")) | (v >= F.col("upper")))
            .withColumn("side", F.when(v <= F.col("lower"), F.lit("low")).otherwise(F.lit("high"))))


def kde_curve(df: DataFrame, features, grid_size: int = 200, cut: float = 3.0) -> DataFrame:
    """EX-10: Gaussian density per feature on an even grid over [min − cut·h, max + cut·h].

    Bandwidth (Scott): h = sample std · n^(−1/5). Each task keeps one array of grid
    sums per feature and adds its cells to it block by block, so nothing is exploded
    and tasks × features × grid numbers are shuffled.
    """
    long = to_long(df, [], features).where(F.col("value").isNotNull())
    st = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("value").alias("sd"),
        F.min("value").alias("mn"), F.max("value").alias("mx"))
    st = (st.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
          .where(F.col("h") > 0)
          .withColumn("g0", F.col("mn") - cut * F.col("h"))
          .withColumn("step", (F.col("mx") - F.col("mn") + 2 * cut * F.col("h")) / (grid_size - 1)))
    fits = {r["feature"]: (r["h"], r["g0"], r["step"]) for r in st.collect()}  # one row per feature
    names = [f for f in features if f in fits]

    def sums(batches):
        total = np.zeros((len(names), grid_size))
        for pdf in batches:
            for i, f in enumerate(names):
                h, g0, step = fits[f]
                grid = g0 + np.arange(grid_size) * step
                v = pdf[f].to_numpy(dtype="float64")
                v = v[~np.isnan(v)]
                for at in range(0, len(v), 4096):
                    z = (grid[:, None] - v[None, at:at + 4096]) / h
                    total[i] += np.exp(-0.5 * z * z).sum(axis=1)
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"feature": [names[k] for k in i.ravel()], "gi": j.ravel(), "k": total.ravel()})

    x = df.select(*[F.col(f).cast("double").alias(f) for f in names])
    got = x.mapInPandas(sums, "feature string, gi int, k double").groupBy("feature", "gi").agg(F.sum("k").alias("sk"))
    agg = got.join(F.broadcast(st), "feature")  # one row per feature
    return agg.select(
        "feature", F.col("gi").cast("bigint").alias("gi"),
        (F.col("g0") + F.col("gi") * F.col("step")).alias("x"),
        (F.col("sk") / (F.col("n") * F.col("h") * F.lit((2 * 3.141592653589793) ** 0.5))).alias("density"))
