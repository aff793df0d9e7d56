"""Feature selection (FS-*): statistics-driven selectors and rank bookkeeping.

Every selector returns an ordered feature list (best first) and, where the
reference exposes it, the table behind the decision. The statistics are
Spark aggregates; only p-sized or p×p tables reach the driver (for the
greedy steps), never rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import levels_map, to_long
from .stats import corr_columns, pair_corr


# ---------------------------------------------------------------- FS-1
def variance_table(df: DataFrame, features, by=()) -> DataFrame:
    """(by, feature, var) population variance of the non-missing values."""
    by = list(by)
    return (to_long(df, by, features).groupBy(*by, "feature")
            .agg(F.var_pop("value").alias("var")))


def variance_threshold(df: DataFrame, features, p: float = 0.99) -> list[str]:
    """FS-1: keep features whose population variance exceeds p·(1−p) (column order kept)."""
    thr = p * (1 - p)
    got = {r["feature"]: r["var"] for r in variance_table(df, features).collect()}
    return [f for f in features if got.get(f) is not None and got[f] > thr]


# ---------------------------------------------------------------- FS-2
def target_corr_ranking(df: DataFrame, features, target: str = "target", method: str = "pearson",
                        key: str = "id", pairs: DataFrame | None = None) -> DataFrame:
    """FS-2: (rank, feature, abs_corr) with abs_corr = |round(r, 2)| descending.

    Ties keep column order; columns without a correlation (constant) rank last.
    ``pairs`` may pass a precomputed ``pair_corr`` over features + target.
    """
    pos = {f: i for i, f in enumerate(features)}
    pc = pairs if pairs is not None else pair_corr(df, list(features) + [target], method, key)
    pc = pc.where((F.col("b") == target) & F.col("a").isin(list(features)))
    order = F.create_map(*[x for f, i in pos.items() for x in (F.lit(f), F.lit(i))])
    t = pc.select(F.col("a").alias("feature"), F.abs(F.round("r", 2)).alias("abs_corr"))
    w = Window.orderBy(F.desc_nulls_last("abs_corr"), order[F.col("feature")])  # p rows: one small task
    return t.select(F.row_number().over(w).cast("bigint").alias("rank"), "feature", "abs_corr")


def target_corr_by(df: DataFrame, features, by, target: str = "target") -> DataFrame:
    """(by…, feature, r): Pearson r of each feature with the target per by-group (pairwise complete).

    Long form with one aggregate per (by, feature): partial aggregation keeps the
    shuffle at groups × features rows whatever the row count.
    """
    by = list(by)
    long = to_long(df, [*by, target], features).where(F.col("value").isNotNull() & F.col(target).isNotNull())
    _, r = corr_columns(F.col("value"), F.col(target))
    return long.groupBy(*by, "feature").agg(r.alias("r"))


def ranked_by_target_corr(df: DataFrame, features, by, target: str = "target", job: str = "corr_rank") -> DataFrame:
    """(by…, job, rank, feature): per by-group ranking by |round(r, 2)|, column order on ties."""
    by = list(by)
    pos = {f: i for i, f in enumerate(features)}
    order = F.create_map(*[x for f, i in pos.items() for x in (F.lit(f), F.lit(i))])
    t = target_corr_by(df, features, by, target).withColumn("abs_corr", F.abs(F.round("r", 2)))
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last("abs_corr"), order[F.col("feature")])  # p rows per group
    return t.select(*by, F.lit(job).alias("job"), F.row_number().over(w).cast("bigint").alias("rank"), "feature")


def rank_by_target_corr(df: DataFrame, features, target: str = "target", method: str = "pearson") -> list[str]:
    return [r["feature"] for r in target_corr_ranking(df, features, target, method).orderBy("rank").collect()]


# ---------------------------------------------------------------- FS-4
def correlation_drops(pairs: DataFrame, importance: DataFrame, thresh: float = 0.95) -> DataFrame:
    """FS-4 core as a query: features with a better-ranked partner whose |round(r,2)| > thresh.

    ``pairs`` is a ``pair_corr`` table, ``importance`` has (rank, feature). The
    rule is not greedy: a partner counts even when it is itself dropped.
    """
    pc = pairs.select("a", "b", F.abs(F.round("r", 2)).alias("ar"))
    both = pc.unionByName(pc.select(F.col("b").alias("a"), F.col("a").alias("b"), "ar"))
    imp = F.broadcast(importance.select("feature", "rank"))  # p rows
    x = (both.join(imp.withColumnRenamed("feature", "a").withColumnRenamed("rank", "rank_a"), "a")
         .join(imp.withColumnRenamed("feature", "b").withColumnRenamed("rank", "rank_b"), "b"))
    return (x.where((F.col("rank_b") < F.col("rank_a")) & (F.col("ar") > thresh))
            .select(F.col("a").alias("feature")).distinct())


def correlation_filter(df: DataFrame, features, target: str = "target", thresh: float = 0.95,
                       method: str = "pearson", key: str = "id") -> tuple[list[str], DataFrame]:
    """FS-4: drop features too correlated with a better-ranked one; remaining in column order.

    One pass of pairwise moments over features + target serves both the
    ranking and the pair table (p² rows, cached).
    """
    pairs = pair_corr(df, list(features) + [target], method, key).cache()
    ranking = target_corr_ranking(df, features, target, method, key, pairs=pairs)
    feat_pairs = pairs.where(F.col("b") != target)
    dropped = {r["feature"] for r in correlation_drops(feat_pairs, ranking, thresh).collect()}
    return [f for f in features if f not in dropped], ranking


# ---------------------------------------------------------------- FS-5 / FS-6
def loo_target_encode(df: DataFrame, features, target: str = "target") -> DataFrame:
    """Leave-one-out target encoding of the given columns (mean target of the other rows
    with the same value; the overall mean where a value occurs once)."""
    out = df
    mean_all = df.agg(F.avg(target)).first()[0]
    for f in features:
        stats = df.groupBy(f).agg(F.sum(target).alias(f"_sy_{f}"), F.count(F.lit(1)).alias(f"_n_{f}"))
        out = out.join(F.broadcast(stats), f, "left")  # one row per level (≤ max_levels)
        enc = F.when(F.col(f).isNull(), F.lit(None).cast("double")).when(
            F.col(f"_n_{f}") > 1,
            (F.col(f"_sy_{f}") - F.col(target)) / (F.col(f"_n_{f}") - 1)).otherwise(F.lit(mean_all))
        out = out.withColumn(f, enc).drop(f"_sy_{f}", f"_n_{f}")
    return out


def anova_f(df: DataFrame, features, target: str = "target") -> DataFrame:
    """(feature, f): one-way ANOVA F of each feature across target classes (one pass of sums)."""
    long = to_long(df, [target], features).where(F.col("value").isNotNull())
    cls = long.groupBy("feature", target).agg(
        F.count(F.lit(1)).cast("double").alias("nc"), F.avg("value").alias("mc"),
        (F.var_pop("value") * F.count(F.lit(1))).alias("wc"))
    w = Window.partitionBy("feature")  # classes of one feature
    cls = cls.withColumn("m", F.sum(F.col("nc") * (F.col("mc") - F.min("mc").over(w))).over(w) / F.sum("nc").over(w) + F.min("mc").over(w))
    g = cls.groupBy("feature").agg(
        F.sum("nc").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("wc").alias("ss_within"),
        F.sum(F.col("nc") * (F.col("mc") - F.col("m")) * (F.col("mc") - F.col("m"))).alias("ss_between"))
    f = F.try_divide(F.try_divide(F.col("ss_between"), F.col("k") - 1), F.try_divide(F.col("ss_within"), F.col("n") - F.col("k")))
    return g.select("feature", F.when(F.col("k") > 1, f).alias("f"))


def regression_f(df: DataFrame, features, target: str = "target") -> DataFrame:
    """(feature, f): F of a simple regression on the target, r²/(1−r²)·(n−2)."""
    long = to_long(df, [target], features).where(F.col("value").isNotNull() & F.col(target).isNotNull())
    n, r = corr_columns(F.col("value"), F.col(target))
    m = long.groupBy("feature").agg(n.alias("n"), r.alias("r"))
    return m.select("feature", (F.try_divide(F.col("r") * F.col("r"), 1 - F.col("r") * F.col("r")) * (F.col("n") - 2)).alias("f"))


def mrmr(df: DataFrame, features, k: int, target: str = "target", task: str = "binary_classification",
         max_levels: int = 5, floor: float = 0.001, key: str = "id") -> list[str]:
    """FS-5 / FS-6: greedy max-relevance / min-redundancy (relevance ÷ mean |r| with chosen).

    Columns with ≤ ``max_levels`` distinct values are leave-one-out target encoded
    first. Relevance (F) and all |r| are Spark aggregates; the K-step greedy loop
    runs on the p × p table on the driver.
    """
    prof = levels_map(df, features, max_levels)
    cats = [f for f in features if prof[f] <= max_levels]
    enc = loo_target_encode(df, cats, target) if cats else df
    rel_df = anova_f(enc, features, target) if task == "binary_classification" else regression_f(enc, features, target)
    rel = {r["feature"]: (r["f"] if r["f"] is not None and not math.isnan(r["f"]) else 0.0) for r in rel_df.collect()}
    corr = {}
    for r in pair_corr(enc, features, "pearson", key).collect():
        v = abs(r["r"]) if r["r"] is not None else 0.0
        corr[(r["a"], r["b"])] = corr[(r["b"], r["a"])] = v
    return mrmr_greedy(features, rel, corr, k, floor)


def _leading(v: float, digits: int = 9) -> tuple[int, float]:
    """A positive number by its exponent and leading digits: scores that differ in rounding alone are equal."""
    if not v > 0 or math.isinf(v):
        return (-400 if not v > 0 else 400), 0.0
    e = math.floor(math.log10(v))
    return e, round(v / 10.0 ** e, digits)


def mrmr_greedy(features, rel: dict, corr: dict, k: int, floor: float = 0.001) -> list[str]:
    chosen: list[str] = []
    left = [f for f in features if rel.get(f, 0.0) > 0]
    while left and len(chosen) < k:
        def score(f):
            if not chosen:
                return rel[f]
            red = sum(corr.get((f, g), 0.0) for g in chosen) / len(chosen)
            return rel[f] / max(red, floor)
        best = max(left, key=lambda f: (*_leading(score(f)), -features.index(f)))
        chosen.append(best)
        left.remove(best)
    return chosen


# ---------------------------------------------------------------- FS-7
def binned_mutual_info(df: DataFrame, features, target: str = "target", bins: int = 10) -> DataFrame:
    """(feature, mi): mutual information (nats) between equal-width bins of a feature and the target."""
    long = to_long(df, [target], features).where(F.col("value").isNotNull())
    mm = long.groupBy("feature").agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    j = long.join(F.broadcast(mm), "feature")  # one row per feature
    width = F.col("mx") - F.col("mn")
    b = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("mn")) / width * bins), F.lit(bins - 1))).otherwise(0)
    cell = j.withColumn("bin", b.cast("bigint")).groupBy("feature", "bin", target).agg(F.count(F.lit(1)).alias("nby"))
    wf = Window.partitionBy("feature")
    cell = (cell.withColumn("n", F.sum("nby").over(wf))
            .withColumn("nb", F.sum("nby").over(Window.partitionBy("feature", "bin")))
            .withColumn("ny", F.sum("nby").over(Window.partitionBy("feature", target))))
    term = (F.col("nby") / F.col("n")) * F.log(F.col("nby") * F.col("n") / (F.col("nb") * F.col("ny")))
    return cell.groupBy("feature").agg(F.sum(term).alias("mi"))


def sulov_table(df: DataFrame, features, target: str = "target", limit: float = 0.95, key: str = "id") -> DataFrame:
    """FS-7: (feature, mi, kept). Among pairs with |r| > limit the member with the smaller
    mutual information (compared at 9 decimals; the earlier column on ties) is dropped."""
    from ..functions.portable import rhalf
    mi_df = binned_mutual_info(df, features, target).withColumn("mi9", rhalf("mi", 9))
    mi = {r["feature"]: (r["mi9"], r["mi"]) for r in mi_df.collect()}  # one row per feature
    drop = set()
    for r in pair_corr(df, features, "pearson", key).where(F.abs("r") > limit).collect():  # pairs above the limit
        a, b = r["a"], r["b"]
        ka = (mi.get(a, (0.0, 0.0))[0], -features.index(a))
        kb = (mi.get(b, (0.0, 0.0))[0], -features.index(b))
        drop.add(b if ka > kb else a)
    return mi_df.select("feature", "mi", (~F.col("feature").isin(sorted(drop))).alias("kept"))


def sulov(df: DataFrame, features, target: str = "target", limit: float = 0.95, key: str = "id") -> list[str]:
    """FS-7 as a feature list, best mutual information first."""
    rows = sulov_table(df, features, target, limit, key).where("kept").collect()
    return [r["feature"] for r in sorted(rows, key=lambda r: (-r["mi"], features.index(r["feature"])))]


# ---------------------------------------------------------------- FS-14 / FS-15
def feature_points(selected: DataFrame) -> DataFrame:
    """FS-14: rank 1..10 → 10..1 points, later ranks 1; summed per (job, feature).

    ``selected`` has (seed, boot, job, rank, feature) with rank starting at 1.
    """
    pts = F.greatest(F.lit(11) - F.col("rank"), F.lit(1)).cast("bigint")
    return selected.groupBy("job", "feature").agg(F.sum(pts).cast("bigint").alias("points"))


def avg_feature_ranking(selected: DataFrame, top: int | None = None) -> DataFrame:
    """FS-15: points ÷ total points of the job, best first (pos), optionally the top slice."""
    pts = feature_points(selected)
    wj = Window.partitionBy("job")
    out = (pts.withColumn("share", F.col("points") / F.sum("points").over(wj))
           .withColumn("pos", F.row_number().over(wj.orderBy(F.desc("points"), "feature")).cast("bigint")))
    return out.where(F.col("pos") <= top) if top else out
