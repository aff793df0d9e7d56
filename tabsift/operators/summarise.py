"""Result summaries and statistics over per-run scores (RS-*, XP-1).

``scores`` is a long table (experiment, seed, job, n_top, model, metric,
value): one row per run and metric. All reductions are group-bys; "first
wins" ties use ``max(struct(value, -position))`` instead of ordered windows.
"""

from __future__ import annotations

import functools
import itertools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.portable import erf
from . import evaluate as ev
from .positions import exact_quantiles, value_positions

RUN = ev.RUN
CELL = ["experiment", "job", "n_top", "model"]
SCORE_METRICS = ["roc_auc", "average_precision", "recall", "specificity", "precision", "f1", "accuracy",
                 "balanced_accuracy", "pos_rate"]
#: Size of the smaller sample up to which the U test is exact.
EXACT_MAX = 8
# Metrics where lower is better (fixed values).
LOWER_IS_BETTER = ("mean_absolute_error", "mean_squared_error")


def run_scores(pred: DataFrame, run=RUN, threshold: float | None = None, youden: bool = False) -> DataFrame:
    """Per-run metrics in long form (the stored ``scores`` table).

    The threshold metrics are taken at ``threshold``; by default at the score's own
    middle: 0 where ``score_kind`` says margin, else 0.5. ``youden`` takes them at
    each run's Youden threshold instead.
    """
    run = list(run)
    auc = ev.roc_auc(pred, run)
    ap = ev.average_precision(pred, run)
    if youden:
        thr = ev.metrics_at_youden(pred, run)
    elif threshold is None and "score_kind" in pred.columns:
        middle = F.when(F.col("score_kind") == "margin", 0.0).otherwise(0.5)
        thr = ev.threshold_metrics(pred.withColumn("score", F.col("score") - middle), run, 0.0)
    else:
        thr = ev.threshold_metrics(pred, run, 0.5 if threshold is None else threshold)
    pr = ev.pos_rate(pred, run)
    wide = auc.join(ap, run).join(thr.drop("tp", "fp", "tn", "fn"), run).join(pr, run)
    return wide.unpivot(run, SCORE_METRICS, "metric", "value")


def plan_table(seeds: DataFrame, jobs, n_tops, models) -> DataFrame:
    """Planned runs: every seed (with its experiment) × jobs × n_top × models, by explode (no join)."""
    return (seeds.select("experiment", "seed").distinct()
            .withColumn("job", F.explode(F.array(*[F.lit(j) for j in jobs])))
            .withColumn("n_top", F.explode(F.array(*[F.lit(int(n)).cast("bigint") for n in n_tops])))
            .withColumn("model", F.explode(F.array(*[F.lit(m) for m in models]))))


def scores_long(plan: DataFrame, scores: DataFrame) -> DataFrame:
    """RS-1: planned runs that have scores (missing runs are skipped)."""
    return plan.join(scores, RUN, "inner")


def _order_map(values) -> Column:
    return F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(v), F.lit(i))])


def cell_means(scores: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """Mean over seeds of ``metric`` per (experiment, job, n_top, model)."""
    return (scores.where(F.col("metric") == metric)
            .groupBy(*CELL).agg(F.avg("value").alias("mean"), F.count("value").alias("n_seeds")))


def best_n_top(scores: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """RS-2: per (experiment, job, model) the n_top with the best mean; the smallest n_top wins ties."""
    sign = -1.0 if metric in LOWER_IS_BETTER else 1.0
    m = cell_means(scores, metric).where(F.col("mean").isNotNull())
    key = F.struct((F.col("mean") * sign).alias("v"), (-F.col("n_top")).alias("neg_n"), "n_top", "mean")
    g = m.groupBy("experiment", "job", "model").agg(F.max(key).alias("b"))
    return g.select("experiment", "job", "model", F.col("b.n_top").alias("n_top"), F.col("b.mean").alias("mean"))


def best_cells(scores: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """Mean of every (experiment, job, model) at its best n_top."""
    return best_n_top(scores, metric)


def score_matrix(scores: DataFrame, jobs, metric: str = "roc_auc") -> DataFrame:
    """RS-3: model × job table of means at the best n_top (one column per job)."""
    b = best_cells(scores, metric)
    return b.groupBy("experiment", "model").pivot("job", list(jobs)).agg(F.first("mean"))


def best_model_per_job(scores: DataFrame, models, metric: str = "roc_auc") -> DataFrame:
    """RS-4: per (experiment, job) the model with the highest mean; earlier model wins ties."""
    sign = -1.0 if metric in LOWER_IS_BETTER else 1.0
    b = best_cells(scores, metric)
    key = F.struct((F.col("mean") * sign).alias("v"), (-_order_map(models)[F.col("model")]).alias("p"),
                   "model", "n_top", "mean")
    g = b.groupBy("experiment", "job").agg(F.max(key).alias("b"))
    return g.select("experiment", "job", F.col("b.model").alias("model"), F.col("b.n_top").alias("n_top"),
                    F.col("b.mean").alias("mean"))


def best_job_model(scores: DataFrame, models, jobs, metric: str = "roc_auc") -> DataFrame:
    """RS-5: per experiment the best (model, job) cell; row-major first (model, then job) wins ties."""
    sign = -1.0 if metric in LOWER_IS_BETTER else 1.0
    b = best_cells(scores, metric)
    key = F.struct((F.col("mean") * sign).alias("v"), (-_order_map(models)[F.col("model")]).alias("pm"),
                   (-_order_map(jobs)[F.col("job")]).alias("pj"), "model", "job", "n_top", "mean")
    g = b.groupBy("experiment").agg(F.max(key).alias("b"))
    return g.select("experiment", F.col("b.model").alias("model"), F.col("b.job").alias("job"),
                    F.col("b.n_top").alias("n_top"), F.col("b.mean").alias("mean"))


def winner_scores(scores: DataFrame, winners: DataFrame) -> DataFrame:
    """Per-seed scores of each experiment's winning cell (all metrics)."""
    return scores.join(winners.select("experiment", "job", "model", "n_top"), ["experiment", "job", "model", "n_top"])


def experiment_summary(scores: DataFrame, models, jobs, metric: str = "roc_auc") -> DataFrame:
    """RS-6: one row per experiment: winner, n_top, the winner's per-seed values summarised, and per
    metric the list of its values by seed (``values``: metric → values, one entry per seed)."""
    w = best_job_model(scores, models, jobs, metric)
    every = winner_scores(scores, w)
    lists = (every.groupBy("experiment", "metric").agg(F.array_sort(F.collect_list(F.struct("seed", "value"))).alias("v"))
             .groupBy("experiment").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", F.col("v.value"))))).alias("values")))
    ws = every.where(F.col("metric") == metric)
    s = ws.groupBy("experiment").agg(F.count("value").alias("n_values"), F.min("value").alias("min_value"),
                                     F.max("value").alias("max_value"), F.avg("value").alias("mean_value"))
    return w.select("experiment", "job", "model", "n_top").join(s, "experiment").join(lists, "experiment")


def mean_std_results(scores: DataFrame, models, jobs, metric: str = "roc_auc") -> DataFrame:
    """RS-7: for each experiment's winner, mean and population std of every metric over seeds."""
    w = best_job_model(scores, models, jobs, metric)
    ws = winner_scores(scores, w)
    return ws.groupBy("experiment", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


# ---------------------------------------------------------------- Mann–Whitney U
def u_counts(m: int, n: int) -> list[int]:
    """Number of arrangements of m + n ranks giving U = 0..m·n (no ties).

    These are the coefficients of the Gaussian binomial Π (1 − q^(n+i)) / (1 − q^i), i = 1..min(m, n): one loop of
    multiplications and divisions by binomials in q, in whole numbers.
    """
    m, n = min(m, n), max(m, n)
    size = m * n + 1
    out = [0] * size
    out[0] = 1
    for i in range(1, m + 1):
        for k in range(size - 1, n + i - 1, -1):
            out[k] -= out[k - n - i]
        for k in range(i, size):
            out[k] += out[k - i]
    return out


@functools.lru_cache(maxsize=None)
def _sum_differences(m: int) -> tuple[int, list[list[int]]]:
    """(period, for each residue the forward differences) of D(x), the number of multisets of parts 1 … m with sum at most x.

    D restricted to one residue of lcm(1 … m) is a polynomial of degree m, so m + 1 values a residue fix it everywhere.
    """
    period = math.lcm(*range(1, m + 1))
    table = [1] * (period * (m + 1))  # sums of parts of size 1 that fall short of x by nothing or more
    for part in range(1, m + 1):
        for x in range(part, len(table)):
            table[x] += table[x - part]
    out = []
    for r in range(period):
        row, values = [], table[r::period]
        while values:
            row.append(values[0])
            values = [b - a for a, b in itertools.pairwise(values)]
        out.append(row)
    return period, out


def arrangements_up_to(m: int, n: int, t: int) -> int:
    """Number of arrangements of m and n untied ranks with U at most ``t``, in whole numbers; no table over m · n.

    The Gaussian binomial's numerator Π (1 − q^(n+i)) has 2^m terms; each takes D at one place, which is a polynomial's value.
    """
    m, n = min(m, n), max(m, n)
    if t < 0:
        return 0
    if m == 0:
        return 1
    period, differences = _sum_differences(m)

    def multisets(x: int) -> int:
        k = x // period
        return sum(math.comb(k, j) * d for j, d in enumerate(differences[x % period]))

    total = 0
    for size in range(m + 1):
        for chosen in itertools.combinations(range(1, m + 1), size):
            left = t - size * n - sum(chosen)
            if left >= 0:
                total += (-1) ** size * multisets(left)
    return total


def upper_tail(n1: int, n2: int, u: float) -> float:
    """P(U ≥ u) under H0, by the symmetry of U."""
    n1, n2 = int(n1), int(n2)
    return arrangements_up_to(n1, n2, n1 * n2 - max(0, math.ceil(u))) / math.comb(n1 + n2, n1)


def _exact_tail(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:
    held: dict = {}
    for key in set(zip(n1, n2, u)):
        if min(key[:2]) <= EXACT_MAX:  # otherwise not asked for: the normal approximation holds there
            held[key] = upper_tail(*key)
    return pd.Series([held.get(key) for key in zip(n1, n2, u)], dtype="float64")


def mann_whitney(samples: DataFrame, group_cols, exact_max: int | None = None) -> DataFrame:
    """RS-8: two-sided Mann–Whitney U test per group of ``samples`` (group…, sample ∈ {a, b}, value).

    Exact null distribution when the smaller sample has ≤ ``exact_max`` values and
    there are no ties; else the normal approximation with tie and continuity
    correction. Output: group…, n1, n2, u, p (rounded to 2).
    """
    group_cols = list(group_cols)
    exact_max = EXACT_MAX if exact_max is None else min(exact_max, EXACT_MAX)
    d = samples.withColumn("is_a", (F.col("sample") == "a").cast("bigint"))
    vp = value_positions(d, group_cols, "value", ["is_a"])
    rank = F.col("cum").cast("double") + (F.col("cnt").cast("double") + 1.0) / 2.0
    st = vp.groupBy(*group_cols).agg(
        F.sum("s_is_a").alias("n1"), (F.sum("cnt") - F.sum("s_is_a")).alias("n2"),
        F.sum(F.col("s_is_a") * rank).alias("r1"),
        F.sum(F.col("cnt").cast("double") ** 3 - F.col("cnt").cast("double")).alias("tie"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u1 = F.col("r1") - n1 * (n1 + 1) / 2.0
    st = st.withColumn("u", F.greatest(u1, n1 * n2 - u1))
    n = n1 + n2
    s = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("tie") / (n * (n - 1))))
    z = (F.col("u") - n1 * n2 / 2.0 - 0.5) / s
    p_norm = F.lit(1.0) - erf(z / F.lit(math.sqrt(2.0)))
    exact = (F.least("n1", "n2") <= exact_max) & (F.col("tie") == 0)
    st = st.withColumn("_exact", exact).withColumn("_p_norm", p_norm)
    # the exact tail is worked out beside the data, once per group (the counts of a size pair are kept by the worker)
    st = st.withColumn("sf", F.when(F.col("_exact"), F.pandas_udf(_exact_tail, "double")("n1", "n2", "u")))
    p = F.when(F.col("_exact"), F.least(2.0 * F.col("sf"), F.lit(1.0))).otherwise(
        F.least(F.greatest(F.col("_p_norm"), F.lit(0.0)), F.lit(1.0)))
    return st.select(*group_cols, "n1", "n2", "u", F.round(p, 2).alias("p"))


def mwu_jobs_matrix(scores: DataFrame, models, metric: str = "roc_auc") -> DataFrame:
    """RS-9: per experiment and job pair (a before b), U test of the per-seed scores of each
    job's best model at its best n_top."""
    bm = best_model_per_job(scores, models, metric)
    per = (scores.where(F.col("metric") == metric)
           .join(bm.select("experiment", "job", "model", "n_top"), ["experiment", "job", "model", "n_top"]))
    # job pairs (a before b) per experiment from the parameter-sized list of (experiment, job)
    names = sorted({(r["experiment"], r["job"]) for r in per.select("experiment", "job").distinct().collect()})
    pairs = [(e, a, b) for e, a in names for e2, b in names if e2 == e and a < b]
    if not pairs:
        return mann_whitney(per.limit(0).select(F.lit("").alias("experiment"), F.lit("").alias("job_a"),
                                                F.lit("").alias("job_b"), F.lit("a").alias("sample"), "value"),
                            ["experiment", "job_a", "job_b"])
    sides = F.explode(F.array(*[F.struct(F.lit(e).alias("experiment"), F.lit(a).alias("job_a"), F.lit(b).alias("job_b"),
                                         F.lit(side).alias("sample"), F.lit(j).alias("job"))
                                for e, a, b in pairs for side, j in (("a", a), ("b", b))]))
    spec = per.sparkSession.range(1).select(sides.alias("s")).select("s.*")
    samples = per.join(F.broadcast(spec), ["experiment", "job"]).select("experiment", "job_a", "job_b", "sample", "value")
    return mann_whitney(samples, ["experiment", "job_a", "job_b"])


def mwu_experiments_matrix(scores: DataFrame, models, jobs, metric: str = "roc_auc") -> DataFrame:
    """RS-10: per experiment pair (a before b), U test of the winners' per-seed scores."""
    w = best_job_model(scores, models, jobs, metric)
    ws = winner_scores(scores, w).where(F.col("metric") == metric).select("experiment", "value")
    exps = sorted(r["experiment"] for r in ws.select("experiment").distinct().collect())  # parameter-sized
    pairs = [(a, b) for i, a in enumerate(exps) for b in exps[i + 1:]]
    sides = F.explode(F.array(*[F.struct(F.lit(a).alias("exp_a"), F.lit(b).alias("exp_b"), F.lit(side).alias("sample"),
                                         F.lit(e).alias("experiment"))
                                for a, b in pairs for side, e in (("a", a), ("b", b))] or
                              [F.struct(F.lit("").alias("exp_a"), F.lit("").alias("exp_b"), F.lit("a").alias("sample"),
                                        F.lit(None).cast("string").alias("experiment"))]))
    spec = ws.sparkSession.range(1).select(sides.alias("s")).select("s.*")
    samples = ws.join(F.broadcast(spec), "experiment").select("exp_a", "exp_b", "sample", "value")
    return mann_whitney(samples, ["exp_a", "exp_b"])


# ---------------------------------------------------------------- predictions per id
def predictions_by_id(pred: DataFrame, ids: DataFrame, winners: DataFrame,
                      margin_models=("logistic_regression", "svm", "adaboost", "xgboost")) -> DataFrame:
    """RS-11: every id × experiment: mean score of the winning cell over the seeds where the id
    was in test; sigmoid for models whose scores are margins."""
    w = winners.select("experiment", "job", "model", "n_top")
    sel = pred.join(F.broadcast(w), ["experiment", "job", "model", "n_top"])  # one row per experiment
    mean = sel.groupBy("experiment", "id", "model").agg(F.avg("score").alias("mean_score"))
    exps = [r["experiment"] for r in w.select("experiment").collect()]  # experiments: a parameter-sized list
    grid = ids.select("id").distinct().withColumn("experiment", F.explode(F.array(*[F.lit(e) for e in exps])))
    j = grid.join(mean, ["experiment", "id"], "left").join(F.broadcast(w.select("experiment", F.col("model").alias("best_model"))), "experiment")
    margin = F.col("best_model").isin(list(margin_models))
    prob = F.when(margin, F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("mean_score")))).otherwise(F.col("mean_score"))
    return j.select("experiment", "id", prob.alias("probability"))


def metric_boxplot_table(scores: DataFrame, models, jobs, metric: str = "roc_auc") -> DataFrame:
    """RS-12: per experiment and metric, quartiles and whisker ends of the winner's per-seed values."""
    w = best_job_model(scores, models, jobs, metric)
    ws = winner_scores(scores, w).where(F.col("value").isNotNull())
    q = exact_quantiles(ws, ["experiment", "metric"], "value", [0.25, 0.5, 0.75])
    qq = q.groupBy("experiment", "metric").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("q"))).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    j = ws.join(qq, ["experiment", "metric"])
    iqr = F.col("q3") - F.col("q1")
    v = F.col("value")
    return j.groupBy("experiment", "metric", "q1", "median", "q3").agg(
        F.min(F.when(v >= F.col("q1") - 1.5 * iqr, v)).alias("whisker_lo"),
        F.max(F.when(v <= F.col("q3") + 1.5 * iqr, v)).alias("whisker_hi"),
        F.count(F.lit(1)).alias("n"))


def seed_completeness(plan: DataFrame, scores: DataFrame) -> DataFrame:
    """RS-13: per (experiment, job, n_top, model): planned seeds, seeds with scores, complete flag."""
    done = scores.select(*RUN).distinct().withColumn("has", F.lit(1))
    j = plan.join(done, RUN, "left")
    return j.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_planned"), F.count("has").alias("n_done")).withColumn(
        "complete", F.col("n_planned") == F.col("n_done"))


def representative_seed(scores: DataFrame, winners: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """XP-1: per winning cell, the seed whose score is nearest to the mean score (smallest seed on ties)."""
    ws = winner_scores(scores, winners).where((F.col("metric") == metric) & F.col("value").isNotNull())
    mean = ws.groupBy("experiment").agg(F.avg("value").alias("mean"))
    j = ws.join(mean, "experiment")
    key = F.struct((-F.abs(F.col("value") - F.col("mean"))).alias("d"), (-F.col("seed")).alias("s"), "seed", "value")
    g = j.groupBy("experiment", "job", "model", "n_top", "mean").agg(F.max(key).alias("b"))
    return g.select("experiment", "job", "model", "n_top", F.col("b.seed").alias("seed"),
                    F.col("b.value").alias("value"), "mean")
