"""Evaluation over a predictions table (EV-*).

Input: one row per (run, id) with ``y_true`` (0/1) and ``score``; a run is
identified by ``run`` columns (experiment, seed, job, n_top, model by
default). Every metric is an aggregate per run. Everything that needs order
(ranks, ROC points) goes through ``value_positions``: scores are collapsed to
distinct values per run with positive/negative counts and running sums, so a
large run is never sorted in one task, and neighbours are found by an
equi-join on the distinct-value index ``k`` instead of a run-wide window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .positions import BROADCAST_MAX_ROWS, checkpointed, value_positions

RUN = ["experiment", "seed", "job", "n_top", "model"]


def per_run(df: DataFrame) -> DataFrame:
    """A table with a few rows per run, materialised once in the shared folder and broadcast while it is small, so that
    no prediction is shuffled on the run key; a larger one joins by shuffle."""
    held = checkpointed(df)
    return F.broadcast(held) if held.count() <= BROADCAST_MAX_ROWS else held


def _div(a, b) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


# ---------------------------------------------------------------- distinct-score table
def score_table(pred: DataFrame, run=RUN, max_run_rows: int | None = None) -> DataFrame:
    """Per (run, distinct score): _pos, _neg at the score, _cum_pos/_cum_neg strictly below,
    _k (ascending index), _top (the highest score), _P, _N. Internal names start with
    an underscore so that they never meet a caller's run key. The totals of a run come from
    their own aggregate and are broadcast."""
    run = list(run)
    d = pred.select(*run, "score", F.col("y_true").cast("bigint").alias("_yp"),
                    (1 - F.col("y_true").cast("bigint")).alias("_yn"))
    vp = value_positions(d, run, "score", ["_yp", "_yn"], max_group_rows=max_run_rows)
    tot = per_run(d.where(F.col("score").isNotNull()).groupBy(*run).agg(F.sum("_yp").alias("_P"), F.sum("_yn").alias("_N")))
    top = F.col("cum") + F.col("cnt") == F.col("_P") + F.col("_N")
    return (vp.join(tot, run)
            .select(*run, F.col("value").alias("score"), F.col("s__yp").alias("_pos"), F.col("s__yn").alias("_neg"),
                    F.col("cum__yp").alias("_cum_pos"), F.col("cum__yn").alias("_cum_neg"), F.col("k").alias("_k"),
                    top.alias("_top"), "_P", "_N"))


def _confusion(pred: DataFrame, run, thr: Column) -> DataFrame:
    y = F.col("y_true").cast("bigint")
    p = (F.col("score") >= thr).cast("bigint")
    return pred.groupBy(*run).agg(
        F.sum(y * p).alias("tp"), F.sum((1 - y) * p).alias("fp"),
        F.sum((1 - y) * (1 - p)).alias("tn"), F.sum(y * (1 - p)).alias("fn"))


def confusion_metrics(conf: DataFrame, run) -> DataFrame:
    """EV-3…8 from counts; 0 where the denominator is 0 (zero_division=0)."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))

    def z(a, b):
        return F.coalesce(_div(a, b), F.lit(0.0))
    rec = z(tp, tp + fn)
    spec = z(tn, tn + fp)
    return conf.select(
        *run, "tp", "fp", "tn", "fn",
        rec.alias("recall"), spec.alias("specificity"), z(tp, tp + fp).alias("precision"),
        z(2 * tp, 2 * tp + fp + fn).alias("f1"), z(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ((rec + spec) / 2).alias("balanced_accuracy"))


def threshold_metrics(pred: DataFrame, run=RUN, threshold: float = 0.5) -> DataFrame:
    """EV-3…8 at a fixed threshold (pred = score ≥ threshold)."""
    run = list(run)
    return confusion_metrics(_confusion(pred, run, F.lit(float(threshold))), run)


def roc_auc(pred: DataFrame, run=RUN, max_run_rows: int | None = None) -> DataFrame:
    """EV-1: Mann–Whitney AUC with average ranks for ties; NULL for a one-class run.

    ``max_run_rows`` may state an upper bound of a run's size (skips the sizing pass)."""
    run = list(run)
    st = score_table(pred, run, max_run_rows)
    rank = F.col("_cum_pos") + F.col("_cum_neg") + (F.col("_pos") + F.col("_neg") + 1) / 2.0
    g = st.groupBy(*run, "_P", "_N").agg(F.sum(F.col("_pos") * rank).alias("_R"))
    u = F.col("_R") - F.col("_P") * (F.col("_P") + 1) / 2.0
    return g.select(*run, _div(u, F.col("_P") * F.col("_N")).alias("roc_auc"))


def average_precision(pred: DataFrame, run=RUN) -> DataFrame:
    """EV-2: Σ over distinct scores (descending) of ΔRecall · Precision."""
    run = list(run)
    st = score_table(pred, run)
    tp = F.col("_P") - F.col("_cum_pos")
    fp = F.col("_N") - F.col("_cum_neg")
    term = _div(F.col("_pos"), F.col("_P")) * _div(tp, tp + fp)
    return st.groupBy(*run).agg(F.sum(F.when(F.col("_pos") > 0, term)).alias("average_precision"))


def pos_rate(pred: DataFrame, run=RUN) -> DataFrame:
    """EV-9: round(mean(y), 3)."""
    return pred.groupBy(*run).agg(F.round(F.avg(F.col("y_true").cast("double")), 3).alias("pos_rate"))


def regression_metrics(pred: DataFrame, run=RUN, y: str = "y_true", yhat: str = "score") -> DataFrame:
    """EV-10: r2, mean absolute error, mean squared error, explained variance."""
    yy = F.col(y).cast("double")
    e = yy - F.col(yhat).cast("double")
    g = pred.groupBy(*run).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.var_pop(yy).alias("vy"), F.var_pop(e).alias("ve"),
        F.sum(e * e).alias("see"), F.sum(F.abs(e)).alias("sae"))
    n = F.col("n")
    sst = F.col("vy") * n
    var_e = F.col("ve") * n
    return g.select(*run,
                    (1 - _div(F.col("see"), sst)).alias("r2"),
                    (F.col("sae") / n).alias("mean_absolute_error"),
                    (F.col("see") / n).alias("mean_squared_error"),
                    (1 - _div(var_e, sst)).alias("explained_variance"))


# ---------------------------------------------------------------- ROC
def roc_points(pred: DataFrame, run=RUN, drop_intermediate: bool = True) -> DataFrame:
    """EV-11: (run, thr, fpr, tpr, fps, tps) at distinct scores plus the start point.

    The start point has thr = max score + 1 and fpr = tpr = 0. With
    ``drop_intermediate`` a point is dropped when the count of positives and of
    negatives at its score equal those at the next lower score (zero second
    differences of the cumulative counts); the highest and lowest are kept.
    """
    run = list(run)
    st = score_table(pred, run)
    lower = st.select(*run, (F.col("_k") + 1).alias("_k"), F.col("_pos").alias("_pos_lo"), F.col("_neg").alias("_neg_lo"))
    j = st.join(lower, [*run, "_k"], "left")
    keep = ((F.col("_k") == 0) | F.col("_top")
            | (F.col("_pos") != F.col("_pos_lo")) | (F.col("_neg") != F.col("_neg_lo")))
    if drop_intermediate:
        j = j.where(keep)
    tps = F.col("_P") - F.col("_cum_pos")
    fps = F.col("_N") - F.col("_cum_neg")
    pts = j.select(*run, F.col("score").alias("thr"), fps.alias("fps"), tps.alias("tps"), "_P", "_N")
    start = (st.where("_top")
             .select(*run, (F.col("score") + 1).alias("thr"), F.lit(0).cast("bigint").alias("fps"),
                     F.lit(0).cast("bigint").alias("tps"), "_P", "_N"))
    allp = pts.unionByName(start)
    return allp.select(*run, "thr", _div(F.col("fps"), F.col("_N")).alias("fpr"),
                       _div(F.col("tps"), F.col("_P")).alias("tpr"), "fps", "tps")


def optimal_point(points: DataFrame, run, objective: Column, name: str) -> DataFrame:
    """First point (highest threshold) maximising ``objective`` (EV-12/13/14)."""
    key = F.struct(objective.alias("o"), F.col("thr").alias("t"))
    g = points.where(objective.isNotNull()).groupBy(*run).agg(F.max(key).alias("_best"))
    return g.select(*run, F.col("_best.t").alias(f"{name}_thr"), F.col("_best.o").alias(f"{name}_objective"))


def youden_threshold(pred: DataFrame, run=RUN) -> DataFrame:
    """EV-12: threshold at the first maximum of tpr − fpr."""
    run = list(run)
    return optimal_point(roc_points(pred, run), run, F.col("tpr") - F.col("fpr"), "youden")


def corner_objective() -> Column:
    return -F.sqrt(F.col("fpr") * F.col("fpr") + (1 - F.col("tpr")) * (1 - F.col("tpr")))


def corner_threshold(pred: DataFrame, run=RUN) -> DataFrame:
    """EV-13: threshold maximising −√(fpr² + (1 − tpr)²)."""
    run = list(run)
    return optimal_point(roc_points(pred, run), run, corner_objective(), "corner")


COSTS = {"youden": lambda: F.col("tpr") - F.col("fpr"), "minoptsym": corner_objective}


def optimal_points(pred: DataFrame, run=RUN, costs: dict | None = None, slope: float = 1.0) -> DataFrame:
    """EV-14: for each cost: index, threshold, point, objective, line through the point
    (tpr = q + slope·fpr) and accuracy of the strict rule score > threshold."""
    run = list(run)
    costs = costs or COSTS
    pts = roc_points(pred, run).cache()
    outs = []
    for cid, fn in costs.items():
        obj = fn()
        key = F.struct(obj.alias("o"), F.col("thr").alias("t"), F.col("fpr").alias("f"), F.col("tpr").alias("p"))
        best = (pts.where(obj.isNotNull()).groupBy(*run).agg(F.max(key).alias("_b"))
                .select(*run, F.lit(cid).alias("cost"), F.col("_b.t").alias("opt"), F.col("_b.f").alias("fpr_opt"),
                        F.col("_b.p").alias("tpr_opt"), F.col("_b.o").alias("objective")))
        outs.append(best)
    best = outs[0]
    for o in outs[1:]:
        best = best.unionByName(o)
    best = per_run(best)
    ind = (pts.join(best.select(*run, "cost", "opt"), run)
           .groupBy(*run, "cost").agg(F.sum((F.col("thr") > F.col("opt")).cast("bigint")).alias("ind")))
    acc = (pred.join(best.select(*run, "cost", "opt"), run)
           .groupBy(*run, "cost").agg(F.avg(((F.col("score") > F.col("opt")).cast("int") == F.col("y_true"))
                                            .cast("double")).alias("accuracy")))
    out = (best.join(ind, [*run, "cost"]).join(acc, [*run, "cost"])
           .withColumn("q", F.col("tpr_opt") - F.lit(slope) * F.col("fpr_opt")))
    out = checkpointed(out)
    pts.unpersist()
    return out


def auc_trapz(pred: DataFrame, run=RUN, auto_flip: bool = True) -> DataFrame:
    """EV-15: trapezoid area under the ROC points; below 0.5 → 1 − auc, flagged as flipped."""
    run = list(run)
    st = score_table(pred, run)
    # point at distinct index k and its predecessor on the curve (next higher score, k + 1; start point above the top)
    # counts, not rates: twice the area in whole numbers is exact, so an area of one half is no matter of summation order
    whole = lambda c: c.cast("decimal(19,0)")
    cur = st.select(*run, "_k", "_top", "_P", "_N", whole(F.col("_N") - F.col("_cum_neg")).alias("f"), whole(F.col("_P") - F.col("_cum_pos")).alias("t"))
    prev = cur.select(*run, (F.col("_k") - 1).alias("_k"), F.col("f").alias("f0"), F.col("t").alias("t0"))
    j = cur.join(prev, [*run, "_k"], "left").select(
        *run, "_P", "_N", "f", "t", F.coalesce("f0", F.when(F.col("_top"), whole(F.lit(0)))).alias("f0"),
        F.coalesce("t0", F.when(F.col("_top"), whole(F.lit(0)))).alias("t0"))
    twice = j.groupBy(*run, "_P", "_N").agg(F.sum((F.col("f") - F.col("f0")) * (F.col("t") + F.col("t0"))).alias("_a"))
    area = twice.select(*run, _div(F.col("_a"), F.lit(2.0) * F.col("_P") * F.col("_N")).alias("auc"))
    if not auto_flip:
        return area.select(*run, "auc", F.lit(False).alias("flipped"))
    return area.select(*run, F.when(F.col("auc") < 0.5, 1 - F.col("auc")).otherwise(F.col("auc")).alias("auc"),
                       (F.col("auc") < 0.5).alias("flipped"))


def apply_threshold(pred: DataFrame, thresholds: DataFrame, run=RUN, thr_col: str = "youden_thr") -> DataFrame:
    """EV-16: pred = score ≥ threshold of the run (inclusive)."""
    run = list(run)
    return (pred.join(per_run(thresholds.select(*run, F.col(thr_col).alias("thr"))), run)
            .withColumn("y_pred", (F.col("score") >= F.col("thr")).cast("int")))


def metrics_at_youden(pred: DataFrame, run=RUN) -> DataFrame:
    """EV-17: threshold metrics recomputed at each run's Youden threshold."""
    run = list(run)
    applied = apply_threshold(pred, youden_threshold(pred, run), run)
    y = F.col("y_true").cast("bigint")
    p = F.col("y_pred").cast("bigint")
    conf = applied.groupBy(*run).agg(
        F.sum(y * p).alias("tp"), F.sum((1 - y) * p).alias("fp"),
        F.sum((1 - y) * (1 - p)).alias("tn"), F.sum(y * (1 - p)).alias("fn"))
    return confusion_metrics(conf, run)


def mean_confusion_matrix(pred: DataFrame, run=RUN, over=("seed",), threshold: float = 0.5) -> DataFrame:
    """EV-18: 2×2 counts per run, averaged over seeds (and bootstraps)."""
    run = list(run)
    keep = [c for c in run if c not in set(over)]
    conf = _confusion(pred, run, F.lit(float(threshold)))
    return conf.groupBy(*keep).agg(*[F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in ("tn", "fp", "fn", "tp")])


def zero_positive_runs(pred: DataFrame, run=RUN, threshold: float = 0.5) -> DataFrame:
    """EV-19: runs that predicted no positive."""
    run = list(run)
    return (pred.groupBy(*run).agg(F.sum((F.col("score") >= threshold).cast("bigint")).alias("n_pred_pos"),
                                   F.count(F.lit(1)).alias("n"))
            .where(F.col("n_pred_pos") == 0))


def mean_roc_curve(pred: DataFrame, run=RUN, over=("seed",), grid: int = 101, z: float = 1.96) -> DataFrame:
    """EV-20: each run's ROC interpolated linearly at fpr = g/(grid−1), then mean, std and a
    ±z·std/√n band over seeds per remaining keys.

    Per grid point the run's last curve point with fpr ≤ x and the first with
    fpr > x are found through a bucket table (≤ grid rows per run), so the
    curve points are never multiplied by the grid.
    """
    run = list(run)
    keep = [c for c in run if c not in set(over)]
    steps = grid - 1
    pts = roc_points(pred, run, drop_intermediate=False).where(F.col("fpr").isNotNull() & F.col("tpr").isNotNull())
    # bucket b = smallest grid index g with x_g = g / steps ≥ fpr (exact comparison), so
    # "fpr ≤ x_g" ⟺ b ≤ g and "fpr > x_g" ⟺ b > g.
    b0 = F.ceil(F.col("fpr") * steps).cast("int")
    b = (F.when((b0 > 0) & ((b0 - 1).cast("double") / steps >= F.col("fpr")), b0 - 1)
         .when(b0.cast("double") / steps < F.col("fpr"), b0 + 1).otherwise(b0))
    pb = pts.withColumn("b", b)
    last = pb.groupBy(*run, "b").agg(F.max(F.struct("fpr", "tpr")).alias("lst"), F.min(F.struct("fpr", "tpr")).alias("fst"))
    gx = (pb.select(*run).distinct()
          .withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(steps))))
          .withColumn("x", F.col("g").cast("double") / steps))
    # lower point: last point of the highest bucket ≤ g; upper: first point of the lowest bucket > g
    lo = (gx.join(last, run).where(F.col("b") <= F.col("g"))
          .groupBy(*run, "g", "x").agg(F.max(F.struct("b", "lst")).alias("L")))
    hi = (gx.join(last, run).where(F.col("b") > F.col("g"))
          .groupBy(*run, "g").agg(F.min(F.struct("b", "fst")).alias("H")))
    j = lo.join(hi, [*run, "g"], "left")
    f0, t0 = F.col("L.lst.fpr"), F.col("L.lst.tpr")
    f1, t1 = F.col("H.fst.fpr"), F.col("H.fst.tpr")
    tpr = F.when(F.col("H").isNull(), t0).otherwise(t0 + (F.col("x") - f0) * (t1 - t0) / (f1 - f0))
    # tpr in integer micro-units: the sums below are exact, so the mean does not depend on summation order
    interp = j.select(*run, "g", "x", F.floor(tpr * 1e6 + 0.5).cast("bigint").alias("tu"))
    agg = interp.groupBy(*keep, "g", "x").agg(
        F.sum("tu").alias("s"), F.sum(F.col("tu") * F.col("tu")).alias("q"), F.count(F.lit(1)).alias("n_runs"))
    n = F.col("n_runs").cast("double")
    mean = F.col("s").cast("double") / n
    std = F.sqrt(F.greatest(F.col("q").cast("double") / n - mean * mean, F.lit(0.0)))
    half = F.lit(z) * std / F.sqrt(n)

    def micro(c):
        return F.floor(c + 0.5).cast("double") / 1e6
    return agg.select(*keep, F.col("x").alias("fpr"), micro(mean).alias("mean_tpr"), micro(std).alias("std_tpr"),
                      micro(F.greatest(mean - half, F.lit(0.0))).alias("tpr_lo"),
                      micro(F.least(mean + half, F.lit(1e6))).alias("tpr_hi"), "n_runs")


def duplicate_thresholds(pred: DataFrame, run=RUN) -> DataFrame:
    """EV-21: scores that occur more than once in a run, the lowest score excluded."""
    run = list(run)
    c = pred.groupBy(*run, "score").agg(F.count(F.lit(1)).alias("n"))
    low = pred.groupBy(*run).agg(F.min("score").alias("_low"))
    return (c.join(per_run(low), run).where((F.col("n") > 1) & (F.col("score") != F.col("_low")))
            .select(*run, F.col("score").alias("thr"), "n"))

