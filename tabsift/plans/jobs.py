"""Selection jobs (FS-16): a named chain of steps over a (train, test) frame.

Each step takes the frame and the current feature list and returns both; the
last feature list is the job's result, best first where the step ranks.
Normalising steps fit on the train part and apply to every row; selecting
steps look at the train part only. Unknown step names are rejected before
anything runs; a step that leaves no feature ends the job.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scale as sc
from ..operators import select as sel
from ..operators.positions import checkpointed


def _train(df: DataFrame) -> DataFrame:
    return df.where(F.col("part") == "train") if "part" in df.columns else df


def _variance(df, feats, p):
    return df, sel.variance_threshold(_train(df), feats, p.get("variance_thresh", 0.99))


def _normaliser(method):
    def step(df, feats, p):
        out, _ = sc.normalise(df, feats, method)
        return out, feats
    return step


def _correlation(df, feats, p):
    """Ranked by |r| with the target, or by permutation importance of a forest (``corr_ranking: forest``)."""
    target, thresh = p.get("target", "target"), p.get("corr_thresh", 0.95)
    if p.get("corr_ranking", "pearson") != "forest":
        kept, _ = sel.correlation_filter(_train(df), feats, target, thresh, p.get("corr_method", "pearson"))
        return df, kept
    from ..operators import models_select as ms
    from ..operators.stats import pair_corr
    imp = {r["feature"]: r["importance"] for r in ms.permutation_importance(_train(df), feats, target).collect()}
    ordered = sorted(feats, key=lambda f: (-imp[f], feats.index(f)))
    ranking = df.sparkSession.createDataFrame([(i + 1, f) for i, f in enumerate(ordered)], "rank bigint, feature string")
    pairs = pair_corr(_train(df), feats, p.get("corr_method", "pearson"))
    dropped = {r["feature"] for r in sel.correlation_drops(pairs, ranking, thresh).collect()}
    return df, [f for f in feats if f not in dropped]


def _drop_outliers(df, feats, p):
    from ..operators.explore import drop_outliers, outlier_limits
    return drop_outliers(df, feats, outlier_limits(_train(df), feats)), feats


def _detect_outliers(df, feats, p):
    """Reports flagged cells through ``p["report"]`` (a function that takes the table), changes nothing."""
    from ..operators.explore import detect_outliers
    if "report" in p:
        p["report"]("detect_outliers", detect_outliers(_train(df), feats))
    return df, feats


def _univariate_analysis(df, feats, p):
    from ..operators.explore import corr_to_target
    if "report" in p:
        p["report"]("univariate_analysis", corr_to_target(_train(df), feats, p.get("target", "target")))
    return df, feats


def _feature_wiz(df, feats, p):
    """SULOV, then boosted importances on shrinking feature sets."""
    from ..operators import models_select as ms
    kept = sel.sulov(_train(df), feats, p.get("target", "target"), p.get("corr_thresh", 0.95))
    return df, ms.gbt_recursive_importance(_train(df), kept, p.get("target", "target")) if len(kept) > 1 else kept


def _pca(df, feats, p):
    """Replaces the features by component scores fitted on the train part."""
    from ..operators.reduce import pca_scores
    target = p.get("target", "target")
    scores = pca_scores(df, feats, p.get("n_components"), keep=(), fit_on=_train(df))
    names = [c for c in scores.columns if c.startswith("pc")]
    return df.select("id", *[c for c in df.columns if c in (target, "part")]).join(scores, "id"), names


def _mrmr(df, feats, p):
    return df, sel.mrmr(_train(df), feats, max(p.get("n_top_features", [30])), p.get("target", "target"),
                        p.get("learn_task", "binary_classification"))


def _hand_picked(df, feats, p):
    return df, [f for f in p.get("hand_picked", []) if f in df.columns]


def _sulov(df, feats, p):
    return df, sel.sulov(_train(df), feats, p.get("target", "target"), p.get("corr_thresh", 0.95))


def _model_step(name):
    def step(df, feats, p):
        from ..operators import models_select as ms
        return df, ms.MODEL_STEPS[name](_train(df), feats, p)
    return step


STEPS: dict[str, Callable] = {
    "variance_threshold": _variance,
    "drop_outliers": _drop_outliers,
    "detect_outliers": _detect_outliers,
    "univariate_analysis": _univariate_analysis,
    "feature_wiz": _feature_wiz,
    "pca": _pca,
    "correlation": _correlation,
    "mrmr": _mrmr,
    "hand_picked": _hand_picked,
    "sulov": _sulov,
    **{m: _normaliser(m) for m in sc.SCALERS},
    **{m: _model_step(m) for m in ("univariate_ranking", "fr_logistic_regression", "fr_forest", "fr_extreme_forest",
                                     "fr_adaboost", "fr_xgboost", "gbt_recursive_importance")},
}


def job_name(steps) -> str:
    return "_".join(steps)


def _checked(steps) -> None:
    unknown = [s for s in steps if s not in STEPS]
    if unknown:
        raise ValueError(f"unknown steps {unknown}; known: {sorted(STEPS)}")


def run_job(df: DataFrame, features, steps, params: dict | None = None) -> tuple[DataFrame, list[str]]:
    """Run ``steps`` in order; return the final frame and feature list."""
    params = params or {}
    _checked(steps)
    feats = list(features)
    for s in steps:
        df, feats = STEPS[s](df, feats, params)
        if not feats:
            break
    return df, feats


def resolved_jobs(jobs) -> list[list[str]]:
    """Jobs as plain step lists: ``set_memory`` marks what a later ``get_memory`` starts with."""
    held, out = None, []
    for job in map(list, jobs):
        if "set_memory" in job:
            held = job[:job.index("set_memory")]
            job = [s for s in job if s != "set_memory"]
        elif "get_memory" in job:
            if held is None:
                raise ValueError("get_memory before any set_memory")
            job = held + job[job.index("get_memory") + 1:]
        out.append(job)
    return out


def run_jobs(df: DataFrame, features, jobs, params: dict | None = None, log: list | None = None) -> dict[str, tuple[DataFrame, list[str]]]:
    """All ``jobs`` as a tree of their common beginnings: {job name: (frame, features)}, in the jobs' order.

    Every shared beginning is computed once; a frame that a step has changed and several jobs go on from is written
    once. ``log`` receives each step that ran, as the tuple of steps so far.
    """
    params, jobs = params or {}, resolved_jobs(jobs)
    for job in jobs:
        _checked(job)
    prefixes = Counter(tuple(job[:i]) for job in {tuple(j) for j in jobs} for i in range(1, len(job) + 1))
    done: dict[tuple, tuple[DataFrame, list[str]]] = {(): (df, list(features))}
    out = {}
    for job in jobs:
        at: tuple = ()
        for step in job:
            frame, feats = done[at]
            if not feats:
                break
            at = (*at, step)
            if at not in done:
                after, kept = STEPS[step](frame, feats, params)
                if after is not frame and prefixes[at] > 1:
                    after = checkpointed(after)
                done[at] = (after, kept)
                if log is not None:
                    log.append(at)
        out[job_name(job)] = done[at]
    return out
