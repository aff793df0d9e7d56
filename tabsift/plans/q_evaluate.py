"""Evaluation queries (EV-*) over the predictions fixture W3, with oracle SQL."""

from __future__ import annotations

from ..functions.portable import r6, rhalf, rhalf_sql
from ..operators import evaluate as ev
from ..sources.fixtures import predictions, with_fixtures
from .registry import query

R = "experiment, seed, job, n_top, model"
RUN = ev.RUN
PR = f"PARTITION BY {R}"

# distinct-score table in SQL: same columns as evaluate.score_table
ST = f"""SELECT {R}, score, pos, neg,
  CAST(coalesce(sum(pos) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum_pos,
  CAST(coalesce(sum(neg) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum_neg,
  CAST(row_number() OVER w - 1 AS BIGINT) AS k,
  CAST(sum(pos) OVER ({PR}) AS BIGINT) AS P, CAST(sum(neg) OVER ({PR}) AS BIGINT) AS N,
  CAST(count(*) OVER ({PR}) AS BIGINT) AS m
FROM (SELECT {R}, score, CAST(sum(y_true) AS BIGINT) AS pos, CAST(count(*) - sum(y_true) AS BIGINT) AS neg
      FROM w3 GROUP BY {R}, score)
WINDOW w AS ({PR} ORDER BY score)"""

ROC_ALL = f"""SELECT {R}, score AS thr, pos, neg, N - cum_neg AS fps, P - cum_pos AS tps, P, N, k, m,
  lag(pos) OVER ({PR} ORDER BY score) AS pos_lo, lag(neg) OVER ({PR} ORDER BY score) AS neg_lo
FROM st"""

ROC_KEPT = f"""SELECT {R}, thr, fps, tps, P, N FROM roc_all
WHERE k = 0 OR k = m - 1 OR pos <> pos_lo OR neg <> neg_lo
UNION ALL SELECT {R}, thr + 1, 0, 0, P, N FROM roc_all WHERE k = m - 1"""

ROC_PTS = f"""SELECT {R}, thr, CAST(fps AS DOUBLE) / nullif(N, 0) AS fpr, CAST(tps AS DOUBLE) / nullif(P, 0) AS tpr,
  CAST(fps AS BIGINT) AS fps, CAST(tps AS BIGINT) AS tps FROM roc_kept"""

CONF = f"""SELECT {R}, CAST(sum(y_true * p) AS BIGINT) AS tp, CAST(sum((1 - y_true) * p) AS BIGINT) AS fp,
  CAST(sum((1 - y_true) * (1 - p)) AS BIGINT) AS tn, CAST(sum(y_true * (1 - p)) AS BIGINT) AS fn
FROM (SELECT *, CASE WHEN score >= {{thr}} THEN 1 ELSE 0 END AS p FROM {{src}}) GROUP BY {R}"""


def _z(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


CONF_METRICS = {
    "recall": _z("tp", "tp + fn"),
    "specificity": _z("tn", "tn + fp"),
    "precision": _z("tp", "tp + fp"),
    "f1": _z("2 * tp", "2 * tp + fp + fn"),
    "accuracy": _z("tp + tn", "tp + tn + fp + fn"),
    "balanced_accuracy": f"({_z('tp', 'tp + fn')} + {_z('tn', 'tn + fp')}) / 2",
}


def _sql(body: str, *extra: tuple[str, str]) -> str:
    return with_fixtures(body, "w3", extra=list(extra))


def _metric_query(name: str, metric: str):
    def q(spark, sf_dir):
        m = ev.threshold_metrics(predictions(spark, sf_dir), RUN, 0.5)
        return m.select(*RUN, r6(metric).alias(metric))
    sql = _sql(f"SELECT {R}, round({CONF_METRICS[metric]}, 6) AS {metric} FROM conf",
               ("conf", CONF.format(thr="0.5", src="w3")))
    query(name, sql)(q)


for _name, _metric in [("ev_recall", "recall"), ("ev_specificity", "specificity"), ("ev_precision", "precision"),
                       ("ev_f1", "f1"), ("ev_accuracy", "accuracy"), ("ev_balanced_accuracy", "balanced_accuracy")]:
    _metric_query(_name, _metric)


@query("ev_roc_auc", _sql(
    f"SELECT {R}, round((R - P * (P + 1) / 2.0) / nullif(CAST(P * N AS DOUBLE), 0), 6) AS roc_auc FROM "
    f"(SELECT {R}, P, N, sum(pos * (cum_pos + cum_neg + (pos + neg + 1) / 2.0)) AS R FROM st GROUP BY {R}, P, N)",
    ("st", ST)))
def ev_roc_auc(spark, sf_dir):
    return ev.roc_auc(predictions(spark, sf_dir)).select(*RUN, r6("roc_auc").alias("roc_auc"))


@query("ev_average_precision", _sql(
    f"SELECT {R}, round(sum(CASE WHEN pos > 0 THEN (CAST(pos AS DOUBLE) / nullif(P, 0)) * "
    f"(CAST(P - cum_pos AS DOUBLE) / nullif(P - cum_pos + N - cum_neg, 0)) END), 6) AS average_precision "
    f"FROM st GROUP BY {R}", ("st", ST)))
def ev_average_precision(spark, sf_dir):
    return ev.average_precision(predictions(spark, sf_dir)).select(*RUN, r6("average_precision").alias("average_precision"))


@query("ev_pos_rate", _sql(f"SELECT {R}, round(avg(CAST(y_true AS DOUBLE)), 3) AS pos_rate FROM w3 GROUP BY {R}"))
def ev_pos_rate(spark, sf_dir):
    return ev.pos_rate(predictions(spark, sf_dir))


def _six(x: str) -> str:
    """Six places by way of nine, in arithmetic that is the same everywhere: values that end in ...5 must not tip over."""
    return rhalf_sql(rhalf_sql(x, 9), 6)


@query("ev_regression_metrics", _sql(
    f"""SELECT {R}, {_six('1 - see / nullif(vy * n, 0)')} AS r2, {_six('sae / n')} AS mean_absolute_error,
  {_six('see / n')} AS mean_squared_error, {_six('1 - ve / nullif(vy, 0)')} AS explained_variance
FROM (SELECT {R}, CAST(count(*) AS DOUBLE) AS n, var_pop(CAST(y_true AS DOUBLE)) AS vy, var_pop(y_true - score) AS ve,
  sum((y_true - score) * (y_true - score)) AS see, sum(abs(y_true - score)) AS sae FROM w3 GROUP BY {R})"""))
def ev_regression_metrics(spark, sf_dir):
    m = ev.regression_metrics(predictions(spark, sf_dir))
    cols = ["r2", "mean_absolute_error", "mean_squared_error", "explained_variance"]
    return m.select(*RUN, *[rhalf(rhalf(c, 9), 6).alias(c) for c in cols])


ROC_CTES = (("st", ST), ("roc_all", ROC_ALL), ("roc_kept", ROC_KEPT), ("roc", ROC_PTS))


@query("ev_roc_curve", _sql(f"SELECT {R}, thr, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, fps, tps FROM roc", *ROC_CTES))
def ev_roc_curve(spark, sf_dir):
    pts = ev.roc_points(predictions(spark, sf_dir))
    return pts.select(*RUN, "thr", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"), "fps", "tps")


def _best_sql(obj: str, name: str) -> str:
    return _sql(f"SELECT {R}, b.t AS {name}_thr, round(b.o, 6) AS {name}_objective FROM "
                f"(SELECT {R}, max({{'o': {obj}, 't': thr}}) AS b FROM roc WHERE {obj} IS NOT NULL GROUP BY {R})",
                *ROC_CTES)


@query("ev_youden", _best_sql("tpr - fpr", "youden"))
def ev_youden(spark, sf_dir):
    t = ev.youden_threshold(predictions(spark, sf_dir))
    return t.select(*RUN, "youden_thr", r6("youden_objective").alias("youden_objective"))


CORNER = "-sqrt(fpr * fpr + (1 - tpr) * (1 - tpr))"


@query("ev_corner", _best_sql(CORNER, "corner"))
def ev_corner(spark, sf_dir):
    t = ev.corner_threshold(predictions(spark, sf_dir))
    return t.select(*RUN, "corner_thr", r6("corner_objective").alias("corner_objective"))


def _opt_sql() -> str:
    parts = []
    for cid, obj in (("youden", "tpr - fpr"), ("minoptsym", CORNER)):
        parts.append(f"SELECT {R}, '{cid}' AS cost, b.t AS opt, b.f AS fpr_opt, b.p AS tpr_opt, b.o AS objective FROM "
                     f"(SELECT {R}, max({{'o': {obj}, 't': thr, 'f': fpr, 'p': tpr}}) AS b FROM roc "
                     f"WHERE {obj} IS NOT NULL GROUP BY {R})")
    best = " UNION ALL ".join(parts)
    on = " AND ".join(f"x.{c} = b.{c}" for c in RUN)
    body = f"""SELECT b.experiment, b.seed, b.job, b.n_top, b.model, b.cost, b.opt, round(b.fpr_opt, 6) AS fpr_opt,
  round(b.tpr_opt, 6) AS tpr_opt, round(b.objective, 6) AS objective,
  (SELECT CAST(count(*) AS BIGINT) FROM roc x WHERE {on} AND x.thr > b.opt) AS ind,
  (SELECT round(avg(CASE WHEN (CASE WHEN x.score > b.opt THEN 1 ELSE 0 END) = x.y_true THEN 1.0 ELSE 0.0 END), 6)
     FROM w3 x WHERE {on}) AS accuracy,
  round(b.tpr_opt - 1.0 * b.fpr_opt, 6) AS q
FROM best b"""
    return _sql(body, *ROC_CTES, ("best", best))


@query("ev_optimal_points", _opt_sql())
def ev_optimal_points(spark, sf_dir):
    o = ev.optimal_points(predictions(spark, sf_dir))
    return o.select(*RUN, "cost", "opt", *[r6(c).alias(c) for c in ["fpr_opt", "tpr_opt", "objective"]],
                    "ind", r6("accuracy").alias("accuracy"), r6("q").alias("q"))


TRAPZ = f"""SELECT {R}, CAST(sum((f - f0) * (t + t0)) AS DOUBLE) / nullif(2.0 * any_value(P) * any_value(N), 0) AS auc FROM (
  SELECT {R}, P, N, f, t, coalesce(lead(f) OVER ({PR} ORDER BY thr), 0) AS f0, coalesce(lead(t) OVER ({PR} ORDER BY thr), 0) AS t0
  FROM (SELECT {R}, score AS thr, P, N, CAST(N - cum_neg AS BIGINT) AS f, CAST(P - cum_pos AS BIGINT) AS t FROM st))
GROUP BY {R}"""


@query("ev_auc_trapz", _sql(
    f"SELECT {R}, round(CASE WHEN auc < 0.5 THEN 1 - auc ELSE auc END, 6) AS auc, auc < 0.5 AS flipped FROM trapz",
    ("st", ST), ("trapz", TRAPZ)))
def ev_auc_trapz(spark, sf_dir):
    a = ev.auc_trapz(predictions(spark, sf_dir))
    return a.select(*RUN, r6("auc").alias("auc"), "flipped")


YOUDEN = f"SELECT {R}, max({{'o': tpr - fpr, 't': thr}}).t AS thr FROM roc WHERE tpr - fpr IS NOT NULL GROUP BY {R}"


@query("ev_apply_threshold", _sql(
    f"SELECT w3.*, y.thr, CASE WHEN w3.score >= y.thr THEN 1 ELSE 0 END AS y_pred FROM w3 JOIN youden y USING ({R})",
    *ROC_CTES, ("youden", YOUDEN)))
def ev_apply_threshold(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return ev.apply_threshold(p, ev.youden_threshold(p))


@query("ev_metrics_at_threshold", _sql(
    f"SELECT {R}, tp, fp, tn, fn, " + ", ".join(f"round({e}, 6) AS {m}" for m, e in CONF_METRICS.items()) + " FROM conf",
    *ROC_CTES, ("youden", YOUDEN), ("applied", f"SELECT w3.*, y.thr FROM w3 JOIN youden y USING ({R})"),
    ("conf", CONF.format(thr="thr", src="applied"))))
def ev_metrics_at_threshold(spark, sf_dir):
    m = ev.metrics_at_youden(predictions(spark, sf_dir))
    return m.select(*RUN, "tp", "fp", "tn", "fn", *[r6(c).alias(c) for c in CONF_METRICS])


@query("ev_mean_confusion", _sql(
    "SELECT experiment, job, n_top, model, " + ", ".join(
        f"round(avg(CAST({c} AS DOUBLE)), 6) AS mean_{c}" for c in ("tn", "fp", "fn", "tp"))
    + " FROM conf GROUP BY experiment, job, n_top, model", ("conf", CONF.format(thr="0.5", src="w3"))))
def ev_mean_confusion(spark, sf_dir):
    m = ev.mean_confusion_matrix(predictions(spark, sf_dir))
    return m.select("experiment", "job", "n_top", "model", *[r6(f"mean_{c}").alias(f"mean_{c}") for c in ("tn", "fp", "fn", "tp")])


@query("ev_zero_positive", _sql(
    f"SELECT {R}, n_pred_pos, n FROM (SELECT {R}, CAST(sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_pred_pos, "
    f"count(*) AS n FROM w3 GROUP BY {R}) WHERE n_pred_pos = 0"))
def ev_zero_positive(spark, sf_dir):
    return ev.zero_positive_runs(predictions(spark, sf_dir))


MEAN_ROC = f"""SELECT experiment, job, n_top, model, x AS fpr,
  CAST(floor(mean + 0.5) AS DOUBLE) / 1e6 AS mean_tpr, CAST(floor(std + 0.5) AS DOUBLE) / 1e6 AS std_tpr,
  CAST(floor(greatest(mean - 1.96 * std / sqrt(n), 0.0) + 0.5) AS DOUBLE) / 1e6 AS tpr_lo,
  CAST(floor(least(mean + 1.96 * std / sqrt(n), 1e6) + 0.5) AS DOUBLE) / 1e6 AS tpr_hi, n_runs
FROM (SELECT *, sqrt(greatest(CAST(q AS DOUBLE) / n - mean * mean, 0.0)) AS std FROM (
  SELECT experiment, job, n_top, model, x, CAST(sum(tu) AS BIGINT) AS s, CAST(sum(tu * tu) AS BIGINT) AS q, count(*) AS n_runs,
    CAST(count(*) AS DOUBLE) AS n, CAST(sum(tu) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mean
  FROM (
    SELECT {R}, x, CAST(floor(CASE WHEN hs IS NULL THEN ls.t ELSE ls.t + (x - ls.f) * (hs.t - ls.t) / (hs.f - ls.f) END * 1e6 + 0.5) AS BIGINT) AS tu
    FROM (SELECT g.{R.replace(', ', ', g.')}, g.x, max({{'f': p.fpr, 't': p.tpr}}) AS ls FROM grid g JOIN pts p USING ({R})
          WHERE p.fpr <= g.x GROUP BY ALL) l
    LEFT JOIN (SELECT g.{R.replace(', ', ', g.')}, g.x, min({{'f': p.fpr, 't': p.tpr}}) AS hs FROM grid g JOIN pts p USING ({R})
          WHERE p.fpr > g.x GROUP BY ALL) h USING ({R}, x))
  GROUP BY experiment, job, n_top, model, x))"""

ALL_PTS = f"""SELECT {R}, CAST(N - cum_neg AS DOUBLE) / nullif(N, 0) AS fpr, CAST(P - cum_pos AS DOUBLE) / nullif(P, 0) AS tpr FROM st
UNION ALL SELECT DISTINCT {R}, 0.0, 0.0 FROM st WHERE P > 0 AND N > 0"""


@query("ev_mean_roc", _sql(
    MEAN_ROC, ("st", ST), ("pts", f"SELECT * FROM ({ALL_PTS}) WHERE fpr IS NOT NULL AND tpr IS NOT NULL"),
    ("grid", f"SELECT DISTINCT {R}, CAST(g AS DOUBLE) / 100 AS x FROM pts, range(0, 101) r(g)")))
def ev_mean_roc(spark, sf_dir):
    m = ev.mean_roc_curve(predictions(spark, sf_dir))
    return m.select("experiment", "job", "n_top", "model", "fpr", "mean_tpr", "std_tpr", "tpr_lo", "tpr_hi", "n_runs")


@query("ev_duplicate_thresholds", _sql(
    f"SELECT {R}, score AS thr, n FROM (SELECT {R}, score, count(*) AS n, min(score) OVER ({PR}) AS low FROM w3 "
    f"GROUP BY {R}, score) WHERE n > 1 AND score <> low"))
def ev_duplicate_thresholds(spark, sf_dir):
    return ev.duplicate_thresholds(predictions(spark, sf_dir))

