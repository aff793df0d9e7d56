"""Result summary queries (RS-*, XP-1) over per-run scores of W3, with oracle SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.portable import erf_sql, r6
from ..operators import summarise as rs
from ..sources.fixtures import predictions, with_fixtures
from .q_evaluate import CONF, CONF_METRICS, R, ST
from .registry import query

JOBS = ["job0", "job1"]
PLAN_JOBS = ["job0", "job1", "job2"]
N_TOPS = [2, 4, 6, 8]
MODELS = ["click", "error", "purchase", "signup", "view"]
MARGIN_MODELS = ["click"]

# ---------------------------------------------------------------- SQL building blocks
WIDE = f"""SELECT * FROM
 (SELECT {R}, (R - P * (P + 1) / 2.0) / nullif(CAST(P * N AS DOUBLE), 0) AS roc_auc FROM
   (SELECT {R}, P, N, sum(pos * (cum_pos + cum_neg + (pos + neg + 1) / 2.0)) AS R FROM st GROUP BY {R}, P, N))
 JOIN (SELECT {R}, sum(CASE WHEN pos > 0 THEN (CAST(pos AS DOUBLE) / nullif(P, 0)) *
       (CAST(P - cum_pos AS DOUBLE) / nullif(P - cum_pos + N - cum_neg, 0)) END) AS average_precision FROM st GROUP BY {R}) USING ({R})
 JOIN (SELECT {R}, {', '.join(f'{e} AS {m}' for m, e in CONF_METRICS.items())} FROM conf) USING ({R})
 JOIN (SELECT {R}, round(avg(CAST(y_true AS DOUBLE)), 3) AS pos_rate FROM w3 GROUP BY {R}) USING ({R})"""

SCORES = "\nUNION ALL\n".join(f"SELECT {R}, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM wide"
                               for m in rs.SCORE_METRICS)

BASE = [("st", ST), ("conf", CONF.format(thr="0.5", src="w3")), ("wide", WIDE), ("scores", SCORES)]

MEANS = """SELECT experiment, job, n_top, model, avg(value) AS mean FROM scores WHERE metric = 'roc_auc'
GROUP BY experiment, job, n_top, model"""
BEST_NTOP = """SELECT experiment, job, model, b.n AS n_top, b.m AS mean FROM (
  SELECT experiment, job, model, max({'v': mean, 'neg_n': -n_top, 'n': n_top, 'm': mean}) AS b FROM means
  WHERE mean IS NOT NULL GROUP BY experiment, job, model)"""


def _pos(values, col):
    return "CASE " + " ".join(f"WHEN {col} = '{v}' THEN {i}" for i, v in enumerate(values)) + " END"


BEST_MODEL_JOB = f"""SELECT experiment, job, b.model AS model, b.n AS n_top, b.m AS mean FROM (
  SELECT experiment, job, max({{'v': mean, 'p': -({_pos(MODELS, 'model')}), 'model': model, 'n': n_top, 'm': mean}}) AS b
  FROM best_ntop GROUP BY experiment, job)"""
BEST_CELL = f"""SELECT experiment, b.model AS model, b.job AS job, b.n AS n_top, b.m AS mean FROM (
  SELECT experiment, max({{'v': mean, 'pm': -({_pos(MODELS, 'model')}), 'pj': -({_pos(JOBS, 'job')}),
    'model': model, 'job': job, 'n': n_top, 'm': mean}}) AS b FROM best_ntop GROUP BY experiment)"""
WINNER_SCORES = "SELECT s.* FROM scores s JOIN best_cell w USING (experiment, job, model, n_top)"

SUM_CTES = BASE + [("means", MEANS), ("best_ntop", BEST_NTOP)]


def _sql(body, *extra, recursive=False):
    return with_fixtures(body, "w3", extra=list(extra), recursive=recursive)


def _scores(spark, sf_dir):
    return rs.run_scores(predictions(spark, sf_dir))


@query("rs_scores_long", _sql(
    f"""SELECT s.experiment, s.seed, s.job, s.n_top, s.model, s.metric, round(s.value, 6) AS value FROM
  (SELECT DISTINCT experiment, seed FROM w3) p
  JOIN scores s ON s.experiment = p.experiment AND s.seed = p.seed
  WHERE s.job IN ({', '.join(f"'{j}'" for j in PLAN_JOBS)}) AND s.n_top IN ({', '.join(map(str, N_TOPS))})
    AND s.model IN ({', '.join(f"'{m}'" for m in MODELS)})""", *BASE))
def rs_scores_long(spark, sf_dir):
    pred = predictions(spark, sf_dir)
    plan = rs.plan_table(pred, PLAN_JOBS, N_TOPS, MODELS)
    out = rs.scores_long(plan, rs.run_scores(pred))
    return out.select(*rs.RUN, "metric", r6("value").alias("value"))


@query("rs_best_n_top", _sql("SELECT experiment, job, model, n_top, round(mean, 6) AS mean FROM best_ntop", *SUM_CTES))
def rs_best_n_top(spark, sf_dir):
    b = rs.best_n_top(_scores(spark, sf_dir))
    return b.select("experiment", "job", "model", "n_top", r6("mean").alias("mean"))


@query("rs_score_matrix", _sql(
    "SELECT experiment, model, " + ", ".join(f"round(max(CASE WHEN job = '{j}' THEN mean END), 6) AS {j}" for j in JOBS)
    + " FROM best_ntop GROUP BY experiment, model", *SUM_CTES))
def rs_score_matrix(spark, sf_dir):
    m = rs.score_matrix(_scores(spark, sf_dir), JOBS)
    return m.select("experiment", "model", *[r6(j).alias(j) for j in JOBS])


@query("rs_best_model_per_job", _sql(
    "SELECT experiment, job, model, n_top, round(mean, 6) AS mean FROM best_model_job", *SUM_CTES,
    ("best_model_job", BEST_MODEL_JOB)))
def rs_best_model_per_job(spark, sf_dir):
    b = rs.best_model_per_job(_scores(spark, sf_dir), MODELS)
    return b.select("experiment", "job", "model", "n_top", r6("mean").alias("mean"))


@query("rs_best_job_model", _sql(
    "SELECT experiment, model, job, n_top, round(mean, 6) AS mean FROM best_cell", *SUM_CTES, ("best_cell", BEST_CELL)))
def rs_best_job_model(spark, sf_dir):
    b = rs.best_job_model(_scores(spark, sf_dir), MODELS, JOBS)
    return b.select("experiment", "model", "job", "n_top", r6("mean").alias("mean"))


@query("rs_experiment_summary", _sql(
    """SELECT w.experiment, w.job, w.model, w.n_top, s.n_values, round(s.min_value, 6) AS min_value,
  round(s.max_value, 6) AS max_value, round(s.mean_value, 6) AS mean_value, l.values_by_seed
FROM best_cell w JOIN (SELECT experiment, count(value) AS n_values, min(value) AS min_value, max(value) AS max_value,
  avg(value) AS mean_value FROM winner_scores WHERE metric = 'roc_auc' GROUP BY experiment) s USING (experiment)
JOIN (SELECT experiment, string_agg(concat(metric, '=', vs), ';' ORDER BY metric) AS values_by_seed FROM (
  SELECT experiment, metric, string_agg(CAST(CAST(floor(value * 1e6 + 0.5) AS BIGINT) AS VARCHAR), ',' ORDER BY seed) AS vs
  FROM winner_scores GROUP BY experiment, metric) GROUP BY experiment) l USING (experiment)""",
    *SUM_CTES, ("best_cell", BEST_CELL), ("winner_scores", WINNER_SCORES)))
def rs_experiment_summary(spark, sf_dir):
    s = rs.experiment_summary(_scores(spark, sf_dir), MODELS, JOBS)
    return s.select("experiment", "job", "model", "n_top", "n_values",
                    *[r6(c).alias(c) for c in ("min_value", "max_value", "mean_value")], _listed("values").alias("values_by_seed"))


def _listed(col: str):
    """A map metric → values as text: metric=v,v,v;… with values in whole millionths (missing ones left out)."""
    micro = F.transform_values(col, lambda _, v: F.array_join(F.transform(v, lambda x: F.floor(x * 1e6 + 0.5).cast("bigint").cast("string")), ","))
    return F.array_join(F.transform(F.map_entries(micro), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


@query("rs_mean_std", _sql(
    "SELECT experiment, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std "
    "FROM winner_scores GROUP BY experiment, metric", *SUM_CTES, ("best_cell", BEST_CELL), ("winner_scores", WINNER_SCORES)))
def rs_mean_std(spark, sf_dir):
    m = rs.mean_std_results(_scores(spark, sf_dir), MODELS, JOBS)
    return m.select("experiment", "metric", r6("mean").alias("mean"), r6("std").alias("std"))


def _mwu_sql(samples_sql: str, groups: list[str], extra_ctes) -> str:
    g = ", ".join(groups)
    on = " AND ".join(f"s.{c} = t.{c}" for c in groups)
    z = "((u - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tie / ((n1 + n2) * (n1 + n2 - 1)))))"
    pnorm = f"(1.0 - {erf_sql(f'({z} / {math.sqrt(2.0)!r})')})"
    stats = f"""SELECT *, greatest(u1, n1 * n2 - u1) AS u FROM (
  SELECT s.*, t.tie, r1 - n1 * (n1 + 1) / 2.0 AS u1 FROM
   (SELECT {g}, CAST(sum(CASE WHEN sample = 'a' THEN 1 ELSE 0 END) AS BIGINT) AS n1,
      CAST(sum(CASE WHEN sample = 'b' THEN 1 ELSE 0 END) AS BIGINT) AS n2, sum(CASE WHEN sample = 'a' THEN r END) AS r1
    FROM (SELECT *, rank() OVER (PARTITION BY {g} ORDER BY value) + (count(*) OVER (PARTITION BY {g}, value) - 1) / 2.0 AS r
          FROM samples) GROUP BY {g}) s
  JOIN (SELECT {g}, sum(CAST(c AS DOUBLE) * c * c - c) AS tie FROM (SELECT {g}, value, count(*) AS c FROM samples GROUP BY {g}, value)
        GROUP BY {g}) t ON {on})"""
    ctes = list(extra_ctes) + [
        ("samples", samples_sql), ("mw", stats),
        ("sizes", "SELECT DISTINCT n1, n2 FROM mw WHERE least(n1, n2) <= 8 AND tie = 0"),
        ("comb", "SELECT n1, n2, 0 AS k, 0 AS last, 0 AS s FROM sizes UNION ALL SELECT c.n1, c.n2, c.k + 1, r.r, c.s + r.r "
                 "FROM comb c JOIN range(1, 200) r(r) ON r.r > c.last AND r.r <= c.n1 + c.n2 WHERE c.k < c.n1"),
        ("dist", "SELECT n1, n2, CAST(s - n1 * (n1 + 1) / 2 AS DOUBLE) AS ua, count(*) AS c FROM comb WHERE k = n1 GROUP BY ALL"),
    ]
    body = f"""SELECT {g}, n1, n2, u, round(CASE WHEN least(n1, n2) <= 8 AND tie = 0 THEN
    least(2.0 * (CAST((SELECT sum(c) FROM dist d WHERE d.n1 = mw.n1 AND d.n2 = mw.n2 AND d.ua >= mw.u) AS DOUBLE)
                 / CAST((SELECT sum(c) FROM dist d WHERE d.n1 = mw.n1 AND d.n2 = mw.n2) AS DOUBLE)), 1.0)
  ELSE least(greatest({pnorm}, 0.0), 1.0) END, 2) AS p FROM mw"""
    return _sql(body, *ctes, recursive=True)


@query("rs_mann_whitney", _mwu_sql(
    "SELECT job, n_top, model, CASE WHEN experiment = 'exp0' THEN 'a' ELSE 'b' END AS sample, value FROM scores "
    "WHERE metric = 'roc_auc' AND value IS NOT NULL", ["job", "n_top", "model"], BASE))
def rs_mann_whitney(spark, sf_dir):
    s = _scores(spark, sf_dir).where((F.col("metric") == "roc_auc") & F.col("value").isNotNull())
    samples = s.select("job", "n_top", "model", F.when(F.col("experiment") == "exp0", "a").otherwise("b").alias("sample"), "value")
    return rs.mann_whitney(samples, ["job", "n_top", "model"])


@query("rs_mwu_jobs", _mwu_sql(
    """SELECT a.experiment, a.job AS job_a, b.job AS job_b, x.sample, x.value FROM
  (SELECT DISTINCT experiment, job FROM best_model_job) a JOIN (SELECT DISTINCT experiment, job FROM best_model_job) b
    ON a.experiment = b.experiment AND a.job < b.job
  JOIN (SELECT s.experiment, s.job, s.value, 'a' AS sample FROM scores s JOIN best_model_job m USING (experiment, job, model, n_top)
        WHERE s.metric = 'roc_auc'
        UNION ALL
        SELECT s.experiment, s.job, s.value, 'b' AS sample FROM scores s JOIN best_model_job m USING (experiment, job, model, n_top)
        WHERE s.metric = 'roc_auc') x
    ON x.experiment = a.experiment AND ((x.sample = 'a' AND x.job = a.job) OR (x.sample = 'b' AND x.job = b.job))""",
    ["experiment", "job_a", "job_b"], SUM_CTES + [("best_model_job", BEST_MODEL_JOB)]))
def rs_mwu_jobs(spark, sf_dir):
    return rs.mwu_jobs_matrix(_scores(spark, sf_dir), MODELS)


@query("rs_mwu_experiments", _mwu_sql(
    """SELECT a.experiment AS exp_a, b.experiment AS exp_b, x.sample, x.value FROM
  (SELECT DISTINCT experiment FROM best_cell) a JOIN (SELECT DISTINCT experiment FROM best_cell) b ON a.experiment < b.experiment
  JOIN (SELECT experiment, value, 'a' AS sample FROM winner_scores WHERE metric = 'roc_auc'
        UNION ALL SELECT experiment, value, 'b' AS sample FROM winner_scores WHERE metric = 'roc_auc') x
    ON (x.sample = 'a' AND x.experiment = a.experiment) OR (x.sample = 'b' AND x.experiment = b.experiment)""",
    ["exp_a", "exp_b"], SUM_CTES + [("best_cell", BEST_CELL), ("winner_scores", WINNER_SCORES)]))
def rs_mwu_experiments(spark, sf_dir):
    return rs.mwu_experiments_matrix(_scores(spark, sf_dir), MODELS, JOBS)


@query("rs_predictions_by_id", _sql(
    f"""SELECT g.experiment, g.id, CASE WHEN w.model IN ({', '.join(f"'{m}'" for m in MARGIN_MODELS)})
  THEN 1.0 / (1.0 + exp(-m.mean_score)) ELSE m.mean_score END AS probability
FROM (SELECT DISTINCT e.experiment, p.id FROM w3 p, (SELECT DISTINCT experiment FROM best_cell) e) g
JOIN best_cell w ON w.experiment = g.experiment
LEFT JOIN (SELECT p.experiment, p.id, avg(p.score) AS mean_score FROM w3 p JOIN best_cell b USING (experiment, job, model, n_top)
           GROUP BY p.experiment, p.id) m ON m.experiment = g.experiment AND m.id = g.id""",
    *SUM_CTES, ("best_cell", BEST_CELL)))
def rs_predictions_by_id(spark, sf_dir):
    pred = predictions(spark, sf_dir)
    w = rs.best_job_model(rs.run_scores(pred), MODELS, JOBS)
    return rs.predictions_by_id(pred, pred, w, MARGIN_MODELS)


@query("rs_metric_boxplot", _sql(
    """SELECT q.experiment, q.metric, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) THEN value END), 6) AS whisker_lo,
  round(max(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN value END), 6) AS whisker_hi, count(*) AS n
FROM (SELECT experiment, metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
        quantile_cont(value, 0.75) AS q3 FROM winner_scores WHERE value IS NOT NULL GROUP BY experiment, metric) q
JOIN winner_scores w ON w.experiment = q.experiment AND w.metric = q.metric AND w.value IS NOT NULL
GROUP BY q.experiment, q.metric, q1, median, q3""",
    *SUM_CTES, ("best_cell", BEST_CELL), ("winner_scores", WINNER_SCORES)))
def rs_metric_boxplot(spark, sf_dir):
    b = rs.metric_boxplot_table(_scores(spark, sf_dir), MODELS, JOBS)
    return b.select("experiment", "metric", *[r6(c).alias(c) for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")], "n")


@query("rs_seed_completeness", _sql(
    f"""SELECT experiment, job, n_top, model, count(*) AS n_planned, count(has) AS n_done, count(*) = count(has) AS complete
FROM (SELECT p.*, d.has FROM (
    SELECT s0.experiment, s0.seed, j.job, CAST(n.n_top AS BIGINT) AS n_top, m.model
    FROM (SELECT DISTINCT experiment, seed FROM w3) s0
    CROSS JOIN (SELECT unnest([{', '.join(f"'{j}'" for j in PLAN_JOBS)}]) AS job) j
    CROSS JOIN (SELECT unnest([{', '.join(map(str, N_TOPS))}]) AS n_top) n
    CROSS JOIN (SELECT unnest([{', '.join(f"'{m}'" for m in MODELS)}]) AS model) m) p
  LEFT JOIN (SELECT DISTINCT {R}, 1 AS has FROM scores) d USING ({R}))
GROUP BY experiment, job, n_top, model""", *BASE))
def rs_seed_completeness(spark, sf_dir):
    pred = predictions(spark, sf_dir)
    return rs.seed_completeness(rs.plan_table(pred, PLAN_JOBS, N_TOPS, MODELS), rs.run_scores(pred))


@query("xp_representative_seed", _sql(
    """SELECT experiment, job, model, n_top, b.seed AS seed, round(b.value, 6) AS value, round(mean, 6) AS mean FROM (
  SELECT w.experiment, w.job, w.model, w.n_top, m.mean,
    max({'d': -abs(w.value - m.mean), 's': -w.seed, 'seed': w.seed, 'value': w.value}) AS b
  FROM winner_scores w JOIN (SELECT experiment, avg(value) AS mean FROM winner_scores WHERE metric = 'roc_auc'
    AND value IS NOT NULL GROUP BY experiment) m USING (experiment)
  WHERE w.metric = 'roc_auc' AND w.value IS NOT NULL GROUP BY w.experiment, w.job, w.model, w.n_top, m.mean)""",
    *SUM_CTES, ("best_cell", BEST_CELL), ("winner_scores", WINNER_SCORES)))
def xp_representative_seed(spark, sf_dir):
    scores = _scores(spark, sf_dir)
    r = rs.representative_seed(scores, rs.best_job_model(scores, MODELS, JOBS))
    return r.select("experiment", "job", "model", "n_top", "seed", r6("value").alias("value"), r6("mean").alias("mean"))
