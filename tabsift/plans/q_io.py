"""Source and sink queries (IO-*): each writes to a fresh folder under the shared
checkpoint directory and reads the data back, with oracle SQL for what comes back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.portable import r6, rhalf_sql
from ..operators import clean as cl
from ..operators import explore as ex
from ..operators import summarise as rs
from ..session import scratch_path
from ..sources import io
from ..sources.fixtures import (W1_FEATURES, W2_FEATURES, doc_features, order_features, predictions, raw_strings,
                                with_fixtures)
from .q_clean import W5_COERCED, W5_EMPTY_KEPT, zero_rule_sql
from .q_explore import EX1, EX1_FILL, LIM_SQL, W1_KEPT, _target_corr_sql
from .q_summarise import BASE, BEST_CELL, JOBS, MODELS, N_TOPS, PLAN_JOBS, SUM_CTES, WINNER_SCORES
from .q_summarise import MARGIN_MODELS
from .q_evaluate import R
from .registry import query


@query("io_read_csv", with_fixtures(
    "SELECT CAST(id AS INTEGER) AS id, brand, CAST(brand_no AS INTEGER) AS brand_no, size_txt, type_txt, empty_txt, "
    "CAST(target_txt AS INTEGER) AS target_txt FROM w5", "w5"))
def io_read_csv(spark, sf_dir):
    path = io.save_frame(raw_strings(spark, sf_dir), scratch_path(spark, "raw_strings_csv"), "csv")
    return io.read_csv(spark, path)


@query("io_from_frame", with_fixtures("SELECT id, target, " + ", ".join(W1_FEATURES) + " FROM w1", "w1"))
def io_from_frame(spark, sf_dir):
    io.from_frame(spark, doc_features(spark, sf_dir), "doc_features_view")
    return spark.sql("SELECT id, target, " + ", ".join(W1_FEATURES) + " FROM doc_features_view")


CLEAN_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("brand_no", T.DoubleType()),
                             T.StructField("size_txt", T.DoubleType()), T.StructField("target_txt", T.DoubleType())])


@query("io_save_load", with_fixtures(
    "SELECT id, " + ", ".join(f"{zero_rule_sql('c', f)} AS {f}" for f in W5_EMPTY_KEPT if f != "target_txt")
    + ", target_txt FROM c WHERE target_txt IS NOT NULL", "w5", extra=[("c", W5_COERCED)]))
def io_save_load(spark, sf_dir):
    clean = cl.clean_up(raw_strings(spark, sf_dir), "id", "target_txt")
    path = io.save_frame(clean, scratch_path(spark, "clean_frame"))
    return io.load_frame(spark, path, CLEAN_SCHEMA)


def _write_scores(spark, sf_dir):
    """Write the per-run scores partitioned by experiment and seed; return (path, pinned schema)."""
    scores = rs.run_scores(predictions(spark, sf_dir))
    return io.save_results(scores, scratch_path(spark, "scores")), scores.schema


@query("io_results_roundtrip", with_fixtures(f"SELECT {R}, metric, round(value, 6) AS value FROM scores", "w3", extra=BASE))
def io_results_roundtrip(spark, sf_dir):
    back = io.load_results(spark, *_write_scores(spark, sf_dir))
    return back.select(*rs.RUN, "metric", r6("value").alias("value"))


PLAN_SQL = (f"SELECT s0.experiment, s0.seed, j.job, CAST(n.n_top AS BIGINT) AS n_top, m.model FROM "
            f"(SELECT DISTINCT experiment, seed FROM w3) s0 "
            f"CROSS JOIN (SELECT unnest([{', '.join(repr(j) for j in PLAN_JOBS)}]) AS job) j "
            f"CROSS JOIN (SELECT unnest([{', '.join(map(str, N_TOPS))}]) AS n_top) n "
            f"CROSS JOIN (SELECT unnest([{', '.join(repr(m) for m in MODELS)}]) AS model) m")


@query("io_resume_plan", with_fixtures(
    f"SELECT * FROM plan WHERE ({R}) NOT IN (SELECT ({R}) FROM scores)", "w3", extra=BASE + [("plan", PLAN_SQL)]))
def io_resume_plan(spark, sf_dir):
    pred = predictions(spark, sf_dir)
    done = io.load_results(spark, *_write_scores(spark, sf_dir))
    plan = rs.plan_table(pred, PLAN_JOBS, N_TOPS, MODELS)
    return io.resume_plan(plan, done, rs.RUN).select(*rs.RUN)


@query("io_target_corr_tsv", with_fixtures("SELECT feature, round(r, 2) + 0.0 AS corr FROM tc", "w1",
                                           extra=[EX1_FILL, EX1] + _target_corr_sql("ex1", W1_KEPT)))
def io_target_corr_tsv(spark, sf_dir):
    out, kept = ex.explore_prepare(doc_features(spark, sf_dir), W1_FEATURES)
    path = io.save_frame(ex.corr_to_target(out, kept), scratch_path(spark, "target_corr_tsv"), "csv", sep="\t")
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("corr", T.DoubleType())])
    return io.load_frame(spark, path, schema, "csv", sep="\t")


@query("io_outlier_frame", with_fixtures(
    "SELECT id, target, " + ", ".join(
        f"CASE WHEN {f} > (SELECT lower FROM lim WHERE feature = '{f}') AND {f} < (SELECT upper FROM lim WHERE feature = '{f}') "
        f"THEN {f} END AS {f}" for f in W2_FEATURES) + " FROM w2", "w2", extra=LIM_SQL))
def io_outlier_frame(spark, sf_dir):
    masked = ex.drop_outliers(order_features(spark, sf_dir), W2_FEATURES)
    return io.load_frame(spark, io.save_frame(masked, scratch_path(spark, "outliers_removed")))


@query("io_mean_results", with_fixtures(
    f"SELECT experiment, metric, {rhalf_sql('avg(value)', 2)} AS mean, {rhalf_sql('stddev_pop(value)', 2)} AS std "
    "FROM winner_scores GROUP BY experiment, metric", "w3", extra=SUM_CTES + [("best_cell", BEST_CELL), ("winner_scores", WINNER_SCORES)]))
def io_mean_results(spark, sf_dir):
    m = rs.mean_std_results(rs.run_scores(predictions(spark, sf_dir)), MODELS, JOBS)
    path = io.write_mean_results(m, scratch_path(spark, "mean_results"))
    schema = T.StructType([T.StructField("experiment", T.StringType()), T.StructField("metric", T.StringType()),
                           T.StructField("mean", T.DoubleType()), T.StructField("std", T.DoubleType())])
    return io.load_frame(spark, path, schema, "csv")


@query("io_predictions_csv", with_fixtures(
    f"""SELECT g.experiment, g.id, round(CASE WHEN w.model IN ({', '.join(repr(m) for m in MARGIN_MODELS)})
  THEN 1.0 / (1.0 + exp(-m.mean_score)) ELSE m.mean_score END, 6) AS probability
FROM (SELECT DISTINCT e.experiment, p.id FROM w3 p, (SELECT DISTINCT experiment FROM best_cell) e) g
JOIN best_cell w ON w.experiment = g.experiment
LEFT JOIN (SELECT p.experiment, p.id, avg(p.score) AS mean_score FROM w3 p JOIN best_cell b USING (experiment, job, model, n_top)
           GROUP BY p.experiment, p.id) m ON m.experiment = g.experiment AND m.id = g.id""",
    "w3", extra=SUM_CTES + [("best_cell", BEST_CELL)]))
def io_predictions_csv(spark, sf_dir):
    pred = predictions(spark, sf_dir)
    w = rs.best_job_model(rs.run_scores(pred), MODELS, JOBS)
    p = rs.predictions_by_id(pred, pred, w, MARGIN_MODELS)
    path = io.write_predictions(p.select("experiment", "id", r6("probability").alias("probability")),
                                scratch_path(spark, "predictions_with_id"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("probability", T.DoubleType()),
                           T.StructField("experiment", T.StringType())])
    return io.load_frame(spark, path, schema, "csv").select("experiment", "id", "probability")


REGISTRY = ["exp1"]


@query("io_collect_experiments", with_fixtures(
    "SELECT experiment, count(DISTINCT (seed, job, n_top, model)) AS n_runs, count(DISTINCT seed) AS n_seeds "
    f"FROM scores WHERE experiment IN ('exp0', 'exp1') AND experiment IN ({', '.join(repr(e) for e in REGISTRY)}) "
    "GROUP BY experiment", "w3", extra=BASE))
def io_collect_experiments(spark, sf_dir):
    path, schema = _write_scores(spark, sf_dir)
    registry = spark.createDataFrame([(e,) for e in REGISTRY], "experiment string")
    res = io.collect_experiments(spark, path, ["exp0", "exp1"], registry, schema)
    return res.groupBy("experiment").agg(
        F.countDistinct("seed", "job", "n_top", "model").alias("n_runs"), F.countDistinct("seed").alias("n_seeds"))
