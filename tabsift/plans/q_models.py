"""Model queries (ML-*): fits on the W1 study table (cleaned, split, train medians filled)
and regressions on W2; voting queries read the predictions fixture W3 and have oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.portable import r6
from ..operators import models as ml
from ..operators import select as sel
from ..operators.evaluate import roc_auc
from ..operators import summarise as rs
from ..operators.split import generate_seeds, repeated_stratified_kfold
from ..session import scratch_path
from ..sources.fixtures import W1_FEATURES, doc_features, predictions, with_fixtures
from . import sqlgen
from .flagship import VAR_P, prepared_train_test
from .jobs import job_name
from .q_scale import _prepared as w2_prepared
from .registry import query
from .study import run_study

SEED = 42
SEED_INIT = 545
N_TOPS = (2, 4, 6, 8, 10, 15, 20, 25, 30)  # feature counts of the verification
VERIFIED = ("logistic_regression", "svm", "forest", "adaboost", "xgboost")


def model_data(spark, sf_dir):
    """(all rows cached, features kept by the variance filter, train, test) of W1."""
    imp, feats = prepared_train_test(spark, sf_dir)
    imp = imp.cache()
    train = imp.where(F.col("part") == "train")
    kept = sel.variance_threshold(train, feats, VAR_P)
    return imp, kept, train, imp.where(F.col("part") == "test")


def fit_predict(spark, sf_dir, name, params):
    _, feats, train, test = model_data(spark, sf_dir)
    n = train.count()
    tr = ml.assemble(ml.class_weights(train, "target"), feats)
    model = ml.make_estimator(name, ml.BINARY, {**params, "n_rows": n}, SEED).fit(tr)
    out = ml.predict_scores(model, ml.assemble(test, feats), name)
    return out.select("id", F.col("target").cast("int").alias("y_true"), "score", "y_pred", "score_kind")


@query("ml_class_weights", with_fixtures(
    "SELECT target, n_c, round(CAST((SELECT count(*) FROM sp WHERE part = 'train') AS DOUBLE) / (2.0 * n_c), 6) AS weight "
    "FROM (SELECT target, count(*) AS n_c FROM sp WHERE part = 'train' GROUP BY target)", "w1",
    extra=[("sp", sqlgen.split("w1", 0.3, "'42'", [], ["target"]))]))
def ml_class_weights(spark, sf_dir):
    _, _, train, _ = model_data(spark, sf_dir)
    w = ml.class_weights(train, "target")
    return w.groupBy("target").agg(F.count(F.lit(1)).alias("n_c"), r6(F.first("weight")).alias("weight"))


MODEL_PARAMS = {
    "logistic_regression": {"penalty": "l2", "C": 1.0, "max_iter": 100},
    "svm": {"C": 1.0, "kernel": "rbf", "gamma": "scale", "max_iter": 100},
    "forest": {"n_estimators": 100, "criterion": "gini", "max_depth": 10, "max_features": "sqrt", "bootstrap": True},
    "extreme_forest": {"n_estimators": 100, "criterion": "gini", "max_depth": None, "max_features": "sqrt"},
    "adaboost": {"n_estimators": 10, "learning_rate": 1.0},
    "xgboost": {"n_estimators": 10, "learning_rate": 0.1, "max_depth": 3},
}

for _name, _params in MODEL_PARAMS.items():
    def _q(spark, sf_dir, _n=_name, _p=_params):
        return fit_predict(spark, sf_dir, _n, _p)
    query(f"ml_{_name}")(_q)


REG_PARAMS = {"lasso": {"alpha": 10.0}, "lassolars": {"alpha": 10.0}, "elastic_net": {"alpha": 10.0, "l1_ratio": 0.5},
              "omp": {"n_nonzero_coefs": 3}}
REG_FEATS = ["acctbal", "order_month", "priority", "nation", "is_building", "n_lines", "qty", "price", "disc", "tax"]

REG_TREES = {"forest": {"n_estimators": 10, "max_depth": 5}, "extreme_forest": {"n_estimators": 10, "max_depth": 5},
             "adaboost": {"n_estimators": 10, "learning_rate": 1.0}, "xgboost": {"n_estimators": 10, "learning_rate": 0.1, "max_depth": 3}}

for _name, _params in {**REG_PARAMS, **REG_TREES}.items():
    def _r(spark, sf_dir, _n=_name, _p=_params):
        d = w2_prepared(spark, sf_dir).cache()
        tr = ml.assemble(d.where("part = 'train'"), REG_FEATS)
        model = ml.make_estimator(_n, ml.REGRESSION, _p, SEED, label="totalprice").fit(tr)
        out = ml.predict_scores(model, ml.assemble(d.where("part = 'test'"), REG_FEATS), _n, ml.REGRESSION)
        return out.select("id", F.col("totalprice").alias("y_true"), "score")
    query(f"ml_{_name}" + ("_regression" if _name in REG_TREES else ""))(_r)


#: The configured grids of the models whose points are fitted together (fixed values), and the folds.
STRENGTHS = [0.0001, 0.001, 0.01, 0.1, 1, 10, 100, 1000, 10000]
LOGISTIC_GRID = {"penalty": ["l1", "l2", "elasticnet"], "C": STRENGTHS, "solver": ["saga"], "warm_start": [True, False], "max_iter": [10000]}
SVM_GRID = {"C": STRENGTHS, "kernel": ["poly", "rbf", "sigmoid"], "gamma": ["scale", "auto"], "max_iter": [10000]}
FOLDS = (3, 10)


@query("ml_grid_search")
def ml_grid_search(spark, sf_dir):
    """ML-12: all points of the configured logistic grid over 3 × 10 folds."""
    _, feats, train, _ = model_data(spark, sf_dir)
    folds = repeated_stratified_kfold(train, *FOLDS, SEED)
    _, _, cv = ml.grid_search(train, feats, "logistic_regression", LOGISTIC_GRID, folds)
    return cv


@query("ml_svm_kernels")
def ml_svm_kernels(spark, sf_dir):
    """ML-2: a machine of each kernel on the normalised study table; margins and Platt's probabilities of the test rows."""
    from ..operators.scale import normalise
    imp, feats, _, _ = model_data(spark, sf_dir)
    scaled, _ = normalise(imp, feats, "z_score_norm")
    train, test = (scaled.where(F.col("part") == p) for p in ("train", "test"))
    weighted, out = ml.class_weights(ml.assemble(train, feats), "target"), None
    for kernel in SVM_GRID["kernel"]:
        model = ml.make_estimator("svm", ml.BINARY, {"C": 1.0, "kernel": kernel, "gamma": SVM_GRID["gamma"][0]}, SEED).fit(weighted)
        pr = ml.predict_scores(model, ml.assemble(test, feats), "svm")
        pr = pr.select(F.lit(kernel).alias("kernel"), "id", F.col("target").cast("int").alias("y_true"), "score", "prob1")
        out = pr if out is None else out.unionByName(pr)
    return out


R = "experiment, seed, job, n_top"


@query("ml_voting_soft", with_fixtures(
    f"SELECT {R}, id, avg(score) AS proba, count(DISTINCT model) AS n_models, "
    f"CASE WHEN avg(score) >= 0.5 THEN 1 ELSE 0 END AS y_pred FROM w3 GROUP BY {R}, id", "w3"))
def ml_voting_soft(spark, sf_dir):
    return ml.soft_vote(predictions(spark, sf_dir), ["experiment", "seed", "job", "n_top", "id"])


@query("ml_voting_regression", with_fixtures(
    f"SELECT {R}, id, avg(score) AS prediction, count(DISTINCT model) AS n_models FROM w3 GROUP BY {R}, id", "w3"))
def ml_voting_regression(spark, sf_dir):
    return ml.vote_regression(predictions(spark, sf_dir), ["experiment", "seed", "job", "n_top", "id"])


@query("ml_verify_top_n")
def ml_verify_top_n(spark, sf_dir):
    """ML-16: for every n of the list (≤ the number of ranked features), each model on the top n
    features of the ranking; AUC on the test part."""
    _, feats, train, test = model_data(spark, sf_dir)
    ranking = [r["feature"] for r in sel.target_corr_ranking(train, feats).orderBy("rank").collect()]
    pred = ml.verify_top_n(train, test, ranking, N_TOPS, {m: MODEL_PARAMS[m] for m in VERIFIED}, seed=SEED)
    return roc_auc(pred, ["n_top", "model"])


E2E_SEEDS = 2
E2E_JOBS = (["variance_threshold", "z_score_norm", "correlation", "mrmr"], ["variance_threshold", "z_score_norm", "sulov"])
E2E_N_TOPS = (2, 4)
E2E_MODELS = ("logistic_regression", "forest")


def end_to_end(spark, sf_dir, n_seeds=E2E_SEEDS, jobs=E2E_JOBS, n_tops=E2E_N_TOPS, models=E2E_MODELS):
    """seeds → split → impute → jobs → verification: the predictions of every run, from a study's folder."""
    return run_study(spark, doc_features(spark, sf_dir), W1_FEATURES, scratch_path(spark, "study"), "exp0", generate_seeds(SEED_INIT, n_seeds), jobs, n_tops,
                     {m: MODEL_PARAMS[m] for m in models}, model_seed=SEED)


@query("run_end_to_end")
def run_end_to_end(spark, sf_dir):
    """One study from seeds to the winner: its scores at the Youden threshold and the winning cell, from real predictions."""
    pred = end_to_end(spark, sf_dir)
    scores = rs.run_scores(pred, youden=True)
    winner = rs.best_job_model(scores, list(E2E_MODELS), [job_name(j) for j in E2E_JOBS]).select("experiment", "job", "model", "n_top")
    return scores.join(F.broadcast(winner.withColumn("wins", F.lit(True))), ["experiment", "job", "model", "n_top"], "left").select(
        "experiment", "seed", "job", "n_top", "model", "metric", r6("value").alias("value"), F.coalesce("wins", F.lit(False)).alias("wins"))


@query("ml_predict_scores")
def ml_predict_scores(spark, sf_dir):
    """ML-17: margins of a margin model and probabilities of a tree model, side by side."""
    a = fit_predict(spark, sf_dir, "logistic_regression", MODEL_PARAMS["logistic_regression"]).withColumn("model", F.lit("logistic_regression"))
    b = fit_predict(spark, sf_dir, "forest", MODEL_PARAMS["forest"]).withColumn("model", F.lit("forest"))
    return a.unionByName(b)
