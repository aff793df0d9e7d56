"""Model-driven selection, explanation, projection, oversampling, iterative imputation and power
normalisation queries (FS-3/8/9/10/11/12, XP-2…5, DR-1, OS-1, IMP-3, NO-8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.portable import r6
from ..operators import explain as xp
from ..operators import models as ml
from ..operators import models_select as ms
from ..operators import select as sel
from ..operators import summarise as rs
from ..operators.impute_iterative import iterative_impute
from ..operators.reduce import pca_scores
from ..operators.resample import random_oversample
from ..operators.scale import normalise
from ..operators.split import stratified_split
from ..sources.fixtures import W2_FEATURES, doc_features, order_features, predictions, with_fixtures
from . import sqlgen
from .q_models import MODEL_PARAMS, SEED, model_data
from .q_scale import _prepared as w2_prepared
from .q_summarise import BEST_CELL, JOBS, MODELS, SUM_CTES, WINNER_SCORES
from .registry import query


@query("fs_permutation_importance")
def fs_permutation_importance(spark, sf_dir):
    _, feats, train, _ = model_data(spark, sf_dir)
    return ms.permutation_importance(train, feats, seed=SEED)


@query("fs_gbt_recursive")
def fs_gbt_recursive(spark, sf_dir):
    _, feats, train, _ = model_data(spark, sf_dir)
    chosen = ms.gbt_recursive_importance(train, feats, seed=SEED)
    return spark.createDataFrame([(i + 1, f) for i, f in enumerate(chosen)], "pos bigint, feature string")


def _rfe_query(name, params, **how):
    def q(spark, sf_dir):
        _, feats, train, _ = model_data(spark, sf_dir)
        ordered, curve = ms.rfecv(train, feats, name, params, seed=SEED, **how)
        ranks = spark.createDataFrame([(i + 1, f) for i, f in enumerate(ordered)], "pos bigint, feature string")
        return ranks.withColumn("model", F.lit(name))
    return q


query("fs_rfecv")(_rfe_query("logistic_regression", MODEL_PARAMS["logistic_regression"], n_repeats=10))
#: Tree models are fitted one by one: fewer trees than in the verification keep their 3 folds within minutes.
RFE_TREES = {"forest": {"n_estimators": 20, "max_depth": 5}, "extreme_forest": {"n_estimators": 20, "max_depth": 5}, "adaboost": {}, "xgboost": {}}
for _m, _fewer in RFE_TREES.items():
    query(f"fs_fr_{_m}")(_rfe_query(_m, {**MODEL_PARAMS[_m], **_fewer}))


@query("fs_rfe_curve_fit")
def fs_rfe_curve_fit(spark, sf_dir):
    """FS-13 on real fits: mean and std of the fold score per number of features."""
    _, feats, train, _ = model_data(spark, sf_dir)
    return ms.rfecv(train, feats, "logistic_regression", MODEL_PARAMS["logistic_regression"], seed=SEED, n_repeats=10)[1]


@query("fs_importance")
def fs_importance(spark, sf_dir):
    _, feats, train, _ = model_data(spark, sf_dir)
    return ms.importance_table(train, feats, "forest", MODEL_PARAMS["forest"], seed=SEED)


N_TOP = 6  # features of the explained model, best ranked first


def _shap(spark, sf_dir):
    _, feats, train, test = model_data(spark, sf_dir)
    top = [r["feature"] for r in sel.target_corr_ranking(train, feats).orderBy("rank").limit(N_TOP).collect()]
    n = train.count()
    model = ml.make_estimator("logistic_regression", ml.BINARY, {**MODEL_PARAMS["logistic_regression"], "n_rows": n},
                              SEED).fit(ml.assemble(ml.class_weights(train, "target"), top))
    return model, top, train, test


@query("xp_kernel_shap")
def xp_kernel_shap(spark, sf_dir):
    """XP-2: Shapley values of the class-1 probability (logistic model on the best ranked features)."""
    model, top, train, test = _shap(spark, sf_dir)
    return xp.shapley_values(model, "logistic_regression", test, train, top)


@query("xp_linear_shap")
def xp_linear_shap(spark, sf_dir):
    """XP-2 of the margin: the closed form over all train rows."""
    model, top, train, test = _shap(spark, sf_dir)
    return xp.linear_shapley(model, test, train, top)


@query("xp_shap_heatmap")
def xp_shap_heatmap(spark, sf_dir):
    model, top, train, test = _shap(spark, sf_dir)
    wide = xp.shap_heatmap(xp.linear_shapley(model, test, train, top), top)
    return wide.select("id", F.array(*[F.col(c) for c in top]).alias("phi"), "total")


@query("xp_shap_summary")
def xp_shap_summary(spark, sf_dir):
    model, top, train, test = _shap(spark, sf_dir)
    return xp.shap_summary(xp.shapley_values(model, "logistic_regression", test, train, top))


@query("xp_coefficients")
def xp_coefficients(spark, sf_dir):
    model, top, _, _ = _shap(spark, sf_dir)
    return xp.coefficients_table(spark, model, top)


REP_SQL = SUM_CTES + [("best_cell", BEST_CELL), ("winner_scores", WINNER_SCORES), ("rep", """SELECT experiment, b.seed AS seed FROM (
  SELECT w.experiment, max({'d': -abs(w.value - m.mean), 's': -w.seed, 'seed': w.seed}) AS b
  FROM winner_scores w JOIN (SELECT experiment, avg(value) AS mean FROM winner_scores WHERE metric = 'roc_auc'
    AND value IS NOT NULL GROUP BY experiment) m USING (experiment)
  WHERE w.metric = 'roc_auc' AND w.value IS NOT NULL GROUP BY w.experiment)""")]


@query("xp_rebuild_split", with_fixtures(
    "SELECT id, target, part FROM sp", "w1", "w3",
    extra=REP_SQL + [("sp", sqlgen.split("w1", 0.3, "(SELECT seed FROM rep WHERE experiment = 'exp0')", [], ["target"]))]))
def xp_rebuild_split(spark, sf_dir):
    """XP-5: the representative seed (XP-1) rebuilds exactly the same split."""
    scores = rs.run_scores(predictions(spark, sf_dir))
    rep = rs.representative_seed(scores, rs.best_job_model(scores, MODELS, JOBS))
    seed = rep.where(F.col("experiment") == "exp0").first()["seed"]
    return stratified_split(doc_features(spark, sf_dir), 0.3, int(seed)).select("id", "target", "part")


@query("dr_pca")
def dr_pca(spark, sf_dir):
    imp, feats, _, _ = model_data(spark, sf_dir)
    out, _ = normalise(imp, feats, "z_score_norm")
    s = pca_scores(out, feats)
    return s.select("id", "target", *[r6(c).alias(c) for c in s.columns if c.startswith("pc")])


@query("os_random_oversample", with_fixtures(
    "SELECT t.id, t.target, CAST(1 + coalesce(d.n, 0) AS BIGINT) AS n_copies FROM tr t LEFT JOIN "
    "(SELECT r.id, count(*) AS n FROM rws r JOIN dpos p ON r.target = p.target AND r.pos = p.pos GROUP BY r.id) d USING (id)",
    "w1", extra=[
        ("sp", sqlgen.split("w1", 0.3, "'42'", [], ["target"])),
        ("tr", "SELECT * FROM sp WHERE part = 'train'"),
        ("cls", "SELECT target, count(*) AS n_c FROM tr GROUP BY target"),
        ("need", "SELECT target, n_c, max(n_c) OVER () - n_c AS need FROM cls"),
        ("draws", "SELECT target, n_c, unnest(generate_series(0, need - 1)) AS k FROM need WHERE need > 0"),
        ("dpos", f"SELECT target, {sqlgen.h52(chr(39) + '42' + chr(39), chr(39) + 'os' + chr(39), 'target', 'k')} % n_c AS pos FROM draws"),
        ("rws", f"SELECT id, target, row_number() OVER (PARTITION BY target ORDER BY "
                f"{sqlgen.h13('id', chr(39) + '42' + chr(39), chr(39) + 'os' + chr(39))}, id) - 1 AS pos FROM tr")]))
def os_random_oversample(spark, sf_dir):
    train = stratified_split(doc_features(spark, sf_dir), 0.3, 42).where(F.col("part") == "train")
    over = random_oversample(train, 42)
    return over.groupBy("id", "target").agg(F.count(F.lit(1)).alias("n_copies"))


@query("imp_iterative")
def imp_iterative(spark, sf_dir):
    d = stratified_split(order_features(spark, sf_dir), 0.3, 7)
    out = iterative_impute(d, W2_FEATURES)
    return out.select("id", "part", *[r6(f).alias(f) for f in W2_FEATURES])


@query("no_power")
def no_power(spark, sf_dir):
    out, _ = normalise(w2_prepared(spark, sf_dir), W2_FEATURES, "power_norm")
    return out.select("id", "target", "part", *[r6(f).alias(f) for f in W2_FEATURES])

