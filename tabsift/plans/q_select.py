"""Feature selection queries (FS-*), with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.portable import r6, rhalf_sql
from ..operators import evaluate as ev
from ..operators import select as sel
from ..operators import split as sp
from ..sources.fixtures import W1_FEATURES, W2_FEATURES, doc_features, order_features, predictions, with_fixtures
from . import sqlgen
from .flagship import VAR_P, prepared_sql, prepared_train_test
from .jobs import run_job, run_jobs
from .q_evaluate import ST
from .q_scale import PREP as W2_PREP
from .q_scale import _prepared as w2_prepared
from .q_split_impute import N_SEEDS, SEED_INIT, SEEDS_SQL
from .registry import query

THR = f"CAST('{VAR_P * (1 - VAR_P)!r}' AS DOUBLE)"


def _moments_by(src: str, by: str) -> str:
    """Per (by…, feature) moments of value with target over a long table."""
    b = f"{by}, " if by else ""
    return (f"SELECT {b}feature, {sqlgen.moments('value', 'target')} FROM {src} WHERE value IS NOT NULL AND target IS NOT NULL "
            f"GROUP BY {b}feature")


@query("fs_variance", with_fixtures(
    f"SELECT feature, round(var_pop(value), 6) AS var, var_pop(value) > {THR} AS kept FROM imp WHERE part = 'train' GROUP BY feature",
    "w1", extra=prepared_sql()))
def fs_variance(spark, sf_dir):
    imp, feats = prepared_train_test(spark, sf_dir)
    v = sel.variance_table(imp.where(F.col("part") == "train"), feats)
    return v.select("feature", r6("var").alias("var"), (F.col("var") > VAR_P * (1 - VAR_P)).alias("kept"))


W2_TC = [("fpos", sqlgen.positions(W2_FEATURES)),
         ("tl", sqlgen.unpivot("w2", ["id", "target"], W2_FEATURES)),
         ("tc", "SELECT feature, abs(round(" + sqlgen.corr() + ", 2)) AS abs_corr FROM (" + _moments_by("tl", "") + ")"),
         ("rk", "SELECT feature, CAST(row_number() OVER (ORDER BY abs_corr DESC NULLS LAST, fpos) AS BIGINT) AS rank, abs_corr "
                "FROM tc JOIN fpos USING (feature)")]


@query("fs_target_corr_rank", with_fixtures("SELECT rank, feature, abs_corr FROM rk", "w2", extra=W2_TC))
def fs_target_corr_rank(spark, sf_dir):
    return sel.target_corr_ranking(order_features(spark, sf_dir), W2_FEATURES)


W2_PAIRS = [("wl", "SELECT u.*, p.fpos FROM (" + sqlgen.unpivot("w2", ["id"], W2_FEATURES) + ") u JOIN fpos p USING (feature)"),
            ("pc", "SELECT a, b, abs(round(" + sqlgen.corr() + ", 2)) AS ar FROM (" + sqlgen.pair_moments("wl") + ")"),
            ("both_", "SELECT a, b, ar FROM pc UNION ALL SELECT b AS a, a AS b, ar FROM pc"),
            ("drops", "SELECT DISTINCT x.a AS feature FROM both_ x JOIN rk ra ON ra.feature = x.a JOIN rk rb ON rb.feature = x.b "
                      "WHERE rb.rank < ra.rank AND x.ar > 0.95")]


@query("fs_correlation_filter", with_fixtures(
    "SELECT rank, feature, feature IN (SELECT feature FROM drops) AS dropped FROM rk", "w2", extra=W2_TC + W2_PAIRS))
def fs_correlation_filter(spark, sf_dir):
    w2 = order_features(spark, sf_dir)
    kept, ranking = sel.correlation_filter(w2, W2_FEATURES)
    return ranking.select("rank", "feature", (~F.col("feature").isin(kept)).alias("dropped"))


#: The configured number of features; the study tables have fewer, so all are ranked.
MRMR_FEATURES = 30


def _leading(v: str) -> str:
    """Exponent and leading digits of a positive number, so that rounding alone decides nothing."""
    return f"'e': floor(log10({v})), 'm': round(({v}) / pow(10.0, floor(log10({v}))), 9)"


def _mrmr_sql(src_long: str, feats, target_expr: str, task: str, extra_ctes) -> str:
    """One greedy step a feature, unrolled; src_long has (id, target, feature, value)."""
    if task == "binary_classification":
        fstat = ("SELECT feature, CASE WHEN k > 1 THEN (ssb / (k - 1)) / nullif(ssw / (n - k), 0) END AS f FROM "
                 "(SELECT feature, sum(nc) AS n, count(*) AS k, sum(wc) AS ssw, sum(nc * (mc - gm) * (mc - gm)) AS ssb FROM "
                 "(SELECT e.feature, e.target, CAST(count(*) AS DOUBLE) AS nc, avg(e.value) AS mc, var_pop(e.value) * count(*) AS wc, any_value(a.gm) AS gm "
                 "FROM enc e JOIN (SELECT feature, avg(value) AS gm FROM enc WHERE value IS NOT NULL GROUP BY feature) a USING (feature) "
                 "WHERE e.value IS NOT NULL GROUP BY e.feature, e.target) GROUP BY feature)")
    else:
        fstat = ("SELECT feature, (r * r) / nullif(1 - r * r, 0) * (n - 2) AS f FROM (SELECT feature, n, " + sqlgen.corr()
                 + " AS r FROM (" + _moments_by("enc", "") + "))")
    ctes = list(extra_ctes) + [
        ("t", f"SELECT id, {target_expr} AS target, feature, value FROM {src_long}"),
        ("nu", "SELECT feature, count(DISTINCT value) AS nu FROM t GROUP BY feature"),
        ("cstat", "SELECT feature, value, sum(target) AS sy, count(*) AS n FROM t WHERE feature IN "
                  "(SELECT feature FROM nu WHERE nu <= 5) AND value IS NOT NULL GROUP BY feature, value"),
        ("mall", "SELECT avg(target) AS m FROM (SELECT DISTINCT id, target FROM t)"),
        ("enc", "SELECT t.id, t.target, t.feature, CASE WHEN nu.nu <= 5 THEN CASE WHEN t.value IS NULL THEN NULL "
                "WHEN c.n > 1 THEN (c.sy - t.target) / (c.n - 1) ELSE (SELECT m FROM mall) END ELSE t.value END AS value "
                "FROM t JOIN nu USING (feature) LEFT JOIN cstat c ON c.feature = t.feature AND c.value = t.value"),
        ("fstat", fstat),
        ("mpos", sqlgen.positions(feats)),
        ("cand", "SELECT f.feature, f.f AS rel, p.fpos FROM fstat f JOIN mpos p USING (feature) WHERE f.f > 0 AND NOT isnan(f.f)"),
        ("el", "SELECT e.*, p.fpos FROM enc e JOIN mpos p USING (feature)"),
        ("pr", "SELECT a, b, coalesce(abs(" + sqlgen.corr() + "), 0) AS ar FROM (" + sqlgen.pair_moments("el") + ")"),
        ("pr2", "SELECT a, b, ar FROM pr UNION ALL SELECT b, a, ar FROM pr"),
        ("c1", f"SELECT CAST(1 AS BIGINT) AS rank, max({{{_leading('rel')}, 'p': -fpos, 'f': feature}}).f AS feature FROM cand"),
        *[(f"c{k}", f"SELECT * FROM c{k - 1} UNION ALL SELECT {k}, max({{{_leading('rel / greatest(red, 0.001)')}, 'p': -fpos, 'f': feature}}).f FROM ("
                    f"SELECT c.feature, c.rel, c.fpos, sum(coalesce(p.ar, 0)) / {k - 1} AS red FROM cand c CROSS JOIN c{k - 1} g LEFT JOIN pr2 p ON p.a = c.feature AND p.b = g.feature "
                    f"WHERE c.feature NOT IN (SELECT feature FROM c{k - 1} WHERE feature IS NOT NULL) GROUP BY c.feature, c.rel, c.fpos)") for k in range(2, len(feats) + 1)],
    ]
    body = f"SELECT rank, feature FROM c{len(feats)} WHERE feature IS NOT NULL"
    return body, ctes


def _fs5_sql():
    body, ctes = _mrmr_sql(
        "vk", W1_FEATURES, "target", "binary_classification",
        prepared_sql() + [("vk", f"SELECT id, target, feature, value FROM imp WHERE part = 'train' AND feature IN "
                                 f"(SELECT feature FROM imp WHERE part = 'train' GROUP BY feature HAVING var_pop(value) > {THR})")])
    return with_fixtures(body, "w1", extra=ctes)


@query("fs_mrmr", _fs5_sql())
def fs_mrmr(spark, sf_dir):
    imp, feats = prepared_train_test(spark, sf_dir)
    train = imp.where(F.col("part") == "train").cache()
    kept = sel.variance_threshold(train, feats, VAR_P)
    chosen = sel.mrmr(train, kept, MRMR_FEATURES)
    return spark.createDataFrame([(i + 1, f) for i, f in enumerate(chosen)], "rank bigint, feature string")


REG_FEATS = [f for f in W2_FEATURES if f != "totalprice"]


def _fs6_sql():
    body, ctes = _mrmr_sql("rl", REG_FEATS, "totalprice", "regression",
                           [("rl", "SELECT u.*, w.totalprice FROM (" + sqlgen.unpivot("w2", ["id"], REG_FEATS) + ") u "
                                   "JOIN w2 w USING (id)")])
    return with_fixtures(body, "w2", extra=ctes)


@query("fs_mrmr_regression", _fs6_sql())
def fs_mrmr_regression(spark, sf_dir):
    w2 = order_features(spark, sf_dir).drop("target").cache()
    chosen = sel.mrmr(w2, REG_FEATS, MRMR_FEATURES, target="totalprice", task="regression")
    return spark.createDataFrame([(i + 1, f) for i, f in enumerate(chosen)], "rank bigint, feature string")


def _sulov_sql():
    ctes = [("fpos", sqlgen.positions(W2_FEATURES)),
            ("ml", f"SELECT * FROM ({sqlgen.unpivot('w2', ['target'], W2_FEATURES)}) WHERE value IS NOT NULL"),
            ("mm", "SELECT feature, min(value) AS mn, max(value) AS mx FROM ml GROUP BY feature"),
            ("cells", "SELECT l.feature, CAST(CASE WHEN m.mx - m.mn > 0 THEN least(floor((l.value - m.mn) / (m.mx - m.mn) * 10), 9) "
                      "ELSE 0 END AS BIGINT) AS bin, l.target, count(*) AS nby FROM ml l JOIN mm m USING (feature) GROUP BY ALL"),
            ("mi", "SELECT feature, sum((CAST(nby AS DOUBLE) / n) * ln(CAST(nby AS DOUBLE) * n / (nb * ny))) AS mi FROM "
                   "(SELECT *, sum(nby) OVER (PARTITION BY feature) AS n, sum(nby) OVER (PARTITION BY feature, bin) AS nb, "
                   "sum(nby) OVER (PARTITION BY feature, target) AS ny FROM cells) GROUP BY feature"),
            ("mik", f"SELECT m.feature, m.mi, {rhalf_sql('m.mi', 9)} AS mi9, p.fpos FROM mi m JOIN fpos p USING (feature)"),
            ("wl", "SELECT u.*, p.fpos FROM (" + sqlgen.unpivot("w2", ["id"], W2_FEATURES) + ") u JOIN fpos p USING (feature)"),
            ("hi", "SELECT a, b FROM (SELECT a, b, " + sqlgen.corr() + " AS r FROM (" + sqlgen.pair_moments("wl") + ")) WHERE abs(r) > 0.95"),
            ("drop_", "SELECT CASE WHEN {'m': ka.mi9, 'p': -ka.fpos} > {'m': kb.mi9, 'p': -kb.fpos} THEN h.b ELSE h.a END AS feature "
                      "FROM hi h JOIN mik ka ON ka.feature = h.a JOIN mik kb ON kb.feature = h.b")]
    return with_fixtures("SELECT feature, round(mi, 6) AS mi, feature NOT IN (SELECT feature FROM drop_) AS kept FROM mik",
                         "w2", extra=ctes)


@query("fs_sulov", _sulov_sql())
def fs_sulov(spark, sf_dir):
    t = sel.sulov_table(order_features(spark, sf_dir), W2_FEATURES)
    return t.select("feature", r6("mi").alias("mi"), "kept")


@query("fs_rfe_curve", with_fixtures(
    "SELECT job, model, n_top AS n_features, round(avg(auc), 6) AS mean_score, round(stddev_pop(auc), 6) AS std_score FROM "
    "(SELECT experiment, seed, job, n_top, model, (R - P * (P + 1) / 2.0) / nullif(CAST(P * N AS DOUBLE), 0) AS auc FROM "
    "(SELECT experiment, seed, job, n_top, model, P, N, sum(pos * (cum_pos + cum_neg + (pos + neg + 1) / 2.0)) AS R FROM st "
    "GROUP BY ALL)) GROUP BY job, model, n_top", "w3", extra=[("st", ST)]))
def fs_rfe_curve(spark, sf_dir):
    auc = ev.roc_auc(predictions(spark, sf_dir))
    return (auc.groupBy("job", "model", F.col("n_top").alias("n_features"))
            .agg(r6(F.avg("roc_auc")).alias("mean_score"), r6(F.stddev_pop("roc_auc")).alias("std_score")))


SELECTED_SQL = [
    ("seeds", SEEDS_SQL), ("ws", "SELECT w1.*, s.seed FROM w1, seeds s"),
    ("spl", sqlgen.split("ws", 0.3, "seed", ["seed"], ["target"])),
    ("fpos", sqlgen.positions(W1_FEATURES)),
    ("sl", sqlgen.unpivot("(SELECT * FROM spl WHERE part = 'train')", ["seed", "id", "target"], W1_FEATURES)),
    ("sc", "SELECT seed, feature, abs(round(" + sqlgen.corr() + ", 2)) AS abs_corr FROM (" + _moments_by("sl", "seed") + ")"),
    ("selected", "SELECT seed, CAST(0 AS BIGINT) AS boot, 'corr_rank' AS job, CAST(row_number() OVER (PARTITION BY seed "
                 "ORDER BY abs_corr DESC NULLS LAST, fpos) AS BIGINT) AS rank, feature FROM sc JOIN fpos USING (feature)"),
    ("pts", "SELECT job, feature, CAST(sum(greatest(11 - rank, 1)) AS BIGINT) AS points FROM selected GROUP BY job, feature"),
]


def _selected(spark, sf_dir):
    ws = sp.with_seeds(doc_features(spark, sf_dir), sp.generate_seeds(SEED_INIT, N_SEEDS))
    train = sp.stratified_split(ws, 0.3).where(F.col("part") == "train")
    return sel.ranked_by_target_corr(train, W1_FEATURES, ["seed"]).withColumn("boot", F.lit(0).cast("bigint"))


@query("fs_feature_points", with_fixtures("SELECT job, feature, points FROM pts", "w1", extra=SELECTED_SQL))
def fs_feature_points(spark, sf_dir):
    return sel.feature_points(_selected(spark, sf_dir))


@query("fs_avg_ranking", with_fixtures(
    "SELECT job, feature, points, round(CAST(points AS DOUBLE) / sum(points) OVER (PARTITION BY job), 6) AS share, "
    "CAST(row_number() OVER (PARTITION BY job ORDER BY points DESC, feature) AS BIGINT) AS pos FROM pts", "w1", extra=SELECTED_SQL))
def fs_avg_ranking(spark, sf_dir):
    a = sel.avg_feature_ranking(_selected(spark, sf_dir))
    return a.select("job", "feature", "points", r6("share").alias("share"), "pos")


def _job_sql():
    ctes = W2_PREP + [
        ("fpos", sqlgen.positions(W2_FEATURES)),
        ("lg", sqlgen.unpivot("im", ["id", "target", "part"], W2_FEATURES)),
        ("v", f"SELECT * FROM lg WHERE feature IN (SELECT feature FROM lg WHERE part = 'train' GROUP BY feature "
              f"HAVING var_pop(value) > {THR})"),
        ("nu", "SELECT feature FROM v WHERE part = 'train' GROUP BY feature HAVING count(DISTINCT value) > 3"),
        ("zs", "SELECT feature, avg(value) AS mu, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS sd "
               "FROM v WHERE part = 'train' AND feature IN (SELECT feature FROM nu) GROUP BY feature"),
        ("tn", "SELECT v.id, v.target, v.feature, CASE WHEN zs.feature IS NULL THEN v.value ELSE (v.value - zs.mu) / zs.sd END AS value, "
               "fpos.fpos FROM v LEFT JOIN zs USING (feature) JOIN fpos USING (feature) WHERE v.part = 'train'"),
        ("tc", "SELECT feature, abs(round(" + sqlgen.corr() + ", 2)) AS abs_corr FROM (" + _moments_by("tn", "") + ")"),
        ("rk", "SELECT feature, row_number() OVER (ORDER BY abs_corr DESC NULLS LAST, fpos) AS rank FROM tc JOIN fpos USING (feature)"),
        ("pc", "SELECT a, b, abs(round(" + sqlgen.corr() + ", 2)) AS ar FROM (" + sqlgen.pair_moments("tn") + ")"),
        ("both_", "SELECT a, b, ar FROM pc UNION ALL SELECT b AS a, a AS b, ar FROM pc"),
        ("drops", "SELECT DISTINCT x.a AS feature FROM both_ x JOIN rk ra ON ra.feature = x.a JOIN rk rb ON rb.feature = x.b "
                  "WHERE rb.rank < ra.rank AND x.ar > 0.95"),
    ]
    body = ("SELECT CAST(row_number() OVER (ORDER BY fpos) AS BIGINT) AS pos, feature FROM fpos WHERE feature IN "
            "(SELECT feature FROM tc) AND feature NOT IN (SELECT feature FROM drops)")
    return with_fixtures(body, "w2", extra=ctes)


@query("fs_run_job", _job_sql())
def fs_run_job(spark, sf_dir):
    prep = w2_prepared(spark, sf_dir).cache()
    _, feats = run_job(prep, W2_FEATURES, ["variance_threshold", "z_score_norm", "correlation"])
    return spark.createDataFrame([(i + 1, f) for i, f in enumerate(feats)], "pos bigint, feature string")


#: The configured jobs (fixed values).
STUDY_JOBS = [["variance_threshold", "z_score_norm", "correlation", "fr_forest"], ["variance_threshold", "z_score_norm", "correlation", "univariate_ranking"],
              ["variance_threshold", "z_score_norm", "correlation", "mrmr"], ["z_score_norm", "hand_picked"]]


@query("fs_run_jobs")
def fs_run_jobs(spark, sf_dir):
    """The four configured jobs in one call: common steps run once."""
    from ..operators.impute import simple_impute
    from ..operators.split import stratified_split
    data = simple_impute(stratified_split(doc_features(spark, sf_dir), 0.3, 42), W1_FEATURES)
    params = {"hand_picked": ["n_words", "n_digits", "n_punct", "toxic"], "params": {"forest": {"n_estimators": 20, "max_depth": 5}}, "n_top_features": [MRMR_FEATURES]}
    rows = [(name, i + 1, f) for name, (_, feats) in run_jobs(data, W1_FEATURES, STUDY_JOBS, params).items() for i, f in enumerate(feats)]
    return spark.createDataFrame(rows, "job string, pos bigint, feature string")
