"""Normaliser queries (NO-*), with oracle SQL. Input: W2 split (seed 7) with train medians filled."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.portable import r6
from ..operators import impute as imp
from ..operators import scale as sc
from ..operators import split as sp
from ..operators.frames import to_long
from ..sources.fixtures import W2_FEATURES, order_features, with_fixtures
from . import sqlgen
from .flagship import prepared_sql, prepared_train_test
from .q_split_impute import median_fill_sql
from .registry import query

PREP = [("sp", sqlgen.split("w2", 0.3, "'7'", [], ["target"])),
        ("im", f"SELECT id, target, part, {median_fill_sql('sp', W2_FEATURES)} FROM sp")]


def _prepared(spark, sf_dir):
    """W2 split (seed 7) with train medians filled; cached because every normaliser reads it
    for its distinct-value profile, its fit and its output."""
    split = sp.stratified_split(order_features(spark, sf_dir), 0.3, 7).cache()
    return imp.simple_impute(split, W2_FEATURES).select("id", "target", "part", *W2_FEATURES).cache()


# per-feature (shift, scale) over train in SQL; a zero scale becomes 1
SQL_PARAMS = {
    "z_score_norm": ("avg({f})", "stddev_pop({f})"),
    "min_max_norm": ("min({f})", "max({f}) - min({f})"),
    "max_abs_norm": ("min(0.0)", "max(abs({f}))"),
    "l1_norm": ("min(0.0)", "sum(abs({f}))"),
    "l2_norm": ("min(0.0)", "sqrt(sum({f} * {f}))"),
    "robust_norm": ("quantile_cont({f}, 0.5)", "quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25)"),
}


def _linear_sql(method: str) -> str:
    sh, sc_ = SQL_PARAMS[method]
    cols = []
    for f in W2_FEATURES:
        shift = sh.format(f=f)
        scale = sc_.format(f=f)
        cols.append(
            f"round(CASE WHEN (SELECT count(DISTINCT {f}) FROM im WHERE part = 'train') > 3 THEN "
            f"({f} - (SELECT {shift} FROM im WHERE part = 'train')) / "
            f"(SELECT CASE WHEN {scale} = 0 THEN 1 ELSE {scale} END FROM im WHERE part = 'train') ELSE {f} END, 6) + 0.0 AS {f}")
    return with_fixtures("SELECT id, target, part, " + ", ".join(cols) + " FROM im", "w2", extra=PREP)


def _register(name: str, method: str):
    def q(spark, sf_dir):
        out, _ = sc.normalise(_prepared(spark, sf_dir), W2_FEATURES, method)
        return out.select("id", "target", "part", *[r6(f).alias(f) for f in W2_FEATURES])
    query(name, _linear_sql(method))(q)


for _name, _method in [("no_l1", "l1_norm"), ("no_l2", "l2_norm"), ("no_z_score", "z_score_norm"),
                       ("no_min_max", "min_max_norm"), ("no_max_abs", "max_abs_norm"), ("no_robust", "robust_norm")]:
    _register(_name, _method)


def _quantile_sql(n_quantiles: int = 1000) -> str:
    feats = W2_FEATURES
    long = sqlgen.unpivot("im", ["id", "target", "part"], feats)
    # train has at least n_quantiles rows at every scale factor (W2 train ≥ 1050 rows), so m = n_quantiles
    m = n_quantiles
    refs = [i / (m - 1) for i in range(m)]
    lst = "[" + ", ".join(repr(r) for r in refs) + "]"
    ctes = PREP + [
        ("lg", long),
        ("scal", "SELECT feature FROM lg WHERE part = 'train' GROUP BY feature HAVING count(DISTINCT value) > 3"),
        ("grid", f"SELECT feature, unnest(qs) AS qv, unnest({lst}) AS ref FROM (SELECT feature, quantile_cont(value, {lst}) AS qs "
                 "FROM lg WHERE part = 'train' AND value IS NOT NULL AND feature IN (SELECT feature FROM scal) GROUP BY feature)"),
        ("steps", "SELECT feature, qv, min(ref) AS r_lo, max(ref) AS r_hi FROM grid GROUP BY feature, qv"),
        ("bounds", "SELECT feature, min(qv) AS q_first, max(qv) AS q_last FROM steps GROUP BY feature"),
        ("v", "SELECT l.*, b.q_first, b.q_last FROM lg l JOIN bounds b USING (feature)"),
        ("lo", "SELECT v.id, v.part, v.feature, s.qv AS q0, s.r_lo AS lo0, s.r_hi AS hi0 FROM v ASOF JOIN steps s "
               "ON v.feature = s.feature AND v.value >= s.qv"),
        ("hi", "SELECT v.id, v.part, v.feature, s.qv AS q1, s.r_lo AS lo1 FROM v ASOF JOIN steps s "
               "ON v.feature = s.feature AND v.value < s.qv"),
        ("mapped", """SELECT v.id, v.part, v.feature, CASE
   WHEN v.value IS NULL THEN NULL
   WHEN v.value - 1e-7 < v.q_first THEN 0.0
   WHEN v.value + 1e-7 > v.q_last THEN 1.0
   WHEN v.value = lo.q0 THEN (lo.lo0 + lo.hi0) / 2
   ELSE lo.hi0 + (v.value - lo.q0) * (hi.lo1 - lo.hi0) / (hi.q1 - lo.q0) END AS value
FROM v LEFT JOIN lo USING (id, part, feature) LEFT JOIN hi USING (id, part, feature)"""),
    ]
    body = ("SELECT i.id, i.target, i.part, " + ", ".join(
        f"round(CASE WHEN '{f}' IN (SELECT feature FROM scal) THEN (SELECT m.value FROM mapped m WHERE m.id = i.id "
        f"AND m.part = i.part AND m.feature = '{f}') ELSE i.{f} END, 6) AS {f}" for f in feats) + " FROM im i")
    return with_fixtures(body, "w2", extra=ctes)


@query("no_quantile", _quantile_sql())
def no_quantile(spark, sf_dir):
    out, _ = sc.normalise(_prepared(spark, sf_dir), W2_FEATURES, "quantile_norm")
    return out.select("id", "target", "part", *[r6(f).alias(f) for f in W2_FEATURES])


def _apply_sql() -> str:
    ctes = prepared_sql() + [
        ("nu", "SELECT feature FROM imp WHERE part = 'train' GROUP BY feature HAVING count(DISTINCT value) > 3"),
        ("zs", "SELECT feature, avg(value) AS mu, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS sd "
               "FROM imp WHERE part = 'train' AND feature IN (SELECT feature FROM nu) GROUP BY feature"),
    ]
    body = ("SELECT i.id, i.feature, round(CASE WHEN zs.feature IS NULL THEN i.value ELSE (i.value - zs.mu) / zs.sd END, 6) "
            "AS value FROM imp i LEFT JOIN zs USING (feature) WHERE i.part = 'test'")
    return with_fixtures(body, "w1", extra=ctes)


@query("no_apply", _apply_sql())
def no_apply(spark, sf_dir):
    prep, feats = prepared_train_test(spark, sf_dir)
    out, _ = sc.normalise(prep, feats, "z_score_norm")
    test = out.where(F.col("part") == "test")
    return to_long(test, ["id"], feats).select("id", "feature", r6("value").alias("value"))
