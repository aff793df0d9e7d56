"""Exploration queries (EX-*), with oracle SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.portable import r6, rhalf, rhalf_sql
from ..operators import explore as ex
from ..operators.stats import pair_corr
from ..sources.fixtures import W1_FEATURES, W2_FEATURES, doc_features, order_features, with_fixtures
from . import sqlgen
from .registry import query

W1_LOW = ["toxic", "const_one"]
W1_KEPT = [f for f in W1_FEATURES if f not in W1_LOW]

EX1_FILL = ("filled", "SELECT id, target, " + ", ".join(
    f"coalesce({f}, (SELECT coalesce(quantile_cont({f}, 0.5), 0) FROM w1)) AS {f}" for f in W1_FEATURES) + " FROM w1")
EX1 = ("ex1", "SELECT id, target, " + ", ".join(
    f"({f} - (SELECT avg({f}) FROM filled)) / (SELECT CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END "
    f"FROM filled) AS {f}" for f in W1_KEPT) + " FROM filled")


def _ex1(spark, sf_dir):
    out, kept = ex.explore_prepare(doc_features(spark, sf_dir), W1_FEATURES)
    return out, kept


@query("ex_prepare", with_fixtures("SELECT id, target, " + ", ".join(f"round({f}, 6) + 0.0 AS {f}" for f in W1_KEPT)
                                   + " FROM ex1", "w1", extra=[EX1_FILL, EX1]))
def ex_prepare(spark, sf_dir):
    out, kept = _ex1(spark, sf_dir)
    return out.select("id", "target", *[r6(f).alias(f) for f in kept])


def _target_corr_sql(src: str, feats) -> list[tuple[str, str]]:
    return [("tl", sqlgen.unpivot(src, ["id", "target"], feats)),
            ("tc", "SELECT feature, " + sqlgen.corr() + " AS r FROM (SELECT feature, " + sqlgen.moments("value", "target")
                   + " FROM tl WHERE value IS NOT NULL AND target IS NOT NULL GROUP BY feature)")]


@query("ex_corr_to_target", with_fixtures("SELECT feature, round(r, 2) + 0.0 AS corr FROM tc", "w1",
                                          extra=[EX1_FILL, EX1] + _target_corr_sql("ex1", W1_KEPT)))
def ex_corr_to_target(spark, sf_dir):
    out, kept = _ex1(spark, sf_dir)
    return ex.corr_to_target(out, kept)


def _pairs_sql(src_long: str) -> str:
    return ("SELECT a, b, r FROM (SELECT a, b, " + sqlgen.corr() + " AS r FROM (" + sqlgen.pair_moments(src_long) + ")) "
            "WHERE r IS NOT NULL")


MATRIX_BODY = """SELECT a, b, round(r, 6) AS r FROM (
  SELECT a, b, r FROM pc UNION ALL SELECT b AS a, a AS b, r FROM pc
  UNION ALL SELECT DISTINCT f AS a, f AS b, 1.0 AS r FROM (SELECT a AS f FROM pc UNION SELECT b AS f FROM pc))"""

W1_LONG = [("fpos", sqlgen.positions(W1_FEATURES)),
           ("wl", "SELECT u.*, p.fpos FROM (" + sqlgen.unpivot("w1", ["id"], W1_FEATURES) + ") u JOIN fpos p USING (feature)")]


@query("ex_corr_matrix", with_fixtures(MATRIX_BODY, "w1", extra=W1_LONG + [("pc", _pairs_sql("wl"))]))
def ex_corr_matrix(spark, sf_dir):
    m = ex.corr_matrix(doc_features(spark, sf_dir), W1_FEATURES)
    return m.select("a", "b", r6("r").alias("r"))


SPEAR_LONG = [("fpos", sqlgen.positions(W1_FEATURES)),
              ("raw", sqlgen.unpivot("w1", ["id"], W1_FEATURES)),
              ("wl", "SELECT r.id, r.feature, CASE WHEN r.value IS NULL THEN NULL ELSE rank() OVER (PARTITION BY r.feature, "
                     "r.value IS NULL ORDER BY r.value) + (count(*) OVER (PARTITION BY r.feature, r.value) - 1) / 2.0 END AS value, "
                     "p.fpos FROM raw r JOIN fpos p USING (feature)")]


@query("ex_corr_spearman", with_fixtures(MATRIX_BODY, "w1", extra=SPEAR_LONG + [("pc", _pairs_sql("wl"))]))
def ex_corr_spearman(spark, sf_dir):
    m = ex.corr_matrix(doc_features(spark, sf_dir), W1_FEATURES, "spearman")
    return m.select("a", "b", r6("r").alias("r"))


@query("ex_corr_lower", with_fixtures(
    "SELECT m.a, m.b, m.r FROM (" + MATRIX_BODY + ") m JOIN fpos pa ON pa.feature = m.a JOIN fpos pb ON pb.feature = m.b "
    "WHERE pa.fpos > pb.fpos", "w1", extra=W1_LONG + [("pc", _pairs_sql("wl"))]))
def ex_corr_lower(spark, sf_dir):
    m = ex.corr_lower_triangle(doc_features(spark, sf_dir), W1_FEATURES)
    return m.select("a", "b", r6("r").alias("r"))


@query("ex_feature_distance", with_fixtures(
    "SELECT x.feature AS a, y.feature AS b, round(sqrt(sum((x.value - y.value) * (x.value - y.value))), 6) AS distance "
    "FROM el x JOIN el y ON x.id = y.id AND x.fpos < y.fpos WHERE x.value IS NOT NULL AND y.value IS NOT NULL "
    "GROUP BY x.feature, y.feature", "w1",
    extra=[EX1_FILL, EX1, ("fpos", sqlgen.positions(W1_KEPT)),
           ("el", "SELECT u.*, p.fpos FROM (" + sqlgen.unpivot("ex1", ["id"], W1_KEPT) + ") u JOIN fpos p USING (feature)")]))
def ex_feature_distance(spark, sf_dir):
    out, kept = _ex1(spark, sf_dir)
    return ex.feature_distance(out, kept).select("a", "b", r6("distance").alias("distance"))


@query("ex_target_binary", with_fixtures(
    "SELECT CAST(sum(target) AS BIGINT) AS positives, count(*) AS n, CAST(round(avg(target), 2) * 100 AS BIGINT) AS percent "
    "FROM w1", "w1"))
def ex_target_binary(spark, sf_dir):
    return ex.target_summary_binary(doc_features(spark, sf_dir))


@query("ex_target_regression", with_fixtures(
    "SELECT " + ", ".join(f"{rhalf_sql(e, 2)} AS {n}" for n, e in [
        ("count", "CAST(count(totalprice) AS DOUBLE)"), ("mean", "avg(totalprice)"), ("std", "stddev_samp(totalprice)"),
        ("min", "min(totalprice)"), ("median", "quantile_cont(totalprice, 0.5)"), ("max", "max(totalprice)")]) + " FROM w2", "w2"))
def ex_target_regression(spark, sf_dir):
    s = ex.target_summary_regression(order_features(spark, sf_dir), "totalprice", digits=None)
    return s.select(*[rhalf(c, 2).alias(c) for c in ["count", "mean", "std", "min", "median", "max"]])


def _box_sql(src: str, feats, by: list[str]) -> str:
    long = sqlgen.unpivot(src, by, feats)
    g = ", ".join(by + ["feature"])
    on = " AND ".join(f"l.{c} = q.{c}" for c in by + ["feature"])
    ctes = [("bl", f"SELECT * FROM ({long}) WHERE value IS NOT NULL"),
            ("bq", f"SELECT {g}, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, "
                   f"quantile_cont(value, 0.75) AS q3 FROM bl GROUP BY {g}")]
    sel = ", ".join(f"q.{c}" for c in by + ["feature"])
    body = f"""SELECT {sel}, round(q.q1, 6) AS q1, round(q.median, 6) AS median, round(q.q3, 6) AS q3, round(avg(l.value), 6) AS mean,
  round(min(CASE WHEN l.value >= q.q1 - 1.5 * (q.q3 - q.q1) THEN l.value END), 6) AS whisker_lo,
  round(max(CASE WHEN l.value <= q.q3 + 1.5 * (q.q3 - q.q1) THEN l.value END), 6) AS whisker_hi, count(*) AS n
FROM bl l JOIN bq q ON {on} GROUP BY {sel}, q.q1, q.median, q.q3, q.q3"""
    return ctes, body


def _box_query(name, fixture, feats, by):
    ctes, body = _box_sql(fixture, feats, by)

    def q(spark, sf_dir):
        df = doc_features(spark, sf_dir) if fixture == "w1" else order_features(spark, sf_dir)
        b = ex.box_stats(df, feats, by)
        return b.select(*by, "feature", *[r6(c).alias(c) for c in ["q1", "median", "q3", "mean", "whisker_lo", "whisker_hi"]], "n")
    query(name, with_fixtures(body, fixture, extra=ctes))(q)


_box_query("ex_box_by_target", "w1", W1_FEATURES, ["target"])
_box_query("ex_box", "w2", W2_FEATURES, [])

KDE_FEATS = W1_FEATURES
KDE_SQL = f"""SELECT s.feature, CAST(g.gi AS BIGINT) AS gi, round(s.g0 + g.gi * s.step, 6) AS x,
  round(sum(exp(-0.5 * ((s.g0 + g.gi * s.step - l.value) / s.h) * ((s.g0 + g.gi * s.step - l.value) / s.h)))
        / (s.n * s.h * {math.sqrt(2 * math.pi)!r}), 9) AS density
FROM st s JOIN kl l USING (feature) CROSS JOIN range(0, 200) g(gi)
GROUP BY s.feature, g.gi, s.g0, s.step, s.n, s.h"""


@query("ex_kde", with_fixtures(KDE_SQL, "w1", extra=[
    ("kl", f"SELECT * FROM ({sqlgen.unpivot('w1', [], KDE_FEATS)}) WHERE value IS NOT NULL"),
    ("st", "SELECT *, mn - 3.0 * h AS g0, (mx - mn + 2 * 3.0 * h) / 199 AS step FROM (SELECT feature, count(*) AS n, "
           "min(value) AS mn, max(value) AS mx, stddev_samp(value) * pow(CAST(count(*) AS DOUBLE), -0.2) AS h "
           "FROM kl GROUP BY feature) WHERE h > 0")]))
def ex_kde(spark, sf_dir):
    k = ex.kde_curve(doc_features(spark, sf_dir), KDE_FEATS)
    return k.select("feature", "gi", r6("x").alias("x"), F.round("density", 9).alias("density"))


LIM_SQL = [("ll", f"SELECT * FROM ({sqlgen.unpivot('w2', ['id'], W2_FEATURES)}) WHERE value IS NOT NULL"),
           ("lim", "SELECT feature, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM (SELECT feature, "
                   "quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM ll GROUP BY feature)")]


@query("ex_outlier_limits", with_fixtures("SELECT feature, round(lower, 6) AS lower, round(upper, 6) AS upper FROM lim",
                                          "w2", extra=LIM_SQL))
def ex_outlier_limits(spark, sf_dir):
    lim = ex.outlier_limits(order_features(spark, sf_dir), W2_FEATURES)
    return lim.select("feature", r6("lower").alias("lower"), r6("upper").alias("upper"))


@query("ex_drop_outliers", with_fixtures(
    "SELECT id, target, " + ", ".join(
        f"CASE WHEN {f} > (SELECT lower FROM lim WHERE feature = '{f}') AND {f} < (SELECT upper FROM lim WHERE feature = '{f}') "
        f"THEN {f} END AS {f}" for f in W2_FEATURES) + " FROM w2", "w2", extra=LIM_SQL))
def ex_drop_outliers(spark, sf_dir):
    return ex.drop_outliers(order_features(spark, sf_dir), W2_FEATURES)


@query("ex_detect_outliers", with_fixtures(
    "SELECT l.id, l.feature, l.value, round(m.lower, 6) AS lower, round(m.upper, 6) AS upper, "
    "CASE WHEN l.value <= m.lower THEN 'low' ELSE 'high' END AS side FROM ll l JOIN lim m USING (feature) "
    "WHERE l.value <= m.lower OR l.value >= m.upper", "w2", extra=LIM_SQL))
def ex_detect_outliers(spark, sf_dir):
    d = ex.detect_outliers(order_features(spark, sf_dir), W2_FEATURES)
    return d.select("id", "feature", "value", r6("lower").alias("lower"), r6("upper").alias("upper"), "side")


KENDALL_SQL = ("SELECT a, b, round(s / (sqrt(dx) * sqrt(dy)), 6) + 0.0 AS r FROM (SELECT x.feature AS a, y.feature AS b, "
               "CAST(sum(sign(x.d) * sign(y.d)) AS DOUBLE) AS s, CAST(sum(abs(sign(x.d))) AS DOUBLE) AS dx, CAST(sum(abs(sign(y.d))) AS DOUBLE) AS dy "
               "FROM dif x JOIN dif y ON x.i = y.i AND x.j = y.j AND x.fpos < y.fpos GROUP BY x.feature, y.feature) WHERE dx > 0 AND dy > 0")


@query("ex_corr_kendall", with_fixtures(KENDALL_SQL, "w1", extra=W1_LONG + [
    ("dif", "SELECT p.feature, p.fpos, p.id AS i, q.id AS j, p.value - q.value AS d FROM wl p JOIN wl q ON p.feature = q.feature AND p.id < q.id "
            "WHERE p.value IS NOT NULL AND q.value IS NOT NULL")]))
def ex_corr_kendall(spark, sf_dir):
    """Kendall's tau-b of every pair of columns."""
    pairs = pair_corr(doc_features(spark, sf_dir), W1_FEATURES, "kendall")
    return pairs.where(F.col("r").isNotNull()).select("a", "b", r6("r").alias("r"))
