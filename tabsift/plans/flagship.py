"""Flagship: which features survive a selection job, and how are they ranked?

clean (CL-9) → stratified split (SP-2) → median fit on train (IMP-2) →
variance filter (FS-1) → z-score fit on train (NO-3) → correlation filter
(FS-4) → ranking by |corr with target| (FS-2) → (rank, feature, abs_corr).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import clean_up
from ..operators.frames import features_of
from ..operators.impute import simple_impute
from ..operators.scale import normalise
from ..operators.select import correlation_filter, target_corr_ranking, variance_threshold
from ..operators.split import stratified_split
from ..sources.fixtures import W1_FEATURES, doc_features, with_fixtures
from . import sqlgen

SEED = 42
TEST_FRAC = 0.3
VAR_P = 0.99
CORR_THRESH = 0.95


def prepared_train_test(spark: SparkSession, sf_dir: str, seed: int = SEED, test_frac: float = TEST_FRAC):
    """W1 cleaned, split and median-imputed (fit on train). Returns (frame, features)."""
    clean = clean_up(doc_features(spark, sf_dir), "id", "target")
    feats = features_of(clean)
    split = stratified_split(clean, test_frac, seed).cache()  # read by the median fit and by the fill
    return simple_impute(split, feats).cache(), feats  # the selection steps below read it several times


def feature_ranking(spark: SparkSession, sf_dir: str, seed: int = SEED) -> DataFrame:
    imp, feats = prepared_train_test(spark, sf_dir, seed)
    train = imp.where(F.col("part") == "train")
    kept = variance_threshold(train, feats, VAR_P)
    normed, _ = normalise(imp.select("id", *kept, "target", "part"), kept, "z_score_norm")
    tn = normed.where(F.col("part") == "train")
    remaining, _ = correlation_filter(tn, kept, "target", CORR_THRESH)
    return target_corr_ranking(tn, remaining)


# ---------------------------------------------------------------- oracle text
def prepared_sql(seed: int = SEED, test_frac: float = TEST_FRAC) -> list[tuple[str, str]]:
    """CTEs up to ``imp`` (id, target, feature, part, value) and ``fpos``, in long form."""
    feats = W1_FEATURES
    return [
        ("fpos", sqlgen.positions(feats)),
        ("base", sqlgen.unpivot("w1", ["id", "target"], feats)),
        ("prof", "SELECT feature, count(DISTINCT value) AS nu FROM base GROUP BY feature"),
        ("clean0", "SELECT b.id, b.target, b.feature, CASE WHEN p.nu > 5 AND b.value = 0 THEN NULL ELSE b.value END AS value "
                   "FROM base b JOIN prof p USING (feature) WHERE b.target IS NOT NULL"),
        ("clean", "SELECT * FROM clean0 WHERE feature IN (SELECT feature FROM clean0 GROUP BY feature HAVING count(value) > 0)"),
        ("rowsc", "SELECT DISTINCT id, target FROM clean"),
        ("sp", sqlgen.split("rowsc", test_frac, f"'{seed}'", [], ["target"])),
        ("l", "SELECT c.*, sp.part FROM clean c JOIN sp USING (id)"),
        ("med", "SELECT f.feature, coalesce(m.fill, 0) AS fill FROM (SELECT DISTINCT feature FROM l) f LEFT JOIN "
                "(SELECT feature, quantile_cont(value, 0.5) AS fill FROM l WHERE part = 'train' AND value IS NOT NULL "
                "GROUP BY feature) m USING (feature)"),
        ("imp", "SELECT l.id, l.target, l.feature, l.part, coalesce(l.value, m.fill) AS value FROM l JOIN med m USING (feature)"),
    ]


def _thr(p: float) -> str:
    return f"CAST('{p * (1 - p)!r}' AS DOUBLE)"


def feature_ranking_sql(seed: int = SEED) -> str:
    ctes = prepared_sql(seed) + [
        ("v", f"SELECT * FROM imp WHERE feature IN (SELECT feature FROM imp WHERE part = 'train' GROUP BY feature "
              f"HAVING var_pop(value) > {_thr(VAR_P)})"),
        ("nu", "SELECT feature FROM v WHERE part = 'train' GROUP BY feature HAVING count(DISTINCT value) > 3"),
        ("zs", "SELECT feature, avg(value) AS mu, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS sd "
               "FROM v WHERE part = 'train' AND feature IN (SELECT feature FROM nu) GROUP BY feature"),
        ("nz", "SELECT v.id, v.target, v.feature, v.part, CASE WHEN zs.feature IS NULL THEN v.value "
               "ELSE (v.value - zs.mu) / zs.sd END AS value FROM v LEFT JOIN zs USING (feature)"),
        ("tn", "SELECT nz.*, fpos.fpos FROM nz JOIN fpos USING (feature) WHERE part = 'train'"),
        ("tcorr", "SELECT feature, abs(round(" + sqlgen.corr() + ", 2)) AS abs_corr FROM (SELECT feature, "
                  + sqlgen.moments("value", "target") + " FROM tn WHERE value IS NOT NULL GROUP BY feature)"),
        ("rk", "SELECT feature, row_number() OVER (ORDER BY abs_corr DESC NULLS LAST, fpos) AS rank "
               "FROM tcorr JOIN fpos USING (feature)"),
        ("pm", sqlgen.pair_moments("tn")),
        ("pc", "SELECT a, b, abs(round(" + sqlgen.corr() + ", 2)) AS ar FROM pm"),
        ("both_", "SELECT a, b, ar FROM pc UNION ALL SELECT b AS a, a AS b, ar FROM pc"),
        ("drops", "SELECT DISTINCT x.a AS feature FROM both_ x JOIN rk ra ON ra.feature = x.a "
                  "JOIN rk rb ON rb.feature = x.b WHERE rb.rank < ra.rank AND x.ar > 0.95"),
    ]
    body = ("SELECT CAST(row_number() OVER (ORDER BY abs_corr DESC NULLS LAST, fpos) AS BIGINT) AS rank, feature, abs_corr "
            "FROM tcorr JOIN fpos USING (feature) WHERE feature NOT IN (SELECT feature FROM drops)")
    return with_fixtures(body, "w1", extra=ctes)
