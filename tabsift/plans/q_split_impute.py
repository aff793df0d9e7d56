"""Split, resampling and imputation queries (SP-*, IMP-*), with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import impute as imp
from ..operators import split as sp
from ..sources.fixtures import W1_FEATURES, W2_FEATURES, doc_features, order_features, with_fixtures
from . import sqlgen
from .registry import query

SEED_INIT, N_SEEDS = 545, 5
S42, S0, S7 = "'42'", "'0'", "'7'"  # SQL string literals of seeds
SEEDS_SQL = (f"SELECT CAST(('0x' || substr(md5('{SEED_INIT}|' || CAST(k AS VARCHAR)), 1, 8)) AS BIGINT) AS seed "
             f"FROM range(0, {N_SEEDS}) t(k)")


@query("sp_stratified_split", with_fixtures("SELECT id, target, part FROM sp", "w1",
                                            extra=[("sp", sqlgen.split("w1", 0.3, "'42'", [], ["target"]))]))
def sp_stratified_split(spark, sf_dir):
    return sp.stratified_split(doc_features(spark, sf_dir), 0.3, 42).select("id", "target", "part")


@query("sp_random_split", with_fixtures("SELECT id, part FROM sp", "w2",
                                        extra=[("sp", sqlgen.split("w2", 0.25, "'7'", [], []))]))
def sp_random_split(spark, sf_dir):
    return sp.random_split(order_features(spark, sf_dir), 0.25, 7).select("id", "part")


@query("sp_multi_seed", with_fixtures(
    "SELECT seed, id, target, part FROM sp", "w1",
    extra=[("seeds", SEEDS_SQL), ("ws", "SELECT w1.*, s.seed FROM w1, seeds s"),
           ("sp", sqlgen.split("ws", 0.3, "seed", ["seed"], ["target"]))]))
def sp_multi_seed(spark, sf_dir):
    seeds = sp.generate_seeds(SEED_INIT, N_SEEDS)
    ws = sp.with_seeds(doc_features(spark, sf_dir), seeds)
    return sp.stratified_split(ws, 0.3).select("seed", "id", "target", "part")


BOOT_CTES = [
    ("cls", "SELECT target, count(*) AS n_c FROM w1 GROUP BY target"),
    ("m", sqlgen.largest_remainder("cls", [], ["target"], "floor(0.7 * CAST(n AS DOUBLE))", "m_c")),
    ("draws", "SELECT target, n_c, unnest(generate_series(0, m_c - 1)) AS k FROM m WHERE m_c > 0"),
    ("dpos", f"SELECT target, {sqlgen.h52(S42, S0, 'target', 'k')} % n_c AS pos FROM draws"),
    ("rws", f"SELECT id, target, row_number() OVER (PARTITION BY target ORDER BY {sqlgen.h13('id', S42, S0)}, id) - 1 AS pos FROM w1"),
    ("drawn", "SELECT r.id, r.target, count(*) AS n_draws FROM rws r JOIN dpos p ON r.target = p.target AND r.pos = p.pos GROUP BY r.id, r.target"),
]


def _boot(spark, sf_dir):
    return sp.stratified_bootstrap(doc_features(spark, sf_dir), 42, 0, 0.3)


@query("sp_bootstrap", with_fixtures("SELECT * FROM drawn", "w1", extra=BOOT_CTES))
def sp_bootstrap(spark, sf_dir):
    return _boot(spark, sf_dir).groupBy("id", "target").agg(F.count(F.lit(1)).alias("n_draws"))


@query("sp_out_of_bag", with_fixtures("SELECT id, target FROM w1 WHERE id NOT IN (SELECT id FROM drawn)", "w1", extra=BOOT_CTES))
def sp_out_of_bag(spark, sf_dir):
    w1 = doc_features(spark, sf_dir)
    return sp.out_of_bag(w1, _boot(spark, sf_dir)).select("id", "target")


@query("sp_repeated_kfold", with_fixtures(
    f"SELECT repeat, id, target, CAST((row_number() OVER (PARTITION BY repeat, target ORDER BY "
    f"{sqlgen.h13('id', S42, 'repeat')}, id) - 1) % 3 AS BIGINT) AS fold "
    f"FROM (SELECT w1.*, CAST(r AS BIGINT) AS repeat FROM w1, range(0, 10) t(r))", "w1"))
def sp_repeated_kfold(spark, sf_dir):
    f = sp.repeated_stratified_kfold(doc_features(spark, sf_dir), 3, 10, 42)
    return f.select("repeat", "id", "target", "fold")


@query("sp_kfold", with_fixtures(
    f"SELECT CAST(0 AS BIGINT) AS repeat, id, CAST((row_number() OVER (ORDER BY {sqlgen.h13('id', S7, S0)}, id) - 1) % 5 "
    f"AS BIGINT) AS fold FROM w2", "w2"))
def sp_kfold(spark, sf_dir):
    return sp.kfold(order_features(spark, sf_dir), 5, 7).select("repeat", "id", "fold")


W2_SPLIT = [("sp", sqlgen.split("w2", 0.3, "'7'", [], ["target"]))]


def _w2_split(spark, sf_dir):
    return sp.stratified_split(order_features(spark, sf_dir), 0.3, 7)


@query("imp_drop_nan", with_fixtures(
    "SELECT id, part FROM sp WHERE " + " AND ".join(f"{f} IS NOT NULL" for f in W2_FEATURES), "w2", extra=W2_SPLIT))
def imp_drop_nan(spark, sf_dir):
    return imp.drop_nan_impute(_w2_split(spark, sf_dir), W2_FEATURES).select("id", "part")


def median_fill_sql(src: str, feats) -> str:
    return ", ".join(f"coalesce({f}, (SELECT coalesce(quantile_cont({f}, 0.5), 0) FROM {src} WHERE part = 'train')) AS {f}"
                     for f in feats)


@query("imp_median", with_fixtures(f"SELECT id, target, part, {median_fill_sql('sp', W2_FEATURES)} FROM sp", "w2", extra=W2_SPLIT))
def imp_median(spark, sf_dir):
    out = imp.simple_impute(_w2_split(spark, sf_dir), W2_FEATURES)
    return out.select("id", "target", "part", *W2_FEATURES)


@query("imp_missing_indicator", with_fixtures(
    "SELECT *, " + ", ".join(f"CAST({f} IS NULL AS DOUBLE) AS {f}_missing" for f in W2_FEATURES) + " FROM w2", "w2"))
def imp_missing_indicator(spark, sf_dir):
    return imp.missing_indicator(order_features(spark, sf_dir), W2_FEATURES)


@query("imp_apply", with_fixtures(f"SELECT id, target, part, {median_fill_sql('sp', W1_FEATURES)} FROM sp", "w1",
                                  extra=[("sp", sqlgen.split("w1", 0.3, "'42'", [], ["target"]))]))
def imp_apply(spark, sf_dir):
    split = sp.stratified_split(doc_features(spark, sf_dir), 0.3, 42)
    return imp.impute(split, "simple_impute", W1_FEATURES).select("id", "target", "part", *W1_FEATURES)


@query("imp_median_per_seed", with_fixtures(
    "SELECT seed, id, part, " + ", ".join(
        f"coalesce({f}, (SELECT coalesce(quantile_cont(x.{f}, 0.5), 0) FROM sp x WHERE x.part = 'train' AND x.seed = sp.seed)) AS {f}"
        for f in W1_FEATURES) + " FROM sp", "w1",
    extra=[("seeds", SEEDS_SQL), ("ws", "SELECT w1.*, s.seed FROM w1, seeds s"),
           ("sp", sqlgen.split("ws", 0.3, "seed", ["seed"], ["target"]))]))
def imp_median_per_seed(spark, sf_dir):
    ws = sp.with_seeds(doc_features(spark, sf_dir), sp.generate_seeds(SEED_INIT, N_SEEDS))
    split = sp.stratified_split(ws, 0.3)
    return imp.simple_impute(split, W1_FEATURES, by=["seed"]).select("seed", "id", "part", *W1_FEATURES)
