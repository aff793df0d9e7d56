"""Cleaning queries (CL-*), with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as cl
from ..operators.frames import nunique_profile
from ..operators.split import stratified_split
from ..sources.fixtures import (W1_FEATURES, W2_FEATURES, W5_COLUMNS, doc_features, order_features, raw_strings, table,
                                with_fixtures)
from . import sqlgen
from .registry import query

NUM_RE_SQL = cl.NUMERIC_RE.replace("'", "''")


def coerce_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{NUM_RE_SQL}') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def zero_rule_sql(src: str, c: str, max_levels: int = 5) -> str:
    return f"CASE WHEN (SELECT count(DISTINCT {c}) FROM {src}) > {max_levels} AND {c} = 0 THEN NULL ELSE {c} END"


W5_COERCED = "SELECT id, " + ", ".join(f"{coerce_sql(c)} AS {c}" for c in W5_COLUMNS) + " FROM w5"


@query("cl_set_key", "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_keys, "
       "CAST((SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)) AS BIGINT) "
       "AS n_duplicate_keys FROM lineitem")
def cl_set_key(spark, sf_dir):
    li = cl.set_key(table(spark, sf_dir, "lineitem"), "l_orderkey")
    return cl.key_report(li, "id")


DROP_PATTERNS = ["^price", "tax$"]


@query("cl_drop_regex", with_fixtures(
    "SELECT id, " + ", ".join(f for f in W2_FEATURES if f not in ("price", "price_twin", "tax")) + ", target FROM w2", "w2"))
def cl_drop_regex(spark, sf_dir):
    return cl.drop_columns_regex(order_features(spark, sf_dir), DROP_PATTERNS, "target")


@query("cl_target_last", with_fixtures("SELECT id, " + ", ".join(W1_FEATURES) + ", target FROM w1", "w1"))
def cl_target_last(spark, sf_dir):
    return cl.target_last(doc_features(spark, sf_dir), "target")


@query("cl_coerce_numeric", with_fixtures(W5_COERCED, "w5"))
def cl_coerce_numeric(spark, sf_dir):
    return cl.coerce_numeric(raw_strings(spark, sf_dir), "id")


@query("cl_nunique", with_fixtures("\nUNION ALL\n".join(
    f"SELECT '{f}' AS feature, CAST(count(DISTINCT {f}) AS BIGINT) AS n_unique FROM w1" for f in W1_FEATURES), "w1"))
def cl_nunique(spark, sf_dir):
    return nunique_profile(doc_features(spark, sf_dir), W1_FEATURES)


@query("cl_zero_to_null", with_fixtures(
    "SELECT id, target, " + ", ".join(f"{zero_rule_sql('w1', f)} AS {f}" for f in W1_FEATURES) + " FROM w1", "w1"))
def cl_zero_to_null(spark, sf_dir):
    return cl.zero_to_null(doc_features(spark, sf_dir), W1_FEATURES)


W5_EMPTY_KEPT = ["brand_no", "size_txt", "target_txt"]  # brand, type_txt, empty_txt hold no number


@query("cl_drop_empty", with_fixtures("SELECT id, " + ", ".join(W5_EMPTY_KEPT) + " FROM c", "w5", extra=[("c", W5_COERCED)]))
def cl_drop_empty(spark, sf_dir):
    c = cl.coerce_numeric(raw_strings(spark, sf_dir), "id")
    return cl.drop_empty_columns(c, W5_COLUMNS)


@query("cl_drop_null_target", with_fixtures("SELECT * FROM c WHERE target_txt IS NOT NULL", "w5", extra=[("c", W5_COERCED)]))
def cl_drop_null_target(spark, sf_dir):
    return cl.drop_null_target(cl.coerce_numeric(raw_strings(spark, sf_dir), "id"), "target_txt")


W5_FEATS = [c for c in W5_COLUMNS if c != "target_txt"]


@query("cl_clean_up", with_fixtures(
    "SELECT id, " + ", ".join(f"{zero_rule_sql('c', f)} AS {f}" for f in W5_EMPTY_KEPT if f != "target_txt")
    + ", target_txt FROM c WHERE target_txt IS NOT NULL", "w5", extra=[("c", W5_COERCED)]))
def cl_clean_up(spark, sf_dir):
    return cl.clean_up(raw_strings(spark, sf_dir), "id", "target_txt")


@query("cl_clean_up_docs", with_fixtures(
    "SELECT id, " + ", ".join(f"{zero_rule_sql('w1', f)} AS {f}" for f in W1_FEATURES) + ", target FROM w1 "
    "WHERE target IS NOT NULL", "w1"))
def cl_clean_up_docs(spark, sf_dir):
    return cl.clean_up(doc_features(spark, sf_dir), "id", "target")


@query("cl_drop_null_rows", with_fixtures(
    "SELECT * FROM w2 WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in ["id", "target"] + W2_FEATURES), "w2"))
def cl_drop_null_rows(spark, sf_dir):
    return cl.drop_null_rows(order_features(spark, sf_dir))


@query("cl_null_violations", with_fixtures("SELECT * FROM (" + "\nUNION ALL\n".join(
    f"SELECT '{f}' AS feature, CAST(count(*) - count({f}) AS BIGINT) AS n_null FROM w2" for f in W2_FEATURES)
    + ") WHERE n_null > 0", "w2"))
def cl_null_violations(spark, sf_dir):
    return cl.null_violations(order_features(spark, sf_dir), W2_FEATURES)


W1_LOW = ["toxic", "const_one"]  # two and one distinct values


@query("cl_drop_low_cardinality", with_fixtures(
    "SELECT id, target, " + ", ".join(f for f in W1_FEATURES if f not in W1_LOW) + " FROM w1", "w1"))
def cl_drop_low_cardinality(spark, sf_dir):
    return cl.drop_low_cardinality(doc_features(spark, sf_dir), W1_FEATURES)


@query("cl_select_features", with_fixtures("SELECT id, price, qty, nation, target FROM w2", "w2"))
def cl_select_features(spark, sf_dir):
    return cl.select_features(order_features(spark, sf_dir), ["price", "qty", "nation"], "target")


@query("cl_column_concat", with_fixtures(
    "SELECT a.id, a.totalprice, a.target, b.max_line, b.n_parts FROM (SELECT id, totalprice, target FROM w2) a "
    "LEFT JOIN (SELECT l_orderkey AS id, CAST(max(l_linenumber) AS BIGINT) AS max_line, count(DISTINCT l_partkey) AS n_parts "
    "FROM lineitem GROUP BY l_orderkey) b ON a.id = b.id", "w2"))
def cl_column_concat(spark, sf_dir):
    a = order_features(spark, sf_dir).select("id", "totalprice", "target")
    b = (table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"))
         .agg(F.max("l_linenumber").cast("bigint").alias("max_line"), F.countDistinct("l_partkey").alias("n_parts")))
    return cl.column_concat(a, b, "id", "left")


@query("cl_drop_rows_by_key", with_fixtures(
    "SELECT * FROM w2 WHERE id NOT IN (SELECT id FROM sp WHERE part = 'train')", "w2",
    extra=[("sp", sqlgen.split("w2", 0.3, "'7'", [], ["target"]))]))
def cl_drop_rows_by_key(spark, sf_dir):
    w2 = order_features(spark, sf_dir)
    train = stratified_split(w2, 0.3, 7).where(F.col("part") == "train")
    return cl.drop_rows_by_key(w2, train, "id")


@query("cl_melt", with_fixtures(sqlgen.unpivot("w1", ["id", "target"], W1_FEATURES).replace(
    "AS feature", "AS variable"), "w1"))
def cl_melt(spark, sf_dir):
    return cl.melt(doc_features(spark, sf_dir), ["id", "target"], W1_FEATURES)


@query("cl_explode_metrics", with_fixtures(
    "SELECT experiment, seed, job, n_top, model, 'n' AS metric, CAST(count(*) AS DOUBLE) AS value FROM w3 "
    "GROUP BY experiment, seed, job, n_top, model UNION ALL "
    "SELECT experiment, seed, job, n_top, model, 'positives', CAST(sum(y_true) AS DOUBLE) FROM w3 "
    "GROUP BY experiment, seed, job, n_top, model", "w3"))
def cl_explode_metrics(spark, sf_dir):
    from ..sources.fixtures import predictions
    runs = predictions(spark, sf_dir).groupBy("experiment", "seed", "job", "n_top", "model").agg(
        F.array(F.count(F.lit(1)).cast("double"), F.sum("y_true").cast("double")).alias("vals"))
    z = F.arrays_zip(F.array(F.lit("n"), F.lit("positives")).alias("metric"), F.col("vals").alias("value"))
    return (runs.select("experiment", "seed", "job", "n_top", "model", F.explode(z).alias("mv"))
            .select("experiment", "seed", "job", "n_top", "model", F.col("mv.metric").alias("metric"),
                    F.col("mv.value").alias("value")))
