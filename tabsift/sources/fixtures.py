"""Study tables derived from the driver's parquet tables (see FIXTURES.md).

Each fixture exists twice: as a Spark DataFrame built from ``sf_dir`` and as
SQL text (a CTE body) that a plain SQL engine runs on the same tables. The
modulo rules below inject missing values; they never drop rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Feature lists of the fixtures, in column order (fixed values).
W1_FEATURES = ["n_chars", "n_words", "n_digits", "n_breaks", "n_punct", "src_no",
               "lang_no", "toxic", "n_chars_twin", "const_one", "holey"]
W2_FEATURES = ["totalprice", "acctbal", "order_month", "priority", "nation", "is_building",
               "n_lines", "qty", "price", "disc", "tax", "price_twin"]
W5_COLUMNS = ["brand", "brand_no", "size_txt", "type_txt", "empty_txt", "target_txt"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _study(df: DataFrame) -> DataFrame:
    """Study tables are narrow numeric tables derived from wide sources (document texts, line
    items); the multi-pass operators read them several times, so they are kept cached.
    Identical plans share one cached copy."""
    return df.cache()


def _count_chars(text, chars: str):
    """Characters of ``text`` that are in ``chars`` (no bracket, caret, hyphen or backslash): what is left without runs of others."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def doc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1: labelled documents, 11 numeric features, target = quality."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    t = F.col("text")
    n_chars = F.col("n_chars").cast("double")
    return _study(d.join(lab, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("quality").cast("double").alias("target"),
        n_chars.alias("n_chars"),
        F.size(F.split(t, " ")).cast("double").alias("n_words"),
        _count_chars(t, "0123456789").cast("double").alias("n_digits"),
        (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("double").alias("n_breaks"),
        _count_chars(t, ".,;:!?").cast("double").alias("n_punct"),
        F.substring(F.col("source"), 4, 1 << 20).cast("double").alias("src_no"),
        F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1)
         .when(F.col("lang") == "fr", 2).otherwise(3).cast("double").alias("lang_no"),
        F.col("toxic").cast("double").alias("toxic"),
        (n_chars * 2 + 1).alias("n_chars_twin"),
        F.lit(1.0).alias("const_one"),
        F.when(F.col("doc_id") % 7 == 3, F.lit(None).cast("double"))
         .otherwise((F.col("n_chars") % 50).cast("double")).alias("holey"),
    ))


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2: orders with customer and line aggregates, 12 numeric features."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    li = table(spark, sf_dir, "lineitem")
    x = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.round(F.sum("l_quantity"), 2).alias("qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("price"),
        F.round(F.avg("l_discount"), 6).alias("disc"),
        F.round(F.max("l_tax"), 6).alias("tax"),
    )
    return _study(
        o.join(c, c.c_custkey == o.o_custkey)
        .join(x, x.l_orderkey == o.o_orderkey, "left")
        .select(
            F.col("o_orderkey").alias("id"),
            F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("target"),
            F.col("o_totalprice").alias("totalprice"),
            F.when(F.col("o_orderkey") % 11 == 5, F.lit(None).cast("double"))
             .otherwise(F.col("c_acctbal")).alias("acctbal"),
            F.month("o_orderdate").cast("double").alias("order_month"),
            F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"),
            F.col("c_nationkey").cast("double").alias("nation"),
            F.when(F.col("c_mktsegment") == "BUILDING", 1.0).otherwise(0.0).alias("is_building"),
            F.coalesce(F.col("n_lines"), F.lit(0)).cast("double").alias("n_lines"),
            F.col("qty"), F.col("price"), F.col("disc"), F.col("tax"),
            (F.col("price") * F.lit(1.0001)).alias("price_twin"),
        )
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3: stand-in for stored test predictions of many runs."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("exp"), (F.col("user_id") % 2).cast("string")).alias("experiment"),
        (F.col("user_id") % 10).cast("bigint").alias("seed"),
        F.concat(F.lit("job"), (F.col("event_id") % 2).cast("string")).alias("job"),
        (F.lit(2) + F.lit(2) * (F.col("event_id") % 3)).cast("bigint").alias("n_top"),
        F.col("event_type").alias("model"),
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 5 < 2, 1).otherwise(0).alias("y_true"),
        (F.floor(F.col("value") / 5).cast("double") / 100).alias("score"),
    )


def vec_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4: 64-dimensional vectors in long form (id, target, j, x)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        F.when(F.col("label") < 3, 1.0).otherwise(0.0).alias("target"),
        F.posexplode("embedding").alias("j", "x"),
    )


def raw_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5: raw text columns for coercion and emptiness rules."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("brand"),
        F.substring("p_brand", 7, 1 << 20).alias("brand_no"),
        F.when(F.col("p_partkey") % 9 == 0, F.lit("n/a")).otherwise(F.col("p_size").cast("string")).alias("size_txt"),
        F.col("p_type").alias("type_txt"),
        F.lit(None).cast("string").alias("empty_txt"),
        F.when(F.col("p_partkey") % 13 == 0, F.lit(None).cast("string"))
         .when(F.col("p_size") > 25, F.lit("1")).otherwise(F.lit("0")).alias("target_txt"),
    )


# ---------------------------------------------------------------- SQL text
W1_SQL = """SELECT d.doc_id AS id,
  CAST(l.quality AS DOUBLE) AS target,
  CAST(d.n_chars AS DOUBLE) AS n_chars,
  CAST(len(string_split(d.text, ' ')) AS DOUBLE) AS n_words,
  CAST(length(d.text) - length(translate(d.text, '0123456789', '')) AS DOUBLE) AS n_digits,
  CAST(length(d.text) - length(replace(d.text, chr(10), '')) AS DOUBLE) AS n_breaks,
  CAST(length(d.text) - length(translate(d.text, '.,;:!?', '')) AS DOUBLE) AS n_punct,
  CAST(substr(d.source, 4) AS DOUBLE) AS src_no,
  CAST(CASE d.lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS DOUBLE) AS lang_no,
  CAST(l.toxic AS DOUBLE) AS toxic,
  CAST(d.n_chars AS DOUBLE) * 2 + 1 AS n_chars_twin,
  CAST(1 AS DOUBLE) AS const_one,
  CASE WHEN d.doc_id % 7 = 3 THEN NULL ELSE CAST(d.n_chars % 50 AS DOUBLE) END AS holey
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""

W2_SQL = """SELECT o.o_orderkey AS id,
  CASE WHEN o.o_orderstatus = 'F' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS target,
  o.o_totalprice AS totalprice,
  CASE WHEN o.o_orderkey % 11 = 5 THEN NULL ELSE c.c_acctbal END AS acctbal,
  CAST(month(o.o_orderdate) AS DOUBLE) AS order_month,
  CAST(substr(o.o_orderpriority, 1, 1) AS DOUBLE) AS priority,
  CAST(c.c_nationkey AS DOUBLE) AS nation,
  CASE WHEN c.c_mktsegment = 'BUILDING' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS is_building,
  CAST(coalesce(x.n_lines, 0) AS DOUBLE) AS n_lines,
  x.qty AS qty, x.price AS price, x.disc AS disc, x.tax AS tax,
  x.price * 1.0001e0 AS price_twin
FROM orders o
JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, round(sum(l_quantity), 2) AS qty,
                  round(sum(l_extendedprice), 2) AS price, round(avg(l_discount), 6) AS disc,
                  round(max(l_tax), 6) AS tax
           FROM lineitem GROUP BY l_orderkey) x ON x.l_orderkey = o.o_orderkey"""

W3_SQL = """SELECT concat('exp', CAST(user_id % 2 AS VARCHAR)) AS experiment,
  CAST(user_id % 10 AS BIGINT) AS seed,
  concat('job', CAST(event_id % 2 AS VARCHAR)) AS job,
  CAST(2 + 2 * (event_id % 3) AS BIGINT) AS n_top,
  event_type AS model,
  event_id AS id,
  CASE WHEN event_id % 5 < 2 THEN 1 ELSE 0 END AS y_true,
  CAST(floor(value / 5) AS DOUBLE) / 100 AS score
FROM events"""

W4_SQL = """SELECT vec_id AS id,
  CASE WHEN label < 3 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS target,
  CAST(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER) AS j,
  unnest(embedding) AS x
FROM embeddings"""

W5_SQL = """SELECT p_partkey AS id, p_brand AS brand, substr(p_brand, 7) AS brand_no,
  CASE WHEN p_partkey % 9 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS size_txt,
  p_type AS type_txt, CAST(NULL AS VARCHAR) AS empty_txt,
  CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_size > 25 THEN '1' ELSE '0' END AS target_txt
FROM part"""

FIXTURE_SQL = {"w1": W1_SQL, "w2": W2_SQL, "w3": W3_SQL, "w4": W4_SQL, "w5": W5_SQL}


def with_fixtures(body: str, *names: str, extra: list[tuple[str, str]] | None = None,
                  recursive: bool = False) -> str:
    """Prefix ``body`` with CTEs for the named fixtures and extra (name, sql) pairs."""
    ctes = [f"{n} AS (\n{FIXTURE_SQL[n]}\n)" for n in names]
    for name, sql in extra or []:
        ctes.append(f"{name} AS (\n{sql}\n)")
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(ctes) + "\n" + body if ctes else body
