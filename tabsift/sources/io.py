"""Sources and sinks (IO-*): tables in, cleaned frames and result tables out.

Result tables (features, scores, predictions) are Parquet partitioned by
``experiment`` and ``seed`` and written with dynamic partition overwrite, so a
re-run replaces only the partitions it produced; resuming is an anti join of
the planned work against what is stored. Paths are shared-storage paths; the
helpers never write to a machine-local folder of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None, sep: str = ",") -> DataFrame:
    """IO-1: header row; types inferred unless a schema is given."""
    r = spark.read.option("header", True).option("sep", sep)
    return r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)


def from_frame(spark: SparkSession, data, view: str | None = None) -> DataFrame:
    """IO-2: a DataFrame (or pandas frame) as source, optionally registered as a SQL view."""
    df = data if isinstance(data, DataFrame) else spark.createDataFrame(data)
    if view:
        df.createOrReplaceTempView(view)
    return df


def save_frame(df: DataFrame, path: str, fmt: str = "parquet", sep: str = ",") -> str:
    """IO-3 / IO-7 / IO-8: write a frame (parquet, or csv/tsv with a header)."""
    w = df.write.mode("overwrite")
    if fmt == "parquet":
        w.parquet(path)
    else:
        w.option("header", True).option("sep", sep).csv(path)
    return path


def load_frame(spark: SparkSession, path: str, schema: StructType | None = None, fmt: str = "parquet",
               sep: str = ",") -> DataFrame:
    """IO-4: read a saved frame back with a pinned schema."""
    if fmt == "parquet":
        r = spark.read.schema(schema) if schema is not None else spark.read
        return r.parquet(path)
    return read_csv(spark, path, schema, sep)


def save_results(df: DataFrame, path: str, partition_cols=("experiment", "seed")) -> str:
    """IO-5: append/replace result partitions (dynamic partition overwrite)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_cols).parquet(path))
    return path


def load_results(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Read a partitioned result table; partition columns come back as columns."""
    r = spark.read.schema(schema) if schema is not None else spark.read
    return r.parquet(path)


def resume_plan(plan: DataFrame, done: DataFrame, keys) -> DataFrame:
    """IO-6: planned work not yet stored (``overwrite`` means: pass an empty ``done``)."""
    return plan.join(done.select(*keys).distinct(), list(keys), "left_anti")


def write_mean_results(df: DataFrame, path: str, digits: int = 2) -> str:
    """IO-9: numbers with two decimals (half up on the binary value) to CSV."""
    k = float(10 ** digits)
    out = df.select(*[(F.floor(F.col(c) * k + 0.5) / k).alias(c) if t == "double" else F.col(c)
                      for c, t in df.dtypes])
    return save_frame(out, path, "csv")


def write_predictions(df: DataFrame, path: str) -> str:
    """IO-10: id, probability CSV per experiment (one folder per experiment)."""
    df.write.mode("overwrite").option("header", True).partitionBy("experiment").csv(path)
    return path


def collect_experiments(spark: SparkSession, path: str, names, registry: DataFrame | None = None,
                        schema: StructType | None = None) -> DataFrame:
    """IO-11: read stored results of the named experiments; with a registry, only those registered.

    The experiment filter prunes partitions: only the named folders are listed and read.
    """
    res = load_results(spark, path, schema).where(F.col("experiment").isin(list(names)))
    if registry is not None:
        res = res.join(registry.select("experiment").distinct(), "experiment", "left_semi")
    return res
