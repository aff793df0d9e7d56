"""Small helpers the operators share: reading tables, written tables, numbering, bounded broadcasts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

#: Words of every contract: runs without the ASCII white space characters. ``bytes.split`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors cost nothing.

    ``by`` names a column with few values; its values become folders.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", codec)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_uri(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared store, as a URI that pyarrow.fs and Spark both read."""
    path = scratch_path(spark, name)
    return re.sub(r"^file:/+", "file:///", path) if path.startswith("file:") else path


def crc_mod(doc_id, mod: int):
    """crc32 of the id's decimal text, modulo ``mod``: the fold of a document (null ids: null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod))


def ascii_lower(col):
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def batch_of(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def pieces_of(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds at most ``max_bytes`` in each piece (or one row): bounds a task's memory."""
    for batch in batches:
        start, held = 0, 0
        for i, n in enumerate(_sizes(batch.column(column))):
            if i > start and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def _sizes(column: pa.Array) -> list[int]:
    import pyarrow.compute as pc
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def fields(df: DataFrame, *names: str) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType, True) for n in names]


def checked_broadcast(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """Broadcast hint only while the counted size stays under the bound; else the join shuffles."""
    return F.broadcast(df) if rows <= max_rows else df


def joined_by_key(rows: DataFrame, names: DataFrame, key: str, hot_share: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``names`` (a written table with one row a key; ``rows_`` counts the key's rows, and is left out).

    Keys that hold over 1 / ``hot_share`` of the rows are fewer than ``hot_share``: they are broadcast, and only the other rows are
    shuffled, so no key makes a long task.
    """
    total = names.agg(F.sum("rows_")).first()[0] or 0
    hot = F.col("rows_") * hot_share > total
    large, rest = F.broadcast(names.filter(hot).drop("rows_")), names.filter(~hot).drop("rows_")
    return rows.join(large, key).unionByName(rows.join(large.select(key), key, "left_anti").join(rest, key))


def numbered(df: DataFrame, column: str) -> DataFrame:
    """``df`` (a written table) with a gapless row number from 0 in its present order: offsets come from one row per partition."""
    tagged = df.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    counts = sorted((r["_p"], r["n"]) for r in tagged.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())
    rows, at = [], 0
    for p, n in counts:
        rows.append((p, at))
        at += n
    if not rows:
        return df.withColumn(column, F.lit(None).cast("long"))
    offsets = df.sparkSession.createDataFrame(rows, "_p int, _at long")  # one row per partition
    return (tagged.join(F.broadcast(offsets), "_p")
            .withColumn(column, F.col("_at") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_p", "_i", "_at"))
