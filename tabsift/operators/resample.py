"""Oversampling of the minority class on the train part (OS-1).

Draws are md5 hashes, so the synthetic copies are the same under any
partitioning or task retry. Draw k of a class picks the row at hash position
md5(seed|os|class|k) mod n_class; positions come from ``hash_positions``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.portable import hash52
from .positions import hash_positions
from .split import _chunked_sequence


def random_oversample(train: DataFrame, seed: int = 0, target: str = "target", key: str = "id") -> DataFrame:
    """OS-1: every class is topped up to the largest class by drawing its own rows with replacement.

    Returns the original rows plus the drawn copies (column ``synthetic`` = 1 for copies).
    """
    cls = train.groupBy(target).agg(F.count(F.lit(1)).alias("n_c"))
    cls = cls.withColumn("need", F.max("n_c").over(Window.partitionBy(F.lit(0))) - F.col("n_c"))  # classes: tiny
    crow = cls.collect()
    cls = train.sparkSession.createDataFrame(crow, cls.schema)
    largest = max((r["n_c"] for r in crow), default=0)
    draws = _chunked_sequence(cls.where(F.col("need") > 0), [target], "need", "k")
    draws = draws.withColumn("_pos", F.pmod(hash52(F.lit(str(seed)), F.lit("os"), F.col(target), F.col("k")), F.col("n_c")))
    drawn = draws.groupBy(F.col(target).alias("_cls"), F.col("_pos").alias("_at")).agg(F.count(F.lit(1)).alias("_times"))
    # only (key, class) of the classes that grow is numbered
    grows = [r[target] for r in crow if r["need"] > 0]
    ids = train.where(F.col(target).isin([v for v in grows if v is not None]) | (F.col(target).isNull() if None in grows else F.lit(False)))
    ids = ids.select(key, target, hash52(F.col(key), F.lit(str(seed)), F.lit("os")).alias("_h"))
    ids = hash_positions(ids, [target], "_h", key, out="_pos", max_group_rows=largest)
    times = (ids.join(drawn, F.col(target).eqNullSafe(F.col("_cls")) & (F.col("_pos") == F.col("_at")))
             .select(F.col(key).alias("_key"), "_times"))
    copies = (train.join(times, F.col(key) == F.col("_key"))
              .withColumn("_rep", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
              .drop("_key", "_times", "_rep").withColumn("synthetic", F.lit(1)))
    return train.withColumn("synthetic", F.lit(0)).unionByName(copies)
