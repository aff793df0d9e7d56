"""Wide / long conversion and column profiles.

Wide: one column per feature (per-row transforms, model input).
Long: (keys..., feature, value) via ``unpivot`` for per-feature statistics, so
adding features adds rows, not generated code.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def features_of(df: DataFrame, exclude=("id", "target")) -> list[str]:
    ex = set(exclude)
    return [c for c in df.columns if c not in ex]


def to_long(df: DataFrame, keys, features, var: str = "feature", val: str = "value") -> DataFrame:
    """Wide → long, NULLs kept (one row per key and feature)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    cast = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features])
    return cast.unpivot(keys, list(features), var, val)


def to_wide(long: DataFrame, keys, features, var: str = "feature", val: str = "value") -> DataFrame:
    """Long → wide for a known feature list (pivot values given, so no extra pass)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return long.groupBy(*keys).pivot(var, list(features)).agg(F.first(val)).select(*keys, *features)


def nunique_profile(df: DataFrame, features, keys=()) -> DataFrame:
    """Distinct non-null values per feature (and per extra key such as seed).

    Two-phase: (feature, value) pairs are de-duplicated with map-side partial
    aggregation, then counted per feature.
    """
    keys = list(keys)
    long = to_long(df, keys, features)
    return (long.where(F.col("value").isNotNull())
            .select(*keys, "feature", "value").distinct()
            .groupBy(*keys, "feature").agg(F.count(F.lit(1)).cast("bigint").alias("n_unique")))


def levels_up_to(df: DataFrame, features, limit: int, keys=()) -> DataFrame:
    """(keys…, feature, n_levels): distinct non-null values per feature, counted up to ``limit`` + 1 only.

    Answers "more than ``limit`` levels?" without de-duplicating the table: each task keeps at most ``limit`` + 1 values
    per feature and sends those, so the shuffle is tasks × features × (limit + 1) rows whatever the table's size.
    """
    keys, features = list(keys), list(features)
    x = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features])
    schema = T.StructType([*(x.schema[k] for k in keys), T.StructField("feature", T.StringType()), T.StructField("value", T.DoubleType())])

    def few(batches):
        seen: dict[tuple, set] = {}
        for pdf in batches:
            groups = pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)]
            for k, part in groups:
                for f in features:
                    held = seen.setdefault((k if isinstance(k, tuple) else (k,), f), set())
                    if len(held) <= limit:
                        held.update(part[f].dropna().unique()[:limit + 1].tolist())
        rows = [(*k, f, v) for (k, f), held in seen.items() for v in sorted(held)[:limit + 1]]
        if rows:
            yield pd.DataFrame(rows, columns=[*keys, "feature", "value"])

    return (x.mapInPandas(few, schema).distinct().groupBy(*keys, "feature")
            .agg(F.least(F.count(F.lit(1)), F.lit(limit + 1)).cast("bigint").alias("n_levels")))


def levels_map(df: DataFrame, features, limit: int) -> dict[str, int]:
    """Feature → distinct count, exact up to ``limit`` and ``limit`` + 1 beyond."""
    got = {r["feature"]: r["n_levels"] for r in levels_up_to(df, features, limit).collect()}
    return {f: int(got.get(f, 0)) for f in features}


def nunique_map(df: DataFrame, features) -> dict[str, int]:
    """Feature → distinct count, collected (one number per feature)."""
    got = {r["feature"]: r["n_unique"] for r in nunique_profile(df, features).collect()}
    return {f: int(got.get(f, 0)) for f in features}


def non_null_counts(df: DataFrame, features) -> dict[str, int]:
    row = df.agg(*[F.count(F.col(f)).alias(f) for f in features]).first()
    return {f: int(row[f]) for f in features}
