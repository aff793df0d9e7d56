"""Cleaning: keys, column drops, coercion to numbers, missing-value rules (CL-*)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import features_of, levels_map, non_null_counts, to_long

# Fixed value: what counts as a number in a text cell (sign, digits, decimal point, exponent).
NUMERIC_RE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def set_key(df: DataFrame, key: str) -> DataFrame:
    """CL-1: name the id column ``id`` and put it first."""
    out = df.withColumnRenamed(key, "id") if key != "id" else df
    return out.select("id", *[c for c in out.columns if c != "id"])


def key_report(df: DataFrame, key: str = "id") -> DataFrame:
    """CL-1 check: rows, distinct keys and keys used more than once (one row)."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").cast("bigint").alias("n_rows"),
        F.count(F.lit(1)).cast("bigint").alias("n_keys"),
        F.count(F.when(F.col("n") > 1, 1)).cast("bigint").alias("n_duplicate_keys"),
    )


def drop_columns_regex(df: DataFrame, patterns, target: str = "target", key: str = "id") -> DataFrame:
    """CL-2: drop features whose name matches any pattern anywhere (search); target kept, moved last."""
    rx = [re.compile(p) for p in patterns]
    keep = [c for c in df.columns if c not in (key, target) and not any(r.search(c) for r in rx)]
    head = [key] if key in df.columns else []
    return df.select(*head, *keep, target)


def target_last(df: DataFrame, target: str = "target", key: str = "id") -> DataFrame:
    """CL-3: key first, features, target last."""
    head = [key] if key in df.columns else []
    return df.select(*head, *[c for c in df.columns if c not in (key, target)], target)


def coerce_numeric(df: DataFrame, key: str = "id", columns=None) -> DataFrame:
    """CL-4: every non-key column to DOUBLE; text that is not a number and NaN become NULL."""
    columns = [c for c in (columns or df.columns) if c != key]
    types = dict(df.dtypes)
    exprs = []
    for c in df.columns:
        if c not in columns:
            exprs.append(F.col(c))
            continue
        col = F.col(c)
        if types[c] == "string":
            v = F.when(col.rlike(NUMERIC_RE), F.trim(col).try_cast("double"))
        else:
            v = col.cast("double")
        exprs.append(F.when(~F.isnan(v), v).alias(c))
    return df.select(*exprs)


def zero_to_null(df: DataFrame, features, max_levels: int = 5, profile: dict | None = None) -> DataFrame:
    """CL-6: in features with more than ``max_levels`` distinct values, 0 means missing."""
    profile = profile or levels_map(df, features, max_levels)
    many = {f for f in features if profile[f] > max_levels}
    return df.select(*[F.when(F.col(c) != 0, F.col(c)).alias(c) if c in many else F.col(c) for c in df.columns])


def drop_empty_columns(df: DataFrame, features, counts: dict | None = None) -> DataFrame:
    """CL-7: drop features where every value is missing (one aggregate pass)."""
    counts = counts or non_null_counts(df, features)
    empty = {f for f in features if counts[f] == 0}
    return df.select(*[c for c in df.columns if c not in empty])


def drop_null_target(df: DataFrame, target: str = "target") -> DataFrame:
    """CL-8."""
    return df.where(F.col(target).isNotNull())


def clean_up(df: DataFrame, key: str, target: str, patterns=None, max_levels: int = 5,
             zero_rule_on_target: bool = False) -> DataFrame:
    """CL-9: key → regex drop → numbers → zero rule → empty columns → rows with target.

    Distinct counts are taken after coercion; emptiness after the zero rule.
    The target is excluded from the zero rule unless ``zero_rule_on_target``.
    """
    out = set_key(df, key)
    if patterns:
        out = drop_columns_regex(out, patterns, target)
    out = target_last(out, target)
    out = coerce_numeric(out, "id")
    feats = features_of(out, ("id", target))
    zero_cols = feats + ([target] if zero_rule_on_target else [])
    # Levels are counted up to the limit only; non-null and zero cells are one aggregate. No cell is shuffled.
    nu = levels_map(out, zero_cols, max_levels)
    row = out.agg(*[e for i, c in enumerate(zero_cols) for e in (F.count(F.col(c)).alias(f"n{i}"), F.count(F.when(F.col(c) == 0, 1)).alias(f"z{i}"))]).first()
    left = {c: row[f"n{i}"] - (row[f"z{i}"] if nu[c] > max_levels else 0) for i, c in enumerate(zero_cols)}
    out = zero_to_null(out, zero_cols, max_levels, nu)
    out = drop_empty_columns(out, feats, {f: left[f] for f in feats})
    return drop_null_target(out, target)


def drop_null_rows(df: DataFrame) -> DataFrame:
    """CL-10 / IMP-1: drop rows with any missing value."""
    return df.na.drop("any")


def null_violations(df: DataFrame, columns) -> DataFrame:
    """CL-11: columns holding missing values, as rows (feature, n_null); empty when clean."""
    long = to_long(df, [], columns)
    return (long.groupBy("feature")
            .agg(F.count(F.when(F.col("value").isNull(), 1)).cast("bigint").alias("n_null"))
            .where("n_null > 0"))


def assert_no_nulls(df: DataFrame, columns) -> None:
    bad = null_violations(df, columns).collect()
    if bad:
        raise ValueError(f"missing values in {[r['feature'] for r in bad]}; impute first")


def drop_low_cardinality(df: DataFrame, features, levels=(1, 2), profile: dict | None = None) -> DataFrame:
    """CL-12: drop features with 1 or 2 distinct values."""
    profile = profile or levels_map(df, features, max(levels))
    drop = {f for f in features if profile[f] in set(levels)}
    return df.select(*[c for c in df.columns if c not in drop])


def select_features(df: DataFrame, features, target: str = "target", key: str = "id") -> DataFrame:
    """CL-13: keep the given features (in that order) and the target."""
    head = [key] if key in df.columns else []
    return df.select(*head, *features, target)


def column_concat(a: DataFrame, b: DataFrame, key: str = "id", how: str = "inner") -> DataFrame:
    """CL-14: align two frames on the key (pandas concat(axis=1) → join)."""
    return a.join(b, key, how)


def drop_rows_by_key(df: DataFrame, other: DataFrame, key: str = "id") -> DataFrame:
    """CL-15: rows of ``df`` whose key is not in ``other``."""
    return df.join(other.select(key), key, "left_anti")


def melt(df: DataFrame, id_vars, features) -> DataFrame:
    """CL-16: wide → long with columns variable, value."""
    return to_long(df, id_vars, features, "variable", "value")


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
