"""Exact positions / quantiles: bucketed results equal the single-bucket ones and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsift.functions.portable import hash52
from tabsift.operators.positions import exact_quantile_grid, exact_quantiles, hash_positions, value_positions


def test_value_positions_bucketed_equals_plain(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 3000), rng.integers(0, 200, 3000))]
    df = spark.createDataFrame(rows, "g int, v double")
    a = {(r.g, r.value): (r.cnt, r.cum, r.k) for r in value_positions(df, ["g"], "v").collect()}
    b = {(r.g, r.value): (r.cnt, r.cum, r.k) for r in value_positions(df, ["g"], "v", rows_per_bucket=37).collect()}
    assert a == b
    for g in range(3):
        vals = sorted(v for gg, v in rows if gg == g)
        for (gg, v), (cnt, cum, _) in a.items():
            if gg == g:
                assert cum == sum(1 for x in vals if x < v) and cnt == vals.count(v)


@pytest.mark.parametrize("probs", [[0.5], [0.0, 0.25, 0.75, 1.0], [0.1, 0.33]])
def test_exact_quantiles_match_numpy(spark, probs):
    rng = np.random.default_rng(7)
    vals = rng.normal(size=501).round(2)
    df = spark.createDataFrame([(0, float(v)) for v in vals] + [(0, None)], "g int, v double")
    got = {r.prob: r.q for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.percentile(vals, p * 100)), abs=1e-12)


def test_quantile_grid_matches_generic(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(int(i % 2), float(x)) for i, x in enumerate(rng.integers(0, 50, 400))], "g int, v double")
    m = 21
    a = {(r.g, r.prob): r.q for r in exact_quantile_grid(df, ["g"], "v", m).collect()}
    b = {(r.g, r.prob): r.q for r in exact_quantiles(df, ["g"], "v", [i / (m - 1) for i in range(m)]).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-12)


def test_hash_positions_dense_and_bucket_independent(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"))
    df = df.withColumn("h", hash52(F.col("id"), F.lit("5")))
    a = {r.id: r.pos for r in hash_positions(df, ["g"], "h", "id").collect()}
    b = {r.id: r.pos for r in hash_positions(df, ["g"], "h", "id", bucket_bits=4).collect()}
    assert a == b
    for g in range(3):
        got = sorted(a[i] for i in range(1000) if i % 3 == g)
        assert got == list(range(len(got)))


def test_positions_without_groups_in_buckets(spark):
    df = spark.createDataFrame([(float(i * 7919 % 500),) for i in range(1500)] + [(None,)], "v double")
    plain = sorted(tuple(r) for r in value_positions(df, [], "v").collect())
    assert sorted(tuple(r) for r in value_positions(df, [], "v", rows_per_bucket=100).collect()) == plain
    assert len(plain) == 500


@pytest.mark.parametrize("groups", [["g"], []])
def test_quantiles_through_brackets(spark, groups):
    """Large groups go through narrowed brackets: same numbers, also with heavy ties and a null group."""
    rng = np.random.default_rng(5)
    rows = [(1, float(v)) for v in rng.normal(size=4000)] + [(2, float(v)) for v in rng.integers(0, 3, 3000)] + [(None, float(v)) for v in rng.exponential(size=2500)]
    df = spark.createDataFrame(rows + [(1, None)], "g int, v double").repartition(4)
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    got = {(r["g"] if groups else 0, r["prob"]): r["q"] for r in exact_quantiles(df, groups, "v", probs, rows_per_bucket=50).collect()}
    for g in ([1, 2, None] if groups else [0]):
        vals = [v for gg, v in rows if not groups or gg == g]
        for p in probs:
            assert got[g, p] == pytest.approx(float(np.percentile(vals, 100 * p)), abs=1e-12), (g, p)
