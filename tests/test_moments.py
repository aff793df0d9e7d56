"""Correlations, distances and F values on columns with a large offset."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsift.operators.select import anova_f, regression_f, target_corr_by
from tabsift.operators.stats import distances, inversions, kendall, pair_corr


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e9])
def test_offset_changes_nothing(spark, offset):
    rng = np.random.default_rng(3)
    x = rng.normal(size=800)
    y = x + 0.5 * rng.normal(size=800)
    t = (x + rng.normal(size=800) > 0).astype(float)
    df = spark.createDataFrame([(int(i), float(a), float(b), 7.3, float(c)) for i, (a, b, c) in enumerate(zip(x + offset, y - offset, t))],
                               "id long, x double, y double, c double, target double").repartition(5)
    true = np.corrcoef(x, y)[0, 1]
    r = {(q["a"], q["b"]): q["r"] for q in pair_corr(df, ["x", "y", "c"]).collect()}
    assert r["x", "y"] == pytest.approx(true, abs=1e-5) and abs(r["x", "y"]) <= 1
    assert r["x", "c"] is None and r["y", "c"] is None
    by = {q["feature"]: q["r"] for q in target_corr_by(df, ["x", "y", "c"], []).collect()}
    assert by["x"] == pytest.approx(np.corrcoef(x, t)[0, 1], abs=1e-5) and by["c"] is None
    d = {(q["a"], q["b"]): q["distance"] for q in distances(df, ["x", "y"]).collect()}
    assert d["x", "y"] == pytest.approx(np.linalg.norm((x + offset) - (y - offset)), rel=1e-9)
    f = {q["feature"]: q["f"] for q in anova_f(df, ["x"]).collect()}["x"]
    groups = [x[t == k] for k in (0, 1)]
    between = sum(len(g) * (g.mean() - x.mean()) ** 2 for g in groups)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups)
    assert f == pytest.approx(between / (within / 798), rel=1e-4)
    rf = {q["feature"]: q["f"] for q in regression_f(df.withColumn("target", F.col("y")), ["x"]).collect()}["x"]
    assert rf == pytest.approx(true ** 2 / (1 - true ** 2) * 798, rel=1e-4)


def test_inversions():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 60, 333):
        y, w = rng.integers(0, 30, n).astype(float), rng.integers(1, 4, n).astype(float)
        assert inversions(y, w) == sum(w[i] * w[j] for i in range(n) for j in range(i + 1, n) if y[i] > y[j])


@pytest.mark.parametrize("rows_per_range", [50_000, 40])
def test_kendall_against_all_pairs(spark, rows_per_range):
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    cols = {"x": x, "y": (x + rng.normal(size=300)).round(1), "b": (x > 0.3).astype(float), "c": np.full(300, 2.0), "t": rng.integers(0, 4, 300).astype(float)}
    rows = [(i, *[None if (i + j) % 17 == 0 else float(v[i]) for j, v in enumerate(cols.values())]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols)).repartition(3)
    got = {(r["a"], r["b"]): r["r"] for r in kendall(df, list(cols), rows_per_range).collect()}
    names = list(cols)
    for i, a in enumerate(names):
        for j, b in enumerate(names[i + 1:], i + 1):
            both = [(r[1 + i], r[1 + j]) for r in rows if r[1 + i] is not None and r[1 + j] is not None]
            u, v = np.array(both).T
            s = np.sign(u[:, None] - u[None]) * np.sign(v[:, None] - v[None])
            den = np.sqrt((np.sign(u[:, None] - u[None]) ** 2).sum() * (np.sign(v[:, None] - v[None]) ** 2).sum())
            want = s.sum() / den if den > 0 else None
            assert got[a, b] == (pytest.approx(want, abs=1e-12) if want is not None else None), (a, b)


@pytest.mark.parametrize("heavy", [100_000, 5])
def test_spearman_with_heavy_values(spark, monkeypatch, heavy):
    from tabsift.operators import stats
    monkeypatch.setattr(stats, "HEAVY_ROWS", heavy)
    rng = np.random.default_rng(7)
    x, b = rng.normal(size=200), (rng.random(200) < 0.4).astype(float)
    df = spark.createDataFrame([(i, float(x[i]), float(b[i]), 1.0) for i in range(200)], "id long, x double, b double, c double")
    got = {(r["a"], r["b"]): r["r"] for r in pair_corr(df, ["x", "b", "c"], "spearman").collect()}
    rank = lambda v: np.array([(v < q).sum() + ((v == q).sum() + 1) / 2 for q in v])
    assert got["x", "b"] == pytest.approx(np.corrcoef(rank(x), rank(b))[0, 1]) and got["x", "c"] is None


@pytest.mark.parametrize("rows_per_range,block", [(60, 16), (7, 8192), (400, 5)])
def test_kendall_over_many_ranges(spark, monkeypatch, rows_per_range, block):
    """Heavy values on both sides and groups over many tasks give the merged count."""
    from tabsift.operators import stats
    rng = np.random.default_rng(3)
    x = np.where(rng.random(700) < 0.4, 5.0, rng.integers(0, 60, 700)).astype(float)
    cols = {"x": x, "y": np.where(rng.random(700) < 0.3, 1.0, x + rng.normal(size=700) * 9).round(), "z": rng.normal(size=700)}
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(*cols.values()))], "id long, " + ", ".join(f"{c} double" for c in cols))
    whole = {(r["a"], r["b"]): r["r"] for r in kendall(df, list(cols)).collect()}
    monkeypatch.setattr(stats, "BLOCK_ROWS", block)
    cut = {(r["a"], r["b"]): r["r"] for r in kendall(df, list(cols), rows_per_range).collect()}
    assert cut == pytest.approx(whole, abs=1e-12)
