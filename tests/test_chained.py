"""Chained equations on pattern statistics, exact rank tests, shared job steps and resumable studies."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsift.operators.impute_iterative import bayesian_ridge, iterative_impute
from tabsift.operators.summarise import arrangements_up_to, mann_whitney, u_counts, upper_tail
from tabsift.plans import jobs as jb
from tabsift.plans import study


def plain_chained(x, train, max_iter=100, tol=1e-3):
    """Round-robin over the rows in numpy: fewest missing first, fitted on train, applied to all."""
    hole = np.isnan(x)
    order = sorted((j for j in range(x.shape[1]) if hole[:, j].any()), key=lambda j: (hole[train, j].sum(), j))
    out = np.where(hole, np.nanmedian(x[train], axis=0), x)
    scale = np.nanmax(np.abs(x[train]))
    for _ in range(max_iter):
        before = out.copy()
        for j in order:
            others = [g for g in range(x.shape[1]) if g != j]
            own = train & ~hole[:, j]
            a, y = out[own][:, others], out[own, j]
            am, ym = a.mean(axis=0), y.mean()
            coef = bayesian_ridge((a - am).T @ (a - am), (a - am).T @ (y - ym), float(((y - ym) ** 2).sum()), own.sum())
            out[hole[:, j], j] = ym + (out[hole[:, j]][:, others] - am) @ coef
        if np.abs(out - before)[train].max() < tol * scale:
            break
    return out


@pytest.fixture(scope="module")
def holey(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) + [0, 50, -7, 1000]
    x[:, 3] += 2 * x[:, 0] - x[:, 1]
    x[rng.random(x.shape) < [0.0, 0.1, 0.25, 0.15]] = np.nan
    part = np.arange(300) % 4 == 0
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], "test" if t else "train") for i, (r, t) in enumerate(zip(x, part))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, part string").cache(), x, ~part


@pytest.mark.parametrize("rounds", [1, 2, 100])
@pytest.mark.parametrize("max_patterns", [None, 2])
def test_equal_to_a_plain_loop(holey, rounds, max_patterns):
    """On pattern statistics, and chained over the rows where patterns are too many."""
    df, x, train = holey
    if max_patterns and rounds == 100:
        rounds = 4
    if rounds < 100:
        with pytest.warns(UserWarning, match="stopped after"):
            got = iterative_impute(df, list("abcd"), max_iter=rounds, tol=1e-12, max_patterns=max_patterns)
    else:
        got = iterative_impute(df, list("abcd"), max_patterns=max_patterns)
    rows = np.array([list(r)[1:5] for r in got.orderBy("id").collect()], dtype=float)
    want = plain_chained(x, train, rounds, 1e-12 if rounds < 100 else 1e-3)
    assert np.allclose(rows, want, rtol=1e-7, atol=1e-6) and got.columns == df.columns


def test_nothing_missing_and_empty_features(spark):
    df = spark.createDataFrame([(i, float(i), float(-i)) for i in range(5)], "id long, a double, b double")
    assert iterative_impute(df, ["a", "b"]).orderBy("id").collect() == df.collect()
    none = df.withColumn("b", F.lit(None).cast("double"))
    assert {r["b"] for r in iterative_impute(none, ["a", "b"]).collect()} == {0.0}


def test_arrangements_against_the_whole_table():
    for m in range(0, 6):
        for n in (0, 1, 3, 7, 20):
            counts = u_counts(m, n)
            assert [arrangements_up_to(m, n, t) for t in range(len(counts))] == np.cumsum(np.array(counts, dtype=object)).tolist()
    counts = u_counts(8, 60)
    for t in (0, 1, 100, 239, 240, 241, 479, 480):
        assert arrangements_up_to(8, 60, t) == sum(counts[:t + 1])


def test_eight_against_a_million():
    m, n = 8, 10 ** 6
    assert arrangements_up_to(m, n, m * n) == math.comb(m + n, m) and arrangements_up_to(m, n, 0) == 1
    assert arrangements_up_to(m, n, 3999999) * 2 + (arrangements_up_to(m, n, 4 * 10 ** 6) - arrangements_up_to(m, n, 4 * 10 ** 6 - 1)) == math.comb(m + n, m)
    sd = math.sqrt(m * n * (m + n + 1) / 12)
    for z in (0.5, 1.5, 2.5):
        normal = 0.5 * math.erfc(z / math.sqrt(2))
        assert upper_tail(m, n, m * n / 2 + z * sd) == pytest.approx(normal, abs=0.012)


def test_large_sample_through_the_operator(spark):
    big = spark.range(100_000).select(F.lit("b").alias("sample"), (F.col("id") * 2.0).alias("value"))
    small = spark.createDataFrame([("a", float(2 * v + 1)) for v in (90_000, 95_000, 99_990, 99_991, 99_992, 99_993, 99_994, 99_995)], "sample string, value double")
    row = mann_whitney(big.unionByName(small).withColumn("g", F.lit(1)), ["g"]).first()
    assert (row["n1"], row["n2"]) == (8, 100_000) and row["p"] == 0.0 and row["u"] > 700_000


JOBS = [["variance_threshold", "z_score_norm", "correlation"], ["variance_threshold", "z_score_norm", "mrmr"], ["variance_threshold", "z_score_norm", "correlation", "sulov"],
        ["z_score_norm", "hand_picked"]]


def test_shared_steps_run_once(spark, sf):
    from tabsift.plans.q_scale import _prepared
    from tabsift.sources.fixtures import W2_FEATURES
    data = _prepared(spark, sf).cache()
    params, log = {"n_top_features": [3], "hand_picked": ["qty", "price", "nothing"]}, []
    out = jb.run_jobs(data, W2_FEATURES, JOBS, params, log)
    assert len(log) == len(set(log)) == 7 and list(out) == [jb.job_name(j) for j in JOBS]
    for job in JOBS:
        frame, feats = jb.run_job(data, W2_FEATURES, job, params)
        shared, kept = out[jb.job_name(job)]
        assert kept == feats and shared.columns == frame.columns
        assert shared.agg(*[F.sum(f) for f in feats]).first() == pytest.approx(frame.agg(*[F.sum(f) for f in feats]).first())
    with pytest.raises(ValueError, match="unknown steps"):
        jb.run_jobs(data, W2_FEATURES, [["z_score_norm"], ["nonsense"]])


def test_memory_steps():
    assert jb.resolved_jobs([["a", "b", "set_memory", "c"], ["get_memory", "d"], ["e"]]) == [["a", "b", "c"], ["a", "b", "d"], ["e"]]
    with pytest.raises(ValueError):
        jb.resolved_jobs([["get_memory", "d"]])


def test_study_goes_on_where_it_stopped(spark, sf, tmp_path):
    from tabsift.sources.fixtures import W1_FEATURES, doc_features
    base = doc_features(spark, sf).cache()
    path, seen = str(tmp_path / "study"), []
    models = {"logistic_regression": {"C": 1.0}, "adaboost": {"n_estimators": 2}}
    run = lambda seeds, jobs: study.run_study(spark, base, W1_FEATURES, path, "e", seeds, jobs, [2, 50], models, on_cell=lambda s, j: seen.append((s, j)))
    assert study.stored(spark, path).count() == 0
    first = run([11], JOBS[:1])
    whole = run([11, 12], JOBS[:2])
    names = [jb.job_name(j) for j in JOBS[:2]]
    assert seen == [(11, names[0]), (11, names[1]), (12, names[0]), (12, names[1])] or set(seen) == {(s, j) for s in (11, 12) for j in names} and len(seen) == 4
    cells = {(r["seed"], r["job"], r["n_top"], r["model"]) for r in whole.select("seed", "job", "n_top", "model").distinct().collect()}
    assert cells == {(s, j, 2, m) for s in (11, 12) for j in names for m in models}
    held = whole.where("seed = 11").where(F.col("job") == names[0]).orderBy("n_top", "model", "id").collect()
    assert first.count() == len(held) and len(held) * 4 == whole.count()
    run([11, 12], JOBS[:2])
    assert len(seen) == 4


def test_study_with_grids(spark, sf, tmp_path):
    from tabsift.sources.fixtures import W1_FEATURES, doc_features
    out = study.run_study(spark, doc_features(spark, sf), W1_FEATURES, str(tmp_path / "g"), "e", [3], JOBS[:1], [2, 3], {"logistic_regression": {}},
                          {"logistic_regression": {"penalty": ["l1", "l2"], "C": [0.01, 1.0], "max_iter": [50]}}, (3, 2))
    assert {r["n_top"] for r in out.select("n_top").distinct().collect()} <= {2, 3} and out.count() > 0
