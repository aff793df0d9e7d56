"""Scans of a kernel machine: few tasks, few scans, rows that bend alike multiplied once (F1)."""

from __future__ import annotations

import numpy as np
import pytest

from tabsift.operators import kernels as kn
from tabsift.operators import many_linear as many
from tabsift.operators.positions import spread

FOLDS = [many.Problem(1.0), *(many.Problem(1.0, fold=(0, k)) for k in range(3))]


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 2)) * [1, 30]
    y = ((x[:, 0] ** 2 + 0.4 * rng.normal(size=900)) > 0.8).astype(float)
    folds = rng.integers(0, 3, 900)
    rows = spark.createDataFrame([([float(v) for v in r], float(t), [int(f)]) for r, t, f in zip(x, y, folds)], "x array<double>, y double, folds array<int>")
    return rows.repartition(5).cache(), x, y, folds


def test_halves_of_a_step_are_rated_with_it(noisy, monkeypatch):
    """The same coefficients as with a scan for every half, from four fifths of the scans or less."""
    rows, *_ = noisy
    mapped = kn.RandomFourier(2, 0.3, 24, 5)
    scans, scan = [], many._scan
    monkeypatch.setattr(many, "_scan", lambda *a: scans.append(1) or scan(*a))
    few = many.fit_many(rows, FOLDS, 24, "hinge", True, mapped, 100, 1e-7)
    n = len(scans)
    monkeypatch.setattr(many, "FLAT", {})
    one_by_one = many.fit_many(rows, FOLDS, 24, "hinge", True, mapped, 100, 1e-7)
    assert np.abs(few - one_by_one).max() < 1e-6 * np.abs(few).max()
    assert 5 * n <= 4 * (len(scans) - n)


@pytest.mark.parametrize("asked", [6, 40])
def test_limit_of_steps_counts_halves(noisy, monkeypatch, asked):
    """A fit that is stopped early has the coefficients of the same number of trials, each in a scan of its own."""
    rows, *_ = noisy
    mapped = kn.RandomFourier(2, 0.3, 24, 5)
    monkeypatch.setitem(many.LOSSES, "hinge", (many.hinge_loss, (0.02,), 0.05))
    run = lambda: many.fit_many(rows, FOLDS[:1], 24, "hinge", True, mapped, asked, 1e-7)
    with pytest.warns(UserWarning) if asked == 6 else monkeypatch.context():
        few = run()
        monkeypatch.setattr(many, "FLAT", {})
        assert np.abs(few - run()).max() < 1e-6 * max(np.abs(few).max(), 1)


@pytest.mark.parametrize("stage", [1.0, 0.04])
def test_sums_of_problems_side_by_side(noisy, stage):
    rows, x, y, folds = noisy
    rng = np.random.default_rng(2)
    coef, move = rng.normal(size=(4, 3)) * [0.3, 0.01, 0.3], rng.normal(size=(4, 3)) * 0.02
    weights = [np.array([1.0, 0.5 + 0.1 * q]) for q in range(4)]
    got = {q: s for q, *s in many._scan(many.packed(rows), FOLDS, weights, coef, "hinge", stage, None, move)}
    plain = {q: s for q, *s in many._scan(rows, FOLDS, weights, coef, "hinge", stage, None)}
    z = np.column_stack([x, np.ones(len(x))])
    for q, p in enumerate(FOLDS):
        w = weights[q][y.astype(int)] * (1 if p.fold is None else folds != p.fold[1])
        loss, slope, bend = many.hinge_loss(z @ coef[q], y, stage)
        halves = [many.hinge_loss(z @ (coef[q] - (1 - 0.5 ** k) * move[q]), y, stage)[0] @ w for k in range(1, many.FLAT["hinge"][1] + 1)]
        assert got[q][0] == pytest.approx([loss @ w, *halves]) and plain[q][0] == pytest.approx(loss @ w)
        for value in (got[q], plain[q]):
            assert value[1] == pytest.approx((slope * w) @ z) and value[2] == pytest.approx(z.T @ (z * (w * bend)[:, None]))


def test_kinds_beyond_the_shared_ones(noisy, monkeypatch):
    rows, *_ = noisy
    args = (FOLDS, [np.ones(2)] * 4, np.full((4, 3), 0.05), "hinge", 0.5, None)
    want = {q: s for q, *s in many._scan(rows, *args)}
    monkeypatch.setattr(many, "SHARED_KINDS", 1)
    monkeypatch.setattr(many, "SIDE_BY_SIDE", 2)
    for q, *s in many._scan(rows, *args):
        assert s[2] == pytest.approx(want[q][2]) and s[1] == pytest.approx(want[q][1])


def test_blocks_hold_the_rows(noisy, monkeypatch):
    rows, x, y, folds = noisy
    blocks = many.packed(rows)
    assert blocks.count() == 5 and dict(blocks.dtypes) == dict.fromkeys(("x", "y", "folds"), "binary")
    back = [np.column_stack(p) for p in many._parts(iter(blocks.toArrow().to_batches()))]
    sort = lambda a: a[np.lexsort(a.T)]
    assert (sort(np.concatenate(back)) == sort(np.column_stack([x, y, folds]))).all()
    monkeypatch.setattr(many, "PACKED_BYTES", 100)
    assert many.packed(rows) is rows


def test_few_rows_in_many_partitions_are_gathered(noisy):
    rows, *_ = noisy
    assert spread(rows, gathered=True).rdd.getNumPartitions() == 1 and spread(rows).rdd.getNumPartitions() == 5


def test_map_by_half_tangents():
    rng = np.random.default_rng(4)
    fourier = kn.RandomFourier(3, 0.7, 16, 1)
    for x in (rng.normal(size=(700, 3)) * 40, np.zeros((0, 3)), np.zeros((2, 3))):
        assert np.abs(fourier(x) - np.cos(x @ fourier.w + fourier.b) * np.sqrt(2 / 16)).max(initial=0) < 1e-12
