"""Yeo–Johnson power normaliser (NO-8): maximum-likelihood λ per feature on train, then z-score.

The log-likelihood of a grid of λ for all features is one scan of the wide rows, in numpy; grids narrow
(or move outwards) pass by pass until λ is found to the tolerance.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import apply_linear, fit_linear


def yeo_johnson(x: Column, lam: Column) -> Column:
    pos = x >= 0
    eps = 1e-12
    a = F.when(F.abs(lam) < eps, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    b = F.when(F.abs(lam - 2) < eps, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    return F.when(pos, a).otherwise(b)


def _psi(x: np.ndarray, u: np.ndarray, lam: float) -> np.ndarray:
    """``yeo_johnson`` of the values x at ``lam``; u = log1p(|x|). Powers of x + 1 itself, so large values cost no digits."""
    out = np.empty_like(u)
    for part, sign, power in ((~(x < 0), 1.0, lam), (x < 0, -1.0, 2 - lam)):
        out[part] = sign * (u[part] if abs(power) < 1e-12 else (np.power(np.abs(x[part]) + 1, power) - 1) / power)
    return out


def _loglik(table: DataFrame, grid: dict[str, list[float]]) -> dict[str, list[tuple[float, float]]]:
    """{feature: [(lam, log-likelihood)]} for the grid of each feature (a column of ``table``; nulls are left out), from one scan.

    A task sends one row a feature: count, sum of signed logs, and mean and squares about the mean for each λ, so large values cost no digits."""
    names = list(grid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((2 + 2 * len(grid[f]))) for f in names]
        with np.errstate(all="ignore"):
            for batch in batches:
                for f, total in zip(names, held, strict=True):
                    x = batch.column(f).drop_null().to_numpy(zero_copy_only=False)
                    if not len(x):
                        continue
                    u = np.log1p(np.abs(x))
                    part = np.empty_like(total)
                    part[0], part[1] = len(x), (np.sign(x) * u).sum()
                    for i, lam in enumerate(grid[f]):
                        psi = _psi(x, u, lam)
                        part[2 + 2 * i] = mean = psi.mean()
                        gap = psi - mean
                        part[3 + 2 * i] = (gap * gap).sum()
                    total[:] = _merged(total, part)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([t.tobytes() for t in held], pa.binary())], ["feature", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, np.ndarray] = {}
        with np.errstate(all="ignore"):
            for batch in batches:
                for f, raw in zip(batch.column("feature").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                    part = np.frombuffer(raw)
                    out[f] = _merged(out[f], part) if f in out else part
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array([t.tobytes() for t in out.values()], pa.binary())], ["feature", "sums"])

    schema, found = "feature string, sums binary", {}
    for r in table.mapInArrow(run, schema).repartition("feature").mapInArrow(add, schema).collect():
        n, logs, *rest = np.frombuffer(r["sums"]).tolist()
        if n:
            found[r["feature"]] = [(lam, -n / 2 * math.log(max(rest[2 * i + 1] / n, 1e-300)) + (lam - 1) * logs)
                                   for i, lam in enumerate(grid[r["feature"]]) if not math.isnan(rest[2 * i + 1])]
    return found


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sums of two parts: counts and logs add up, means and squares about them are brought to the common mean."""
    if not a[0] or not b[0]:
        return b.copy() if not a[0] else a
    out, n = a + b, a[0] + b[0]
    gap = b[2::2] - a[2::2]
    out[2::2] = a[2::2] + gap * (b[0] / n)
    out[3::2] += gap * gap * (a[0] * b[0] / n)
    return out


#: Values of λ tried inside a bracket in one pass; the width at which a bracket is narrow enough; the widest range.
POINTS, TOLERANCE, WIDEST = 16, 1e-6, 200.0


def fit_lambdas(train: DataFrame, features, tolerance: float = TOLERANCE) -> dict[str, float]:
    """Maximum-likelihood λ per feature (features without values are left out).

    A pass scores a grid of λ for all features at once. A bracket whose best point is an end moves on outwards and
    doubles; else it shrinks to the neighbours of its best point, until it is narrower than ``tolerance``. A feature whose likelihood still rises at ±WIDEST is said so.
    """
    table = train.select(*[F.col(f).cast("double").alias(f) for f in features]).cache()
    ends = table.agg(*[e for i, f in enumerate(features) for e in (F.min(f).alias(f"l{i}"), F.max(f).alias(f"h{i}"))]).first()
    spread = {f: (ends[f"l{i}"], ends[f"h{i}"]) for i, f in enumerate(features)}
    done = {f: 1.0 for f, (lo, hi) in spread.items() if lo is not None and lo == hi}  # every λ is as good for a constant
    open_ = {f: (-3.0, 3.0) for f, (lo, hi) in spread.items() if lo is not None and lo != hi}
    while open_:
        got = _loglik(table.select(*open_), {f: [lo + (hi - lo) * i / POINTS for i in range(POINTS + 1)] for f, (lo, hi) in open_.items()})
        for f in list(open_):
            vals = sorted(got.get(f, []))
            lo, hi = open_.pop(f)
            if not vals:
                continue  # no values in train
            i = max(range(len(vals)), key=lambda t: (vals[t][1], -abs(vals[t][0] - 1)))
            if i in (0, len(vals) - 1) and abs(vals[i][0]) < WIDEST and hi - lo >= tolerance:
                step = (hi - lo) / POINTS
                open_[f] = (vals[i][0] - 2 * (hi - lo), vals[i][0] + step) if i == 0 else (vals[i][0] - step, vals[i][0] + 2 * (hi - lo))
            elif i in (0, len(vals) - 1) or hi - lo < tolerance * POINTS:
                if abs(vals[i][0]) >= WIDEST:
                    warnings.warn(f"the likelihood of {f!r} still rises at a power of {vals[i][0]:.0f}", stacklevel=2)
                done[f] = vals[i][0]
            else:
                open_[f] = (vals[i - 1][0], vals[i + 1][0])
    table.unpersist()
    return {f: done[f] for f in features if f in done}


def power_norm(df: DataFrame, features, by=(), part_col: str = "part") -> DataFrame:
    if by:
        raise NotImplementedError("power_norm fits one λ per feature; split by key first")
    train = df.where(F.col(part_col) == "train") if part_col in df.columns else df
    lams = fit_lambdas(train, features)
    out = df.select(*[yeo_johnson(F.col(c), F.lit(lams[c])).alias(c) if c in lams else F.col(c) for c in df.columns])
    t2 = out.where(F.col(part_col) == "train") if part_col in out.columns else out
    return apply_linear(out, fit_linear(t2, list(lams), "z_score_norm"), list(lams))
