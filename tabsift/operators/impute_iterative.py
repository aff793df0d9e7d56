"""Iterative (chained-equation) imputation (IMP-3).

Start from train medians. In every round the features with missing cells, fewest missing first, are regressed on all the others by
Bayesian ridge (noise and weight precision found by evidence maximisation) and their missing cells take the prediction,
which the next feature of the round already sees.

Rows that miss the same features (a pattern) are filled by one affine map of what they have, whatever their values: the start
is constant and every update is linear. So the counts, sums and products of the observed cells per pattern, gathered in a single
scan, determine every regression of every round; a round is p × p algebra per pattern on the driver and one scan for its
largest change. The cells are filled once, at the end. A table with more than ``MAX_PATTERNS`` patterns is chained over
the rows themselves instead, one scan a feature, with the same result. Rounds stop when the largest change falls under
tol · max|x|; a run that reaches ``max_iter`` first says so in a warning.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .impute import apply_fill, fit_median
from .positions import checkpointed
from .stats import column_centers


def bayesian_ridge(gram: np.ndarray, xy: np.ndarray, yy: float, n: float, iters: int = 300, tol: float = 1e-3,
                   prior: float = 1e-6) -> np.ndarray:
    """Weights from centred moments (XᵀX, Xᵀy, yᵀy, n), precisions updated until the weights settle."""
    eig, vec = np.linalg.eigh(gram)
    eig = np.maximum(eig, 0.0)
    rotated = vec.T @ xy
    noise, weight = 1.0 / max(yy / n, 1e-12), 1.0
    coef = np.zeros(len(xy))
    for _ in range(iters):
        new = vec @ (rotated / (eig + weight / noise))
        done = np.abs(new - coef).sum() < tol
        coef = new
        rss = max(yy - 2 * coef @ xy + coef @ gram @ coef, 0.0)
        gamma = float((noise * eig / (weight + noise * eig)).sum())
        weight = (gamma + 2 * prior) / (float(coef @ coef) + 2 * prior)
        noise = (n - gamma + 2 * prior) / (rss + 2 * prior)
        if done:
            break
    return coef


#: Patterns of missing features up to which the rounds run on their statistics.
MAX_PATTERNS = 4096


def _codes(hole: np.ndarray) -> np.ndarray:
    """Each row's pattern as a text of 0 and 1."""
    return np.array(["".join(r) for r in np.where(hole, "1", "0")], dtype=object)


class PatternTable:
    """For each pattern of missing features the affine map from a row's observed cells (0 where missing) to the filled row, and the
    count, sums and products of the observed cells of its train rows. Values are less their column's centre."""

    def __init__(self, p: int, start: np.ndarray):
        self.p, self.start = p, start
        self.map: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.stats: dict[str, np.ndarray] = {}

    def add(self, code: str, stats: np.ndarray) -> None:
        here = np.array([c == "0" for c in code])
        self.map[code] = (np.diag(here.astype(float)), np.where(here, 0.0, self.start))
        self.stats[code] = stats

    def moments(self, f: int) -> tuple[float, np.ndarray, np.ndarray]:
        """Count, sums and products of the filled train rows that have ``f``."""
        n, total, product = 0.0, np.zeros(self.p), np.zeros((self.p, self.p))
        for code, stats in self.stats.items():
            if code[f] == "0" and stats[0]:
                a, c = self.map[code]
                s, q = stats[1:1 + self.p], stats[1 + self.p:].reshape(self.p, self.p)
                m = a @ s
                n += stats[0]
                total += m + stats[0] * c
                product += a @ q @ a.T + np.outer(m, c) + np.outer(c, m) + stats[0] * np.outer(c, c)
        return n, total, product

    def update(self, f: int, intercept: float, coef: np.ndarray) -> None:
        """Rows that miss ``f`` take intercept + coef · (the others)."""
        others = [j for j in range(self.p) if j != f]
        for code, (a, c) in self.map.items():
            if code[f] == "1":
                a[f], c[f] = coef @ a[others], intercept + coef @ c[others]

    def round(self, order: list[int]) -> None:
        for f in order:
            n, total, product = self.moments(f)
            intercept, coef = ridge_of(n, total, product, f)
            self.update(f, intercept, coef)

    def filled(self, x: np.ndarray, hole: np.ndarray) -> np.ndarray:
        """Whole rows from rows with holes."""
        out, codes = np.where(hole, 0.0, x), _codes(hole)
        for code in set(codes.tolist()):
            rows = codes == code
            a, c = self.map[code]
            out[rows] = np.where(hole[rows], out[rows] @ a.T + c, x[rows])
        return out

    def copy(self) -> PatternTable:
        other = PatternTable(self.p, self.start)
        other.map = {k: (a.copy(), c.copy()) for k, (a, c) in self.map.items()}
        return other


def ridge_of(n: float, total: np.ndarray, product: np.ndarray, f: int) -> tuple[float, np.ndarray]:
    """(intercept, weights over the other features) from the moments of the rows that have ``f``."""
    n = max(n, 1.0)
    mean = total / n
    cov = product - n * np.outer(mean, mean)
    x = [i for i in range(len(mean)) if i != f]
    coef = bayesian_ridge(cov[np.ix_(x, x)], cov[x, f], float(cov[f, f]), n)
    return float(mean[f] - coef @ mean[x]), coef


def _gathered(df: DataFrame, feats: list[str], centers: np.ndarray, of_train) -> dict[str, np.ndarray]:
    """{pattern: count, sums and products over its train rows}, from one scan (patterns of other rows have zeros)."""
    p = len(feats)

    def fn(batches):
        held: dict[str, np.ndarray] = {}
        for pdf in batches:
            x = pdf[feats].to_numpy(dtype="float64") - centers
            hole, train = np.isnan(x), pdf["_t"].to_numpy(dtype=bool)
            x, codes = np.where(hole, 0.0, x), _codes(hole)
            for code in set(codes.tolist()):
                own = x[(codes == code) & train]
                part = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
                held[code] = held[code] + part if code in held else part
        if held:
            yield pd.DataFrame({"code": list(held), "sums": [v.tobytes() for v in held.values()]})

    def add(batches):
        held: dict[str, np.ndarray] = {}
        for pdf in batches:
            for code, raw in zip(pdf["code"], pdf["sums"]):
                part = np.frombuffer(raw)
                held[code] = held[code] + part if code in held else part
        if held:
            yield pd.DataFrame({"code": list(held), "sums": [v.tobytes() for v in held.values()]})

    schema = "code string, sums binary"
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in feats], of_train.alias("_t")).mapInPandas(fn, schema)
    return {r["code"]: np.frombuffer(r["sums"]) for r in rows.repartition("code").mapInPandas(add, schema).collect()}  # MAX_PATTERNS at most


def _largest_move(train: DataFrame, feats: list[str], centers: np.ndarray, old: PatternTable, new: PatternTable) -> float:
    """The largest difference that two tables' maps make in a missing cell of the train rows: one scan, one number a task."""
    def fn(batches):
        most = 0.0
        for pdf in batches:
            x = pdf[feats].to_numpy(dtype="float64") - centers
            hole = np.isnan(x)
            if hole.any():
                most = max(most, float(np.abs(new.filled(x, hole) - old.filled(x, hole))[hole].max()))
        yield pd.DataFrame({"m": [most]})

    return train.select(*[F.col(f).cast("double").alias(f) for f in feats]).mapInPandas(fn, "m double").agg(F.max("m")).first()[0] or 0.0


def iterative_impute(df: DataFrame, features, part_col: str = "part", seed: int = 0, max_iter: int = 100,
                     tol: float = 1e-3, max_patterns: int | None = None) -> DataFrame:
    """``df`` with missing feature cells filled; fitted on the train part, applied to both."""
    feats = list(features)
    of_train = F.col(part_col) == "train" if part_col in df.columns else F.lit(True)
    train = df.where(of_train)
    counts = train.agg(*[F.count(F.when(F.col(f).isNull(), 1)).alias(f) for f in feats]).first()
    holes = df.agg(*[F.count(F.when(F.col(f).isNull(), 1)).alias(f) for f in feats]).first()
    order = sorted((j for j, f in enumerate(feats) if holes[f]), key=lambda j: (counts[feats[j]], j))
    medians = fit_median(train, feats)
    if not order:
        return apply_fill(df, medians, feats)
    scale = max((abs(v) for v in train.agg(*[F.max(F.abs(f)).alias(f) for f in feats]).first() if v is not None), default=0.0) or 1.0
    centers = column_centers(train, feats)
    shift = np.array([centers[f] for f in feats])
    median_of = {r["feature"]: float(r["fill"]) for r in medians.collect()}
    start = np.array([median_of[f] for f in feats]) - shift
    holey = [f for j, f in enumerate(feats) if j in set(order)]
    limit = MAX_PATTERNS if max_patterns is None else max_patterns
    if df.select(*[F.col(f).isNull() for f in holey]).distinct().limit(limit + 1).count() > limit:
        return _chained(df, feats, order, medians, shift, of_train, max_iter, tol * scale)
    table = PatternTable(len(feats), start)
    for code, stats in sorted(_gathered(df, feats, shift, of_train).items()):
        table.add(code, stats)
    for _ in range(max_iter):
        before = table.copy()
        table.round(order)
        change = _largest_move(train, feats, shift, before, table)
        if change < tol * scale:
            break
    else:
        _unsettled(max_iter, change)

    @F.pandas_udf("array<double>")
    def filled(rows: pd.DataFrame) -> pd.Series:
        x = rows.to_numpy(dtype="float64") - shift
        return pd.Series(list(table.filled(x, np.isnan(x)) + shift))

    out = df.withColumn("_filled", filled(F.struct(*[F.col(f).cast("double").alias(f) for f in feats])))
    return out.select(*[F.coalesce(F.col(c), F.col("_filled")[feats.index(c)]).alias(c) if c in set(holey) else F.col(c) for c in df.columns])


def _unsettled(rounds: int, change: float) -> None:
    warnings.warn(f"iterative imputation stopped after {rounds} rounds; the last one moved cells by up to {change:.3g}", stacklevel=3)


def _chained(df: DataFrame, feats: list[str], order: list[int], medians, shift: np.ndarray, of_train, max_iter: int, least: float) -> DataFrame:
    """The same rounds over the rows themselves: one scan a feature, one written table a round."""
    p, todo = len(feats), [feats[j] for j in order]
    cur = apply_fill(df.select(*[F.col(f).isNull().alias(f"_m_{f}") for f in todo], "*"), medians, feats)
    cur = checkpointed(cur.select(*[F.col(c).cast("double").alias(c) if c in feats else F.col(c) for c in cur.columns]))

    def fit(rows: DataFrame, f: str) -> tuple[float, np.ndarray]:
        def sums(batches):
            total = np.zeros(1 + p + p * p)
            for pdf in batches:
                x = pdf[feats].to_numpy(dtype="float64") - shift
                total += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

        got = np.zeros(1 + p + p * p)
        for r in rows.where(of_train & ~F.col(f"_m_{f}")).select(*feats).mapInPandas(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            got[r["i"]] = r["v"]
        return ridge_of(got[0], got[1:1 + p], got[1 + p:].reshape(p, p), feats.index(f))

    for _ in range(max_iter):
        nxt = cur.select("*", *[F.col(f).alias(f"_o_{f}") for f in todo])
        for f in todo:
            intercept, coef = fit(nxt, f)
            others = [g for g in feats if g != f]
            value = F.lit(intercept + float(shift[feats.index(f)])) + sum((F.lit(float(w)) * (F.col(g) - F.lit(float(shift[feats.index(g)]))) for g, w in zip(others, coef)), F.lit(0.0))
            nxt = nxt.withColumn(f, F.when(F.col(f"_m_{f}"), value).otherwise(F.col(f)))
        nxt = checkpointed(nxt)
        change = nxt.where(of_train).agg(F.max(F.greatest(*[F.abs(F.col(f) - F.col(f"_o_{f}")) for f in todo], F.lit(0.0)))).first()[0] or 0.0
        cur = nxt.drop(*[f"_o_{f}" for f in todo])
        if change < least:
            break
    else:
        _unsettled(max_iter, change)
    return cur.drop(*[f"_m_{f}" for f in todo])
