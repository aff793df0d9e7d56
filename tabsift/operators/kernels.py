"""Kernel support vector machines: explicit feature maps, a linear machine over the mapped rows, Platt-scaled probabilities.

* rbf: random Fourier features of exp(-γ |x − y|²);
* poly: all monomials of (γ x·y + c)^d where they fit the width, else a TensorSketch of it (count sketches of the factors,
  multiplied as polynomials by FFT);
* sigmoid: tanh(γ x·y + c) is indefinite; landmark rows give the map K(x, L) U |Λ|^-½, whose inner products under the signs of
  the eigenvalues approach the kernel; the machine uses the flipped (positive) spectrum.

Maps are numpy functions of a batch, drawn from a seed, and applied inside the tasks that fit and score.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement
from math import comb, factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.portable import hash52
from .many_linear import Problem, fit_many, held_out_margins
from .positions import checkpointed, spread

KERNELS = ("linear", "poly", "rbf", "sigmoid")
#: Width of the maps, and rows that serve as landmarks of the sigmoid kernel.
COMPONENTS, LANDMARKS = 256, 128
PLATT_FOLDS = 5
#: Rows whose map is worked out while it fits the cache.
MAP_ROWS = 256


def exact_kernel(name: str, x: np.ndarray, y: np.ndarray, gamma: float, coef0: float = 0.0, degree: int = 3) -> np.ndarray:
    inner = x @ y.T
    if name == "rbf":
        return np.exp(-gamma * np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * inner, 0))
    return {"linear": lambda: inner, "poly": lambda: (gamma * inner + coef0) ** degree, "sigmoid": lambda: np.tanh(gamma * inner + coef0)}[name]()


class RandomFourier:
    """cos(w·x + b) · √(2 / D): inner products have mean exp(-γ |x − y|²) and error about 1 / √D."""

    def __init__(self, p: int, gamma: float, components: int, seed: int):
        r = np.random.default_rng(seed)
        self.w, self.b, self.width = r.normal(size=(p, components)) * np.sqrt(2 * gamma), r.uniform(0, 2 * np.pi, components), components
        self.signs = np.ones(components)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), self.width))
        self.into(x, out)
        return out

    def into(self, x: np.ndarray, out: np.ndarray) -> None:
        """cos a as 2 / (1 + tan² (a / 2)) - 1, exact to some 1e-16 and a quarter of the time of np.cos."""
        w, b, scale = self.w / 2, self.b / 2, np.sqrt(2 / self.width)
        for at in range(0, len(x), MAP_ROWS):
            t = x[at:at + MAP_ROWS] @ w + b
            np.tan(t, out=t)
            t *= t
            t += 1
            np.divide(2, t, out=t)
            t -= 1
            np.multiply(t, scale, out=out[at:at + MAP_ROWS])


class Monomials:
    """All products of ``degree`` factors among (√γ x, √c), weighted so that inner products are (γ x·y + c)^degree exactly."""

    def __init__(self, p: int, gamma: float, coef0: float, degree: int):
        self.gamma, self.coef0, self.degree = gamma, coef0, degree
        self.terms = list(combinations_with_replacement(range(p + (coef0 > 0)), degree))
        self.scale = np.array([np.sqrt(factorial(degree) / np.prod([factorial(t.count(v)) for v in set(t)])) for t in self.terms])
        self.width, self.signs = len(self.terms), np.ones(len(self.terms))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = x * np.sqrt(self.gamma)
        if self.coef0 > 0:
            z = np.column_stack([z, np.full(len(z), np.sqrt(self.coef0))])
        out = np.tile(self.scale, (len(z), 1))
        for i in range(self.degree):
            out *= z[:, [t[i] for t in self.terms]]
        return out


class TensorSketch:
    """The count sketch of the ``degree``-fold tensor power of (√γ x, √c): unbiased for (γ x·y + c)^degree."""

    def __init__(self, p: int, gamma: float, coef0: float, degree: int, components: int, seed: int):
        r = np.random.default_rng(seed)
        self.gamma, self.coef0, self.width = gamma, coef0, components
        self.place = r.integers(0, components, size=(degree, p + (coef0 > 0)))
        self.sign = r.choice([-1.0, 1.0], size=self.place.shape)
        self.signs = np.ones(components)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = x * np.sqrt(self.gamma)
        if self.coef0 > 0:
            z = np.column_stack([z, np.full(len(z), np.sqrt(self.coef0))])
        product = 1.0
        for place, sign in zip(self.place, self.sign, strict=True):
            sketch = np.zeros((len(z), self.width))
            for j, at in enumerate(place):
                sketch[:, at] += sign[j] * z[:, j]
            product = product * np.fft.rfft(sketch, axis=1)
        return np.fft.irfft(product, n=self.width, axis=1)


class Landmarks:
    """K(x, L) U |Λ|^-½ over the landmark rows L; ``signs`` are those of Λ."""

    def __init__(self, name: str, rows: np.ndarray, gamma: float, coef0: float, degree: int = 3):
        self.name, self.rows, self.gamma, self.coef0, self.degree = name, rows, gamma, coef0, degree
        value, vector = np.linalg.eigh(exact_kernel(name, rows, rows, gamma, coef0, degree))
        kept = np.abs(value) > 1e-10 * max(np.abs(value).max(initial=0.0), 1e-300)
        self.turn = vector[:, kept] / np.sqrt(np.abs(value[kept]))
        self.width, self.signs = int(kept.sum()), np.sign(value[kept])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return exact_kernel(self.name, x, self.rows, self.gamma, self.coef0, self.degree) @ self.turn


def gamma_of(rows: DataFrame, p: int, gamma) -> float:
    """A number, "auto" (1 / p) or "scale" (1 / (p · variance of all entries), 1 where they do not vary)."""
    if gamma == "auto":
        return 1 / p
    if gamma == "scale":
        var = rows.select(F.explode("x").alias("v")).agg(F.var_pop("v")).first()[0]
        return 1 / (p * var) if var else 1.0
    return float(gamma)


def feature_map(rows: DataFrame, p: int, kernel: str = "rbf", gamma="scale", coef0: float = 0.0, degree: int = 3,
                components: int = COMPONENTS, landmarks: int = LANDMARKS, seed: int = 0):
    """The map of a kernel for rows with the array column x; None for a linear one. ``landmarks`` bounds the rows that are sampled
    (those of least hash) for the sigmoid kernel."""
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel {kernel!r}; known: {KERNELS}")
    if kernel == "linear":
        return None
    g = gamma_of(rows, p, gamma)
    if kernel == "rbf":
        return RandomFourier(p, g, components, seed)
    if kernel == "poly" and coef0 >= 0:
        if comb(p + (coef0 > 0) + degree - 1, degree) <= components:
            return Monomials(p, g, coef0, degree)
        return TensorSketch(p, g, coef0, degree, components, seed)
    distinct = rows.select("x").distinct().orderBy(hash52(F.col("x").cast("string"), F.lit(str(seed))), F.col("x").cast("string")).limit(landmarks)
    return Landmarks(kernel, np.array([r["x"] for r in distinct.collect()], dtype=float).reshape(-1, p), g, coef0, degree)


def platt(scores: DataFrame) -> tuple[float, float]:
    """(slope, offset) of P(y = 1) = 1 / (1 + exp(-(slope · score + offset))) for rows (y_true, score), by Newton steps over sums.

    Targets are Platt's: (n1 + 1) / (n1 + 2) for class 1 and 1 / (n0 + 2) for class 0.
    """
    n1, n = scores.agg(F.sum("y_true"), F.count(F.lit(1))).first()
    n1, n = float(n1 or 0), float(n)
    t = F.when(F.col("y_true") == 1, (n1 + 1) / (n1 + 2)).otherwise(1 / (n - n1 + 2))
    a, b, best, da, db, share = 0.0, float(np.log((n1 + 1) / (n - n1 + 1))), np.inf, 0.0, 0.0, 1.0
    to = (a, b)
    for _ in range(60):
        z = F.col("score") * F.lit(to[0]) + F.lit(to[1])
        p = 1 / (1 + F.exp(-z))
        loss = F.greatest(z, F.lit(0.0)) - t * z + F.log1p(F.exp(-F.abs(z)))
        s = F.col("score")
        r = scores.agg(F.sum(loss), F.sum((p - t) * s), F.sum(p - t), F.sum(p * (1 - p) * s * s), F.sum(p * (1 - p) * s), F.sum(p * (1 - p))).first()
        if r[0] is None:
            return a, b
        if r[0] > best + 1e-9 * (1 + abs(best)) and share > 1e-6:
            share /= 2
            to = (a + share * da, b + share * db)
            continue
        settled = best - r[0] < 1e-9 * (1 + abs(r[0]))
        if r[0] <= best:
            (a, b), best = to, r[0]
        if settled:
            break
        haa, hab, hbb = r[3] + 1e-10, r[4], r[5] + 1e-10
        det = haa * hbb - hab * hab
        da, db = (-(hbb * r[1] - hab * r[2]) / det, -(haa * r[2] - hab * r[1]) / det) if det > 0 else (0.0, 0.0)
        share, to = 1.0, (a + da, b + db)
    return a, b


class KernelSVMModel:
    """margin and prob1 (Platt-scaled) of each row; ``coefficients`` are over the mapped features."""

    def __init__(self, mapped, coefficients: np.ndarray, intercept: float, slope: float, offset: float, features: str):
        self.map, self.weights, self.intercept = mapped, np.asarray(coefficients), float(intercept)
        self.slope, self.offset, self.features = float(slope), float(offset), features
        if mapped is None:
            self.coefficients = DenseVector(self.weights)

    def transform(self, df: DataFrame) -> DataFrame:
        mapped, weights, intercept = self.map, self.weights, self.intercept

        @F.pandas_udf("double")
        def margins(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in columns:
                z = np.stack(x.to_numpy()) if len(x) else np.zeros((0, 1))
                yield pd.Series(((mapped(z) if mapped is not None else z) @ weights + intercept) if len(x) else [], dtype="float64")

        out = df.withColumn("margin", margins(vector_to_array(self.features)))
        return out.withColumn("prob1", 1 / (1 + F.exp(-(F.col("margin") * self.slope + self.offset))))


class KernelSVM:
    """C-SVM over a kernel's feature map: the machine on all rows and those of the Platt folds are fitted in the same scans.

    Classes are balanced as n / (2 · n of the class) where ``weight`` is set. Folds go by a hash of the row's values, so equal
    rows share a fold. The hinge is rounded at its corner by 0.01.
    """

    def __init__(self, strength=1.0, kernel="rbf", gamma="scale", coef0=0.0, degree=3, max_iter=100, seed=0, features="features",
                 label="target", weight: str | None = "weight", components=COMPONENTS, landmarks=LANDMARKS):
        if kernel not in KERNELS:
            raise ValueError(f"unknown kernel {kernel!r}; known: {KERNELS}")
        self.strength, self.kernel, self.gamma, self.coef0, self.degree = strength, kernel, gamma, coef0, degree
        self.max_iter, self.seed, self.features, self.label, self.weight = max_iter, seed, features, label, weight
        self.components, self.landmarks = components, landmarks

    def fit(self, df: DataFrame) -> KernelSVMModel:
        fold = F.pmod(hash52(F.col("x").cast("string"), F.lit(str(self.seed))), F.lit(PLATT_FOLDS)).cast("int")
        rows = spread(df.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("double").alias("y")).withColumn("folds", F.array(fold)), gathered=True)
        first = rows.first()
        if first is None:
            raise ValueError("no rows to fit")
        p = len(first["x"])
        mapped = feature_map(rows, p, self.kernel, self.gamma, self.coef0, self.degree, self.components, self.landmarks, self.seed)
        problems = [Problem(self.strength), *(Problem(self.strength, fold=(0, k)) for k in range(PLATT_FOLDS))]
        coef = fit_many(rows, problems, mapped.width if mapped is not None else p, "hinge", self.weight is not None, mapped, self.max_iter, 1e-7)
        slope, offset = platt(checkpointed(held_out_margins(rows, problems[1:], coef[1:], mapped)))
        return KernelSVMModel(mapped, coef[0, :-1], coef[0, -1], slope, offset, self.features)
