"""Many linear classifiers in one scan: all grid points and folds (or classes of rows held out) are fitted together.

Every problem minimises mean weighted loss + λ · (r · |b|₁ + (1 − r) / 2 · |b|²) over its own rows, the intercept free of
penalty. Coefficients of all problems form one matrix, a problem's rows are chosen by a mask of folds, and each Newton
step of all of them needs one scan: a task adds up loss, gradient and curvature per problem and sends one small row a
problem; the driver solves the penalised quadratic (p-sized algebra) and halves a problem's step where its loss rose. For a hinge,
whose steps are often halved many times, the scan that rates a step rates its halves too, and rows that bend alike in all
problems are multiplied once. A feature map (kernels) is applied inside the task, so mapped rows are never stored.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.portable import sigmoid
from .positions import checkpointed, spread

#: Doubles of curvature that a task holds at most: more problems take several scans a step.
SCAN_DOUBLES = 1 << 23
#: Rows of a batch that are mapped and multiplied at once.
BATCH_ROWS = 4096
#: So few problems are rated side by side, whatever their folds; more go fold by fold.
SIDE_BY_SIDE = 48
#: Bytes of packed rows in a partition; larger ones stay as rows, which come in batches of bounded size.
PACKED_BYTES = 1 << 26
#: Kinds of rows (class and folds) whose products a task adds up for all problems at once.
SHARED_KINDS = 64


@dataclass(frozen=True)
class Problem:
    """``strength``: C, so that λ = 1 / (C · Σ weights). ``fold``: (repeat, held-out fold), or None for all rows. ``active``: the
    features that may have a coefficient, or None for all."""

    strength: float
    l1_ratio: float = 0.0
    fold: tuple[int, int] | None = None
    active: tuple[int, ...] | None = None


def logistic_loss(margin: np.ndarray, y: np.ndarray, _: float):
    """(loss, slope, curvature) by margin for y of 0 and 1."""
    sign = 2 * y - 1
    m = sign * margin
    p = 1 / (1 + np.exp(np.clip(m, -500, 500)))  # weight of being wrong
    return np.logaddexp(0, -m), -sign * p, p * (1 - p)


def hinge_loss(margin: np.ndarray, y: np.ndarray, width: float):
    """The hinge with its corner rounded over ``width`` on either side of 1: at most width / 4 above the hinge itself."""
    sign = 2 * y - 1
    gap = 1 - sign * margin
    t = np.clip((gap + width) / (2 * width), 0, 1)
    return np.where(gap >= width, gap, width * t * t), -sign * t, ((t > 0) & (t < 1)) / (2 * width)


def hinge_value(margin: np.ndarray, y: np.ndarray, width: float) -> np.ndarray:
    """The loss of ``hinge_loss`` alone."""
    gap = 1 - (2 * y - 1) * margin
    t = np.clip((gap + width) / (2 * width), 0, 1)
    return np.where(gap >= width, gap, width * t * t)


#: The loss, the widths that it goes through, and the least curvature of the intercept (steps only; optima stay).
LOSSES = {"logistic": (logistic_loss, (0.0,), 0.0), "hinge": (hinge_loss, (1.0, 0.2, 0.04, 0.01), 0.05)}
#: Losses whose curvature is the same wherever they bend: the value alone, and the halvings of a step that are rated with the step.
FLAT = {"hinge": (hinge_value, 12)}


def fold_table(df: DataFrame, features: str, label: str, folds: DataFrame | None = None, key: str = "id") -> DataFrame:
    """x (array), y (0 / 1) and folds (array by repeat): the narrow rows that every scan reads, written once."""
    rows = df.select(*([key] if folds is not None else []), vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    if folds is None:
        return spread(rows.withColumn("folds", F.array().cast("array<int>")), gathered=True)
    by_row = folds.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("repeat", "fold"))), lambda s: s["fold"].cast("int")).alias("folds"))
    return spread(rows.join(by_row, key), gathered=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def packed(rows: DataFrame) -> DataFrame:
    """Rows of ``fold_table`` as blocks, each column's numbers as bytes, for tables that are scanned some hundred times; ``rows``
    itself where a partition is large."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, folds in _parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(c, dtype=float).tobytes()], pa.binary()) for c in (x, y, folds)], ["x", "y", "folds"])

    blocks = checkpointed(rows.mapInArrow(pack, "x binary, y binary, folds binary"))
    sizes = blocks.groupBy(F.spark_partition_id()).agg(F.sum(F.length("x") + F.length("y") + F.length("folds")).alias("n"))
    return blocks if (sizes.agg(F.max("n")).first()[0] or 0) <= PACKED_BYTES else rows


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, folds) of at most BATCH_ROWS rows, from rows or blocks."""
    for batch in batches:
        if pa.types.is_binary(batch.schema.field("x").type):
            for block in zip(*(batch.column(c) for c in ("x", "y", "folds")), strict=True):
                x, y, folds = (np.frombuffer(c.as_buffer()) for c in block)
                yield x.reshape(len(y), -1), y, folds.reshape(len(y), -1)
            continue
        for at in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(at, BATCH_ROWS)
            yield _matrix(part.column("x")), part.column("y").to_numpy(zero_copy_only=False), _matrix(part.column("folds"))


def _batches(batches: Iterator[pa.RecordBatch], feature_map) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(mapped rows with a last column of ones, y, folds)."""
    for x, y, folds in _parts(batches):
        if hasattr(feature_map, "into"):
            z = np.ones((len(x), feature_map.width + 1))
            feature_map.into(x, z[:, :-1])
            yield z, y, folds
        else:
            x = feature_map(x) if feature_map is not None else x
            yield np.column_stack([x, np.ones(len(x))]), y, folds


def class_counts(rows: DataFrame) -> dict:
    """{(repeat, fold): (rows of class 0, of class 1)} and {None: ...} for all rows, from one aggregate."""
    out: dict = {None: np.zeros(2)}
    for r in rows.groupBy("y").count().collect():
        out[None][int(r["y"])] += r["count"]
    for r in rows.select("y", F.posexplode("folds").alias("repeat", "fold")).groupBy("y", "repeat", "fold").count().collect():
        out.setdefault((r["repeat"], r["fold"]), np.zeros(2))[int(r["y"])] += r["count"]
    return out


def _row_weights(folds: np.ndarray, y: np.ndarray, fold, weights: np.ndarray) -> np.ndarray:
    w = weights[y.astype(np.int64)]
    return w if fold is None else w * (folds[:, fold[0]] != fold[1])


def fit_many(rows: DataFrame, problems: list[Problem], width: int, loss: str = "logistic", balanced: bool = True,
             feature_map: Callable[[np.ndarray], np.ndarray] | None = None, max_iter: int = 100, tol: float = 1e-9) -> np.ndarray:
    """Coefficients (one row a problem, the intercept last) for rows of ``fold_table``; ``width`` is the number of (mapped) features.

    ``balanced`` weighs the classes of each problem's rows by n / (2 · n of the class). Problems that have not settled after
    ``max_iter`` steps keep their last coefficients and a warning says how many.
    """
    counts = class_counts(rows)
    weights, total = [], np.zeros(len(problems))
    for q, p in enumerate(problems):
        n = counts[None] - (counts.get(p.fold, np.zeros(2)) if p.fold is not None else 0)
        w = n.sum() / (2 * np.maximum(n, 1)) if balanced else np.ones(2)
        weights.append(w)
        total[q] = max(float((w * n).sum()), 1.0)
    lam = 1 / (np.array([p.strength for p in problems], dtype=float) * total)
    l1, l2 = lam * np.array([p.l1_ratio for p in problems]), lam * (1 - np.array([p.l1_ratio for p in problems]))
    coef, left = np.zeros((len(problems), width + 1)), 0
    stages = LOSSES[loss][1]
    rows = packed(rows) if loss in FLAT else rows
    for stage in stages:
        coef, left = _newton(rows, problems, weights, total, l1, l2, coef, loss, stage, feature_map, max_iter, tol)
    if left:
        warnings.warn(f"{left} of {len(problems)} fits had not settled after {max_iter} steps", stacklevel=2)
    return coef


def _newton(rows, problems, weights, total, l1, l2, coef, loss, stage, feature_map, max_iter, tol):
    d = coef.shape[1]
    per_scan = max(1, SCAN_DOUBLES // (d * d))
    free = np.ones(coef.shape, dtype=bool)
    for q, p in enumerate(problems):
        if p.active is not None:
            free[q, :-1] = False
            free[q, list(p.active)] = True
    penalty = lambda b, q: l1[q, None] * np.abs(b) + l2[q, None] / 2 * b * b
    cost = lambda value, b, q=slice(None): value + penalty(b[:, :-1], q).sum(axis=1)
    halvings = FLAT[loss][1] if loss in FLAT else 0
    best, trial, step = np.full(len(problems), np.inf), coef.copy(), np.zeros_like(coef)
    coef, share, active = coef.copy(), np.ones(len(problems)), np.ones(len(problems), dtype=bool)
    rated, left = np.zeros(len(problems), dtype=int), 0  # trials of each problem
    while active.any():
        asked = np.flatnonzero(active)
        value, grad, curve = np.zeros((len(problems), 1 + halvings)), np.zeros_like(coef), {}
        for at in range(0, len(asked), per_scan):
            some = asked[at:at + per_scan]
            move = trial[some] - coef[some] if halvings and step[some].any() else None
            for q, v, g, h in _scan(rows, [problems[q] for q in some], [weights[q] for q in some], trial[some], loss, stage, feature_map, move):
                value[some[q], :np.size(v)], grad[some[q]], curve[some[q]] = v / total[some[q]], g / total[some[q]], h / total[some[q]]
        now, limit = cost(value[:, 0], trial), best + 1e-12 * (1 + np.abs(best))
        rated[asked] += 1
        rose = active & (now > limit) & (share > 1e-6)
        for q in np.flatnonzero(rose):  # to the first half that does not rise, or the first that is not rated yet
            for half in range(1, halvings + 2):
                share[q] /= 2
                trial[q] = coef[q] + share[q] * step[q]
                if half > halvings or share[q] <= 1e-6 or not cost(value[[q], half], trial[[q]], [q])[0] > limit[q]:
                    break
                rated[q] += 1
        good = active & ~rose
        still = good & (best - now <= tol * (1 + np.abs(now))) & np.isfinite(best)
        improved = good & (now <= best)
        coef[improved] = trial[improved]
        best[improved] = now[improved]
        active &= ~still
        left += int((active & (rated >= max_iter)).sum())
        active &= rated < max_iter
        moving = np.flatnonzero(good & active)
        if len(moving):
            share[moving] = 1.0
            step[moving] = _steps(np.stack([curve[q] for q in moving]), grad[moving], coef[moving], l1[moving], l2[moving], free[moving], LOSSES[loss][2])
            trial[moving] = coef[moving] + step[moving]
    return coef, left


def _add_curvature(curve: np.ndarray, members: list[int], shared: dict | None, x: np.ndarray, y: np.ndarray, w: np.ndarray, bend: np.ndarray) -> None:
    """Adds xᵀ diag(w · bend) x of every problem. ``shared`` (flat losses) gathers {kind of row: (weight by problem, xᵀ x)} of the rows
    that bend in all problems that they belong to; only the others are multiplied problem by problem."""
    each = w * bend
    on = each > 0
    alone = np.ones(len(x), dtype=bool)
    if shared is not None and len(members) > 1:
        out = w == 0
        common = np.flatnonzero((on | out).all(axis=1) & on.any(axis=1))
        kinds = y[common].astype(np.int64) + 2 * (out[common] @ (1 << np.arange(w.shape[1])))
        for kind in np.unique(kinds):
            key = (members[0], int(kind))
            mine = common[kinds == kind]
            if key not in shared and len(shared) >= SHARED_KINDS:
                continue
            z = x[mine]
            gram = z.T @ z
            shared[key] = (members, each[mine[0]], shared[key][2] + gram) if key in shared else (members, each[mine[0]].copy(), gram)
            alone[mine] = False
    for i, q in enumerate(members):
        bent = np.flatnonzero(on[:, i] & alone)  # a hinge bends at few rows once its corner is narrow
        z = (x if len(bent) == len(x) else x[bent]) * np.sqrt(each[bent, i])[:, None]
        curve[q] += z.T @ z


def _scan(rows: DataFrame, problems, weights, coef: np.ndarray, loss: str, stage: float, feature_map, move: np.ndarray | None = None):
    """(problem, loss, gradient, curvature) sums over all rows: one row a task and problem, added up by problem. With ``move``, the way
    to ``coef`` from where the step began, the loss is followed by those after a half of it, a quarter and so on."""
    f = LOSSES[loss][0]
    d = coef.shape[1]
    masks: dict = {}
    for q, p in enumerate(problems):
        masks.setdefault((p.fold, tuple(weights[q])), []).append(q)
    parts = [(members, [mask]) for mask, members in masks.items()]  # problems with the mask of all or of each
    if 1 < len(masks) <= len(problems) <= SIDE_BY_SIDE:
        parts = [(list(range(len(problems))), [(p.fold, weights[q]) for q, p in enumerate(problems)])]
    back = 1 - 0.5 ** np.arange(1, FLAT[loss][1] + 1) if move is not None else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, grad, curve = np.zeros((len(problems), 1 + len(back))), np.zeros((len(problems), d)), np.zeros((len(problems), d, d))
        shared: dict | None = {} if loss in FLAT else None
        for x, y, folds in _batches(batches, feature_map):
            for members, masked in parts:
                w = np.column_stack([_row_weights(folds, y, fold, np.array(by_class)) for fold, by_class in masked])
                used = (w > 0).any(axis=1)
                xs, ys, ws = (x, y, w) if used.all() else (x[used], y[used], w[used])
                to = xs @ np.concatenate([coef[members], move[members]]).T if len(back) else xs @ coef[members].T
                margin = to[:, :len(members)]
                losses, slope, bend = f(margin, ys[:, None], stage)
                value[members, 0] += (ws * losses).sum(axis=0)
                grad[members] += (slope * ws).T @ xs
                _add_curvature(curve, members, shared, xs, ys, ws, bend)
                for k, part in enumerate(back):
                    value[members, 1 + k] += (ws * FLAT[loss][0](margin - part * to[:, len(members):], ys[:, None], stage)).sum(axis=0)
        for members, each, gram in (shared or {}).values():
            for i, q in enumerate(members):
                if each[i] > 0:
                    curve[q] += each[i] * gram
        sums = np.column_stack([value, grad, curve.reshape(len(problems), -1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(problems))), pa.array([r.tobytes() for r in sums], pa.binary())], ["q", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for q, raw in zip(batch.column("q").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                part = np.frombuffer(raw)
                total[q] = total[q] + part if q in total else part.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["q", "sums"])

    schema = "q long, sums binary"
    for r in rows.mapInArrow(run, schema).repartition("q").mapInArrow(add, schema).collect():
        value, grad, curve = np.split(np.frombuffer(r["sums"]), [1 + len(back), 1 + len(back) + d])
        yield r["q"], value if move is not None else value[0], grad, curve.reshape(d, d)


def _steps(curve: np.ndarray, grad: np.ndarray, coef: np.ndarray, l1: np.ndarray, l2: np.ndarray, free: np.ndarray, floor: float = 0.0,
           sweeps: int = 500) -> np.ndarray:
    """The minimisers of each problem's quadratic model with its penalty, as steps from ``coef``; what is not ``free`` stays."""
    q, d = coef.shape
    ridge = np.concatenate([np.repeat(l2[:, None], d - 1, axis=1), np.zeros((q, 1))], axis=1)
    h = curve + np.eye(d) * (ridge + 1e-10 * (1 + curve.diagonal(axis1=1, axis2=2)))[:, None, :]
    h[:, -1, -1] = np.maximum(h[:, -1, -1], floor)
    g = np.where(free, grad + ridge * coef, 0.0)
    h = np.where(free[:, :, None] & free[:, None, :], h, np.eye(d))
    step = np.zeros_like(coef)
    smooth = l1 == 0
    if smooth.any():
        step[smooth] = -np.linalg.solve(h[smooth], g[smooth][:, :, None])[:, :, 0]
    if (~smooth).any():  # coordinate descent, all problems side by side
        hs, gs, b, pen = h[~smooth], g[~smooth].copy(), coef[~smooth], l1[~smooth]
        s = np.zeros_like(b)
        for _ in range(sweeps):
            moved = 0.0
            for j in range(d):
                diagonal = hs[:, j, j]
                free = b[:, j] + s[:, j] - gs[:, j] / diagonal
                to = np.sign(free) * np.maximum(np.abs(free) - pen / diagonal, 0) if j < d - 1 else free
                change = to - b[:, j] - s[:, j]
                s[:, j] += change
                gs += hs[:, :, j] * change[:, None]
                moved = max(moved, float(np.abs(change * np.sqrt(diagonal)).max()))
            if moved < 1e-10:
                break
        step[~smooth] = s
    return step


def held_out_margins(rows: DataFrame, problems: list[Problem], coef: np.ndarray, feature_map=None) -> DataFrame:
    """(run, y_true, score): each problem's margin on the rows of its held-out fold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, folds in _batches(batches, feature_map):
            for q, p in enumerate(problems):
                mine = folds[:, p.fold[0]] == p.fold[1]
                margin = x[mine] @ coef[q]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(margin), q)), pa.array(y[mine].astype(np.int32)), pa.array(margin)], ["run", "y_true", "score"])

    return rows.mapInArrow(run, "run long, y_true int, score double")


class LinearScore:
    """A fitted linear classifier: margin = intercept + coefficients · x, prob1 its sigmoid."""

    def __init__(self, coefficients: np.ndarray, intercept: float, features: str = "features"):
        self.coefficients, self.intercept, self.features = DenseVector(coefficients), float(intercept), features

    def transform(self, df: DataFrame) -> DataFrame:
        terms = F.zip_with(vector_to_array(self.features), F.array(*[F.lit(float(c)) for c in self.coefficients]), lambda a, b: a * b)
        out = df.withColumn("margin", F.aggregate(terms, F.lit(self.intercept), lambda s, v: s + v))
        return out.withColumn("prob1", sigmoid("margin"))
