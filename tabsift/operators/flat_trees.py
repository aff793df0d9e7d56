"""Trees as flat arrays: whole ensembles are walked in one Arrow function, and extremely randomised trees are grown level by level.

A forest is five arrays over all nodes (feature, threshold, left, right, value) and the root of each tree; a batch of rows
walks all trees together, one step a level, so scoring is a single projection whatever the number of trees.

``ExtraTrees`` grows all trees side by side. A level takes two scans: the range of every feature in every open node, then the
class (or value) sums left of each drawn cut. Cuts are drawn where a node's sums meet, rows never move, and a task sends one row
an open node, in slices that bound its memory. Rows keep the open nodes where they stand, so a scan walks the latest levels only
and the driver holds 16 bytes a node, with no objects of its own for them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .positions import checkpointed, spread

#: Doubles that a task holds for the open nodes of a scan: more nodes take several scans a level.
SCAN_DOUBLES = 1 << 22
BATCH_ROWS = 4096
#: Nodes of closed levels that are sent to every task: beyond that the rows' places are written anew.
RECENT_NODES = 1 << 18
#: Leaves are deep enough here: a tree over n rows has at most n levels, and this many stop one over endless ties.
DEEPEST = 1000


class FlatForest:
    """``cut`` holds an inner node's threshold and a leaf's value, so a node takes 16 or 20 bytes; without ``right`` the right child
    follows the left one."""

    def __init__(self, feature, threshold, left, right, value, roots):
        self.feature, self.left, self.roots = (np.asarray(a, dtype=np.int32) for a in (feature, left, roots))
        self._right = None if right is None else np.asarray(right, dtype=np.int32)
        self.cut = np.where(self.feature >= 0, np.asarray(threshold, dtype=float), np.asarray(value, dtype=float))

    @property
    def right(self) -> np.ndarray:
        return self._right if self._right is not None else np.where(self.feature >= 0, self.left + 1, -1)

    @property
    def threshold(self) -> np.ndarray:
        return np.where(self.feature >= 0, self.cut, 0.0)

    @property
    def value(self) -> np.ndarray:
        return np.where(self.feature >= 0, 0.0, self.cut)

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The node where each row (of a batch) ends in each tree."""
        at, rows = np.tile(self.roots, (len(x), 1)), np.arange(len(x))[:, None]
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            low = x[rows, np.maximum(f, 0)] <= self.cut[at]
            other = self.left[at] + 1 if self._right is None else self._right[at]
            at = np.where(inner, np.where(low, self.left[at], other), at)

    def values(self, x: np.ndarray) -> np.ndarray:
        """Each tree's value for each row, in batches of bounded size."""
        parts = [self.cut[self.nodes(x[i:i + BATCH_ROWS])] for i in range(0, len(x), BATCH_ROWS)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.roots)))


def scored(df: DataFrame, features: str, out: str, function) -> DataFrame:
    """``df`` with the column ``out``: ``function`` of the matrix of a batch's feature vectors, in one projection."""
    @F.pandas_udf("double")
    def score(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in columns:
            yield pd.Series(function(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

    return df.withColumn(out, score(vector_to_array(features)))


_LINE = re.compile(r"^( *)(?:(If|Else) \(feature (\d+) (?:<=|>) ([^)]+)\)|Predict: (\S+))$")


def flat_regression_trees(trees) -> FlatForest:
    """Fitted regression trees of the engine (continuous features) as one forest, read from their own description: one call a tree."""
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for column, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (value, 0.0)):
            column.append(v)
        return len(feature) - 1

    for tree in trees:
        lines = [m for m in map(_LINE.match, tree.toDebugString.splitlines()) if m]
        place = 0

        def read() -> int:
            nonlocal place
            m, at = lines[place], node()
            place += 1
            if m[5] is not None:
                value[at] = float(m[5])
            else:
                feature[at], threshold[at] = int(m[3]), float(m[4])
                left[at] = read()
                place += 1  # the matching Else
                right[at] = read()
            return at

        roots.append(read())
    return FlatForest(feature, threshold, left, right, value, roots)


def weighted_medians(values: np.ndarray, weights) -> np.ndarray:
    """For each row the least value with at least half of the weight at or below it."""
    order = np.argsort(values, axis=1, kind="stable")
    upto = np.cumsum(np.asarray(weights, dtype=float)[order], axis=1)
    at = (upto >= sum(weights) / 2 - 1e-12).argmax(axis=1)
    return values[np.arange(len(values)), order[np.arange(len(values)), at]]


# ---------------------------------------------------------------- extremely randomised trees
def impurity(sums: np.ndarray, criterion: str) -> np.ndarray:
    """Impurity of (…, 3) sums of weight, weight · y and weight · y²; 0 without weight."""
    w = np.maximum(sums[..., 0], 1e-300)
    mean = np.clip(sums[..., 1] / w, 0, 1) if criterion != "variance" else sums[..., 1] / w
    if criterion == "gini":
        return 2 * mean * (1 - mean)
    if criterion == "entropy":
        return -(mean * np.log2(np.maximum(mean, 1e-300)) + (1 - mean) * np.log2(np.maximum(1 - mean, 1e-300)))
    return np.maximum(sums[..., 2] / w - mean * mean, 0)


def subset_size(strategy: str, p: int) -> int:
    """Features tried at a node: all, sqrt, log2, a share (with a dot) or a count."""
    if strategy == "all":
        return p
    if strategy in ("sqrt", "log2"):
        return max(1, int(np.sqrt(p) if strategy == "sqrt" else np.log2(p)))
    n = float(strategy)
    return max(1, min(p, int(n * p) if "." in strategy else int(n)))


def copies(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in a tree's bootstrap: Poisson(1) numbers by a hash of row, tree and seed."""
    with np.errstate(over="ignore"):
        h = (rows.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + tree) & 0xFFFFFFFF) * np.uint64(0xD1B54A32D192ED03)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)
    steps = np.cumsum(np.exp(-1) / np.cumprod([1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]))
    return np.searchsorted(steps, u, side="right").astype(float)


class ExtraTreesModel:
    def __init__(self, forest: FlatForest, importances: np.ndarray, features: str, classify: bool):
        self.forest, self.featureImportances, self.features, self.classify = forest, importances, features, classify

    def transform(self, df: DataFrame) -> DataFrame:
        """Mean over the trees of the class-1 probability (prob1), or of the value (prediction)."""
        forest = self.forest
        return scored(df, self.features, "prob1" if self.classify else "prediction", lambda x: forest.values(x).mean(axis=1))


class ExtraTrees:
    """Every node draws a subset of the features that vary in it and one uniform cut within the range of each, and takes the best.

    ``depth`` None lets trees grow until nodes are pure, constant or single rows.
    """

    def __init__(self, n_trees: int, depth: int | None, subset: str, criterion: str, seed: int, features: str, label: str,
                 weight: str | None, bootstrap: bool = False):
        self.n, self.depth, self.subset, self.criterion, self.seed = n_trees, depth, subset, criterion, seed
        self.features, self.label, self.weight, self.bootstrap = features, label, weight, bootstrap

    def fit(self, df: DataFrame) -> ExtraTreesModel:
        w = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        rows = spread(df.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("double").alias("y"), w.alias("w"),
                                F.monotonically_increasing_id().alias("row")))
        first = rows.first()
        if first is None:
            raise ValueError("no rows to fit")
        grown = _Growth(self, rows, len(first["x"]))
        while len(grown.tree):
            grown.level()
        total = grown.gains.sum(axis=1, keepdims=True)
        shares = np.divide(grown.gains, total, out=np.zeros_like(grown.gains), where=total > 0).mean(axis=0)
        return ExtraTreesModel(grown.forest(), shares / shares.sum() if shares.sum() > 0 else shares, self.features, self.criterion != "variance")


def _matrix(rows: pa.Table, column: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column(column).to_pylist())).reshape(-1, width)


def _left(feature: np.ndarray, following: int) -> np.ndarray:
    """Left children of a level whose children start at ``following``, two an inner node in its order."""
    inner = feature >= 0
    return np.where(inner, following + 2 * (np.cumsum(inner) - 1), -1).astype(np.int32)


class _Growth:
    """All trees while they grow. The nodes of a level have consecutive numbers, by tree; ``tree`` is that of each open node, ``first``
    the number of the first, ``levels`` holds the feature and cut (or value) of the closed ones. Rows know their node in the level
    that starts at ``base`` (-1: done), the levels from there on are ``recent``."""

    def __init__(self, how: ExtraTrees, rows: DataFrame, p: int):
        self.how, self.rows, self.p, self.depth = how, rows, p, 0
        self.tree, self.first, self.base = np.arange(how.n, dtype=np.int32), 0, 0
        self.levels, self.recent, self.placed = [], [], False
        self.gains = np.zeros((how.n, p))

    def forest(self) -> FlatForest:
        left, start = [], 0
        for feature, _ in self.levels:
            start += len(feature)
            left.append(_left(feature, start))
        feature, cut = (np.concatenate(c) for c in zip(*self.levels))
        return FlatForest(feature, cut, np.concatenate(left), None, cut, np.arange(self.how.n))

    def level(self) -> None:
        n, p = len(self.tree), self.p
        k = subset_size(self.how.subset, p)
        feature, cut = np.full(n, -1, dtype=np.int32), np.zeros(n)
        per, few = max(1, SCAN_DOUBLES // (2 * p + 4)), max(1, SCAN_DOUBLES // (3 * k + 1))
        for at in range(0, n, per):
            met = self._scan(np.arange(at, min(at + per, n)), None, k)
            order = np.argsort(q := met.column("q").to_numpy())
            q, row = q[order], _matrix(met, "sums", 4 + 2 * k)[order]
            sums, size, tried, cuts = row[:, :3], row[:, 3].astype(int), row[:, 4:4 + k].astype(int), row[:, 4 + k:]
            cut[q] = np.divide(sums[:, 1], sums[:, 0], out=np.zeros(len(q)), where=sums[:, 0] > 0)
            inner = np.flatnonzero(size)
            for i in range(0, len(inner), few):
                some = inner[i:i + few]
                feature[q[some]], cut[q[some]] = self._best(q[some], sums[some], size[some], tried[some], cuts[some])
        self._close(feature, cut)

    def _best(self, q, whole, size, tried, cuts) -> tuple[np.ndarray, np.ndarray]:
        """Feature and threshold of the best of the cuts that each node has tried."""
        k, criterion = tried.shape[1], self.how.criterion
        met = self._scan(q, (tried, cuts), k)
        lower = np.zeros((len(q), k, 3))
        lower[met.column("q").to_numpy()] = _matrix(met, "sums", 3 * k).reshape(-1, k, 3)
        upper = whole[:, None] - lower
        cost = lower[..., 0] * impurity(lower, criterion) + upper[..., 0] * impurity(upper, criterion)
        cost[np.arange(k) >= size[:, None]] = np.inf
        each, best = np.arange(len(q)), cost.argmin(axis=1)
        gain = np.maximum(whole[:, 0] * impurity(whole, criterion) - cost[each, best], 0.0)
        np.add.at(self.gains, (self.tree[q], tried[each, best]), gain)
        return tried[each, best], cuts[each, best]

    def _close(self, feature: np.ndarray, cut: np.ndarray) -> None:
        """The next level is open; rows are told their places once the latest levels hold many nodes."""
        self.levels.append((feature, cut))
        self.first += len(feature)
        self.recent.append((feature, cut, _left(feature, self.first - self.base)))
        self.tree, self.depth = np.repeat(self.tree[feature >= 0], 2), self.depth + 1
        if self.first - self.base <= RECENT_NODES or not len(self.tree):
            return
        ends, done = self._ends(0, self.how.n), self.first - self.base

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, x in _parts(batches):
                at = np.maximum(ends(part, x) - done, -1)
                at = pa.ListArray.from_arrays(np.arange(0, at.size + 1, at.shape[1], dtype=np.int32), pa.array(at.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("x", "y", "w", "row")), at], ["x", "y", "w", "row", "at"])

        self.rows = checkpointed(self.rows.mapInArrow(place, "x array<double>, y double, w double, row long, at array<int>"))
        self.base, self.recent, self.placed = self.first, [], True

    def _ends(self, t0: int, t1: int):
        """A function of a batch: the node of each row in the trees from ``t0`` up to ``t1``, counted from ``base``."""
        n, placed = self.how.n, self.placed
        feature, cut, left = (np.concatenate(c) for c in zip(*self.recent)) if self.recent else (np.zeros(0, dtype=np.int32), np.zeros(0), np.zeros(0, dtype=np.int32))

        def ends(part: pa.RecordBatch, x: np.ndarray) -> np.ndarray:
            if placed:
                at = part.column("at").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)[:, t0:t1].astype(np.int64)
            else:
                at = np.tile(np.arange(t0, t1), (len(x), 1))
            i, t = np.nonzero((at >= 0) & (at < len(feature)))
            while len(i):
                v = at[i, t]
                f = feature[v]
                go = f >= 0
                i, t, v, f = i[go], t[go], v[go], f[go]
                at[i, t] = to = left[v] + ~(x[i, f] <= cut[v])
                more = to < len(feature)
                i, t = i[more], t[more]
            return at

        return ends

    def _scan(self, q: np.ndarray, cuts: tuple | None, k: int) -> pa.Table:
        """(q, sums) for the open nodes ``q``, counted from the first. Without ``cuts``, by place in the level: sums, number of features
        tried, those and their cuts; else by place in ``q`` the sums left of each cut."""
        how, p, depth, first = self.how, self.p, self.depth, self.first
        trees = np.unique(self.tree[q])
        t0, low_q, size = int(trees[0]), int(q[0]), int(q[-1] - q[0] + 1)
        tree_of, ends, skip = self.tree[low_q:low_q + size], self._ends(t0, int(trees[-1]) + 1), self.first - self.base + low_q
        slot = np.full(size + 1, -1, dtype=np.int64)
        slot[q - low_q] = np.arange(len(q))
        n_held, trees, ranging = len(q), trees.tolist(), cuts is None
        start = np.r_[np.zeros(4), np.full(2 * p, np.inf)] if ranging else np.zeros(3 * k)
        tried, cut = (None, None) if ranging else (cuts[0], np.where(np.isnan(cuts[1]), -np.inf, cuts[1]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.tile(start, (n_held, 1))
            for part, x in _parts(batches):
                y, w, row = (part.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "row"))
                place = ends(part, x) - skip
                place = slot[np.where((place >= 0) & (place < size), place, size)]
                for tree in trees:
                    mine = np.flatnonzero(place[:, tree - t0] >= 0)
                    weight = w[mine]
                    if how.bootstrap:
                        often = copies(row[mine], tree, how.seed)
                        mine, weight = mine[often > 0], (weight * often)[often > 0]
                    if not len(mine):
                        continue
                    order = np.argsort(place[mine, tree - t0], kind="stable")
                    mine, weight = mine[order], weight[order]
                    at = place[mine, tree - t0]
                    begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                    to, wy = at[begin], weight * y[mine]
                    own = np.column_stack([weight, wy, wy * y[mine]])
                    if ranging:
                        held[to, 0] += np.diff(np.r_[begin, len(at)])
                        held[to, 1:4] += np.add.reduceat(own, begin)
                        held[to, 4:4 + p] = np.minimum(held[to, 4:4 + p], np.minimum.reduceat(x[mine], begin))
                        held[to, 4 + p:] = np.minimum(held[to, 4 + p:], -np.maximum.reduceat(x[mine], begin))
                    else:
                        low = x[mine[:, None], tried[at]] <= cut[at]
                        held[to] += np.add.reduceat((low[:, :, None] * own[:, None, :]).reshape(len(at), -1), begin)
            met = np.flatnonzero((held != start).any(axis=1))
            for at in range(0, len(met), BATCH_ROWS):
                some = met[at:at + BATCH_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([held[i].tobytes() for i in some], pa.binary())], ["q", "sums"])

        def drawn(at: int, row: np.ndarray) -> np.ndarray:
            """A node's sums and the cuts that it tries: none for a leaf."""
            sums, low, high = row[1:4], row[4:4 + p], -row[4 + p:]
            out = np.r_[sums, 0.0, np.zeros(k), np.full(k, np.nan)]
            vary = np.flatnonzero(high > low)
            limit = DEEPEST if how.depth is None else how.depth
            if row[0] >= 2 and impurity(sums, how.criterion) > 1e-12 and depth < limit and len(vary):
                r = np.random.default_rng([how.seed & 0xFFFFFFFF, int(tree_of[at]), first + low_q + at])
                some = np.sort(r.permutation(vary)[:k])
                to = low[some] + (high[some] - low[some]) * r.random(len(some))
                out[3], out[4:4 + len(some)] = len(some), some
                out[4 + k:4 + k + len(some)] = np.where(to >= high[some], low[some], to)
            return out

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for at, raw in zip(batch.column("q").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                    part = np.frombuffer(raw)
                    if at not in total:
                        total[at] = part.copy()
                    elif ranging:
                        total[at][:4] += part[:4]
                        total[at][4:] = np.minimum(total[at][4:], part[4:])
                    else:
                        total[at] += part
            sums = [(drawn(at, v) if ranging else v).tobytes() for at, v in total.items()]
            yield pa.RecordBatch.from_arrays([pa.array([at + low_q if ranging else at for at in total], pa.int64()), pa.array(sums, pa.binary())], ["q", "sums"])

        schema = "q long, sums binary"
        return self.rows.mapInArrow(run, schema).repartition("q").mapInArrow(add, schema).toArrow()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of bounded size with the matrix of their feature vectors."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(at, BATCH_ROWS)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
