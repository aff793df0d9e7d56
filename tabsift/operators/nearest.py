"""Exact k nearest neighbours over k-d cells.

Equal rows are one point with its row count and least keys. A bounded sample of the
points gives a k-d tree, cut on medians along the widest axis; it only decides where
work is done, never the result. Every point goes to its cell in one pass, and each cell
is searched in vectorised numpy:

1. a query meets the points of its own cell, which bounds its k-th distance;
2. a few cells whose boxes are nearest tighten the bound;
3. then it is sent to the other cells whose box lies within the bound, and to no other;
4. each cell sends back at most k + 1 points per query, and the best of all are kept.

Queries of one cell are dealt out in chunks, so a cell that many queries visit is many
tasks. In high intrinsic dimension boxes exclude little, and the comparisons approach those
of everything with everything; the answer is exact all the same. What is shuffled does not
follow: where queries visit many cells, cells go by regions, a query is sent to a region
once, with a bit for each cell there that it visits, and a region's points meet a bounded
number of chunks of queries. So a query is sent ``REGIONS`` times at most as long as the
points of a region fit ``REGION_DOUBLES``; beyond that there are more regions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.portable import hash52
from .positions import checkpointed

#: Points of a cell (about), points the tree is built on, and cells it has at most (their boxes go to every task).
LEAF_POINTS, SAMPLE_POINTS, MAX_LEAVES = 256, 200_000, 1 << 15
#: Cells visited to tighten the bound, and queries of a batch that are sent out at once.
PROBES, SEND_ROWS = 16, 512
#: Queries of one cell that a task takes.
CHUNK_QUERIES = 20_000
#: Cells that a query visits, on average, before cells go by regions, and the number of those; the chunks of queries that a region meets;
#: doubles of a region's points, and of a chunk's queries, from which there are more regions and chunks.
REGIONS, REGION_CHUNKS, REGION_DOUBLES = 8, 16, 1 << 23
#: Columns from which a matrix product sieves the points of a cell.
PRODUCT_COLUMNS = 8
#: A point is hot from this part of the rows on.
HOT_SHARE = 1000


@dataclass
class Tree:
    """Inner nodes: axis, threshold, children (negative: ~leaf). Boxes of the leaves and nodes hold the real points."""

    axis: list[int]
    cut: list[float]
    left: list[int]
    right: list[int]
    n_leaves: int
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    root: int = -1
    flat: np.ndarray | None = None  # of categorical axes: the square that any mismatch adds (0: a numeric axis)

    @classmethod
    def build(cls, sample: np.ndarray, leaf: int) -> Tree:
        tree = cls([], [], [], [], 0)

        def grow(index: np.ndarray) -> int:
            spread = np.ptp(sample[index], axis=0) if len(index) else np.zeros(1)
            if len(index) <= leaf or spread.max() <= 0:
                tree.n_leaves += 1
                return ~(tree.n_leaves - 1)
            a = int(spread.argmax())
            x = sample[index, a]
            cut = float(np.median(x))
            if cut >= x.max():
                cut = float(x[x < x.max()].max())
            node = len(tree.axis)
            tree.axis.append(a)
            tree.cut.append(cut)
            tree.left.append(0)
            tree.right.append(0)
            tree.left[node] = grow(index[x <= cut])
            tree.right[node] = grow(index[x > cut])
            return node

        tree.root = grow(np.arange(len(sample)))
        return tree

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int64)
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            node, index = stack.pop()
            if node < 0:
                out[index] = ~node
                continue
            under = x[index, self.axis[node]] <= self.cut[node]
            for child, part in ((self.left[node], index[under]), (self.right[node], index[~under])):
                if len(part):
                    stack.append((child, part))
        return out

    def with_boxes(self, low: np.ndarray, high: np.ndarray) -> Tree:
        """Boxes of the leaves; those of the inner nodes follow (empty leaves: inverted boxes)."""
        n = len(self.axis)
        self.low, self.high = low, high
        self.node_low = np.full((n, low.shape[1]), np.inf)
        self.node_high = np.full((n, low.shape[1]), -np.inf)
        for node in reversed(range(n)):  # children have larger numbers
            for child in (self.left[node], self.right[node]):
                lo, hi = (low[~child], high[~child]) if child < 0 else (self.node_low[child], self.node_high[child])
                self.node_low[node] = np.minimum(self.node_low[node], lo)
                self.node_high[node] = np.maximum(self.node_high[node], hi)
        return self

    def _squares(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The least squared distance of each row to its box."""
        gap = np.maximum(np.maximum(low - x, x - high), 0.0)
        square = gap * gap
        if self.flat is not None:
            square = np.where(self.flat > 0, (gap > 0) * self.flat, square)
        return square.sum(axis=1)

    def near(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) for every leaf whose box lies within a query's reach."""
        q_out, leaf_out, stack = [], [], [(self.root, np.arange(len(x)))]
        while stack:
            node, index = stack.pop()
            lo, hi = (self.low[~node], self.high[~node]) if node < 0 else (self.node_low[node], self.node_high[node])
            if not np.isfinite(lo).all():
                continue
            index = index[np.sqrt(self._squares(lo, hi, x[index])) <= reach[index] * (1 + 1e-9)]
            if not len(index):
                continue
            if node < 0:
                q_out.append(index)
                leaf_out.append(np.full(len(index), ~node))
            else:
                stack += [(self.left[node], index), (self.right[node], index)]
        empty = np.zeros(0, dtype=np.int64)
        return np.concatenate([empty, *q_out]), np.concatenate([empty, *leaf_out])


    def probes(self, x: np.ndarray, reach: np.ndarray, home: np.ndarray, m: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) for the ``m`` cells with the nearest boxes within reach, the query's own left out."""
        i, leaves = self.near(x, reach)
        other = leaves != home[i]
        i, leaves = i[other], leaves[other]
        step = max(1, (1 << 20) // x.shape[1])
        away = [self._squares(self.low[leaves[a:a + step]], self.high[leaves[a:a + step]], x[i[a:a + step]]) for a in range(0, len(i), step)]
        order = np.lexsort((leaves, np.concatenate([np.zeros(0), *away]), i))
        i, leaves = i[order], leaves[order]
        first = np.searchsorted(i, i)
        keep = np.arange(len(i)) - first < m
        return i[keep], leaves[keep]


def distances(a: np.ndarray, b: np.ndarray, flat: np.ndarray | None = None) -> np.ndarray:
    """Euclidean distances, squares added in column order; where ``flat`` is positive a mismatch adds just that."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = a[:, j][:, None] - b[:, j][None, :]
        total += d * d if flat is None or not flat[j] else (d != 0) * flat[j]
    return np.sqrt(total)


def distinct_points(df: DataFrame, feats: list[str], key: str, keep: int, missing: bool = False) -> DataFrame:
    """(features…, least, ids, n): equal rows once, with their least key, their ``keep`` least keys and their number.

    Rows with a missing feature are refused unless ``missing`` says that they are points too (equal where the same are missing).
    """
    ids = T.ArrayType(df.schema[key].dataType)
    schema = T.StructType([*(T.StructField(f, T.DoubleType()) for f in feats), T.StructField("ids", ids), T.StructField("n", T.LongType())])

    def local(batches):
        for pdf in batches:
            if len(pdf):
                if not missing and pdf[feats].isna().to_numpy().any():
                    raise ValueError("a row has a missing feature")
                g = pdf.sort_values(key).groupby(feats, sort=False, dropna=False)[key]
                out = pd.DataFrame({"ids": g.apply(lambda v: v.head(keep).tolist()), "n": g.size()}).reset_index()
                yield out[[*feats, "ids", "n"]]

    x = df.select(F.col(key), *[(F.col(f).cast("double") + F.lit(0.0)).alias(f) for f in feats])
    least = lambda: F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids")
    salt = F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(256))
    first = x.mapInPandas(local, schema).groupBy(*feats, salt.alias("_s")).agg(least(), F.sum("n").alias("n"))  # no point in one task
    return first.groupBy(*feats).agg(least(), F.sum("n").alias("n")).withColumn("least", F.col("ids")[0])


def _nearest(q: np.ndarray, reach: np.ndarray, b: np.ndarray, k: int, flat: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, distance) of the ``k`` nearest points within reach of each query, ties to the earlier point.

    With many columns a matrix product, whose error is bounded, first leaves out the points that cannot be among them."""
    m, n = min(k, len(b)), len(b)
    d = None
    if flat is None and q.shape[1] >= PRODUCT_COLUMNS and m < n:
        centre = b.mean(axis=0)
        x, y = q - centre, b - centre
        xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
        d = xx[:, None] + yy[None, :] - 2 * (x @ y.T)
        if np.isfinite(d).all():
            slack = 1e-12 * q.shape[1] * (xx + yy.max() + (centre * centre).sum())
            far = np.minimum(np.partition(d, m - 1, axis=1)[:, m - 1] + 2 * slack, reach * reach * (1 + 1e-9) + slack)
            i, j = np.nonzero(d <= far[:, None])
            at = np.zeros(len(i))
            for c in range(q.shape[1]):  # squares added in column order, as in distances()
                gap = q[i, c] - b[j, c]
                at += gap * gap
            at = np.sqrt(at)
        else:
            d = None
    if d is None:
        d = distances(q, b, flat)
        cut = np.minimum(np.partition(d, m - 1, axis=1)[:, m - 1], reach) if m < n else reach
        i, j = np.nonzero(d <= cut[:, None])
        at = d[i, j]
    order = np.lexsort((j, at, i))
    i, j, at = i[order], j[order], at[order]
    keep = (np.arange(len(i)) - np.searchsorted(i, i) < m) & (at <= reach[i])
    return i[keep], j[keep], at[keep]


def _pairs(queries: DataFrame, points: DataFrame, feats: list[str], k: int, schema: T.StructType, flat: np.ndarray | None = None,
           width: int = 1) -> DataFrame:
    """For each (leaf, chunk) the ``k`` nearest points of the leaf for every query there that lie within its reach.

    With a ``width`` above 1 ``leaf`` is a region of so many cells, and the bits ``cells`` of a query say which of them it visits."""
    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=[f.name for f in schema.fields])
        q, reach, asked = left[feats].to_numpy(dtype=float), left["reach"].to_numpy(dtype=float), left["qid"].to_numpy()
        order = np.argsort(right["least"].to_numpy(), kind="stable")  # ties fall to the lesser key
        right = right.iloc[order]
        points, names, ids = right[feats].to_numpy(dtype=float), right["least"].to_numpy(), right["ids"].to_numpy()
        cell = right["cell"].to_numpy() % width if width > 1 else np.zeros(len(right), dtype=np.int64)
        bits = np.frombuffer(b"".join(left["cells"]), dtype=np.uint8).reshape(len(left), -1) if width > 1 else None
        out = []
        for c in np.unique(cell):
            mine = np.flatnonzero(cell == c)
            visit = np.flatnonzero(bits[:, c >> 3] >> (7 - (c & 7)) & 1) if width > 1 else np.arange(len(q))
            step, b = max(1, (1 << 21) // len(mine)), points[mine]
            for at in range(0, len(visit), step):
                some = visit[at:at + step]
                i, j, d = _nearest(q[some], reach[some], b, k, flat)
                if len(i):
                    out.append(pd.DataFrame({"qid": asked[some[i]], "ids": ids[mine[j]], "least": names[mine[j]], "dist": d}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame([], columns=[f.name for f in schema.fields])

    return queries.groupBy("leaf", "chunk").cogroup(points.groupBy("leaf", "chunk")).applyInPandas(search, schema)


def _dealt(queries: DataFrame, points: DataFrame, chunk_queries: int, load: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Queries of a leaf in chunks, and the leaf's points once per chunk; ``load`` has the chunks (_n) of each leaf, if known."""
    if load is None:
        load = queries.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / chunk_queries).alias("_n"))
    dealt = (queries.join(F.broadcast(load), "leaf")  # one row per leaf, MAX_LEAVES at most
             .withColumn("chunk", F.pmod(F.xxhash64("qid"), F.col("_n"))).drop("_n"))
    copies = points.join(F.broadcast(load), "leaf").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1))).drop("_n")
    return dealt, copies


def nearest_points(queries: DataFrame, points: DataFrame, feats: list[str], k: int, leaf: int = LEAF_POINTS,
                   chunk_queries: int = CHUNK_QUERIES, flat: np.ndarray | None = None) -> DataFrame:
    """(qid, ids, least, dist): the ``k`` nearest of the distinct ``points`` for each query point (qid, features…)."""
    points = checkpointed(points)
    n = points.count()
    qid = queries.schema["qid"].dataType
    schema = T.StructType([T.StructField("qid", qid), T.StructField("ids", points.schema["ids"].dataType),
                           T.StructField("least", points.schema["least"].dataType), T.StructField("dist", T.DoubleType())])
    if not n:
        return queries.sparkSession.createDataFrame([], schema)
    share = min(1.0, SAMPLE_POINTS / n)
    h = hash52(*[F.col(f) for f in feats])
    sample = points.where(h < F.lit(int(share * (1 << 52)))).select(*feats).toPandas().to_numpy(dtype=float).reshape(-1, len(feats))
    per_leaf = max(1.0, leaf * share, len(sample) / MAX_LEAVES)
    tree = Tree.build(sample, int(per_leaf))
    tree.flat = flat

    def place(batches):
        for pdf in batches:
            pdf["leaf"] = tree.leaf_of(pdf[feats].to_numpy(dtype=float))
            yield pdf

    points = points.select(*feats, "ids", "least")
    placed = checkpointed(points.mapInPandas(place, T.StructType([*points.schema.fields, T.StructField("leaf", T.LongType())])))
    low, high = np.full((tree.n_leaves, len(feats)), np.inf), np.full((tree.n_leaves, len(feats)), -np.inf)
    for r in placed.groupBy("leaf").agg(*[F.min(f) for f in feats], *[F.max(f) for f in feats]).collect():  # MAX_LEAVES rows at most
        low[r[0]], high[r[0]] = r[1:1 + len(feats)], r[1 + len(feats):]
    tree = tree.with_boxes(low, high)

    q = queries.select("qid", *feats, F.lit(float("inf")).alias("reach"))
    home = checkpointed(q.mapInPandas(place, T.StructType([*q.schema.fields, T.StructField("leaf", T.LongType())])))
    found = checkpointed(_pairs(*_dealt(home, placed, chunk_queries), feats, k, schema, flat))
    base = home.drop("reach").withColumnRenamed("leaf", "home")

    def bounded(by: DataFrame, name: str, to: DataFrame) -> DataFrame:
        """``to`` with the k-th distance so far (infinite where fewer than k points were met)."""
        best = by.groupBy("qid").agg(F.count(F.lit(1)).alias("_n"), F.slice(F.array_sort(F.collect_list("dist")), 1, k).alias("_d"))  # few cells' k points
        return (to.join(best, "qid", "left").withColumn(name, F.when(F.col("_n") >= k, F.element_at("_d", k)).otherwise(F.lit(float("inf"))))
                .drop("_n", "_d"))

    def visited(part: pd.DataFrame, again: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) of a batch: the cells to probe, or all within the tightened bound less its own and those that were probed."""
        x, own = part[feats].to_numpy(dtype=float), part["home"].to_numpy()
        i, leaves = tree.probes(x, part["reach0"].to_numpy(dtype=float), own)
        if again:
            done = i * tree.n_leaves + leaves
            i, leaves = tree.near(x, part["reach"].to_numpy(dtype=float))
            new = (leaves != own[i]) & ~np.isin(i * tree.n_leaves + leaves, done)
            i, leaves = i[new], leaves[new]
        return i, leaves

    def searched(asked: DataFrame, again: bool) -> DataFrame:
        """What the visits of all queries find; by regions where queries visit many cells."""
        def count(batches):
            per = np.zeros(tree.n_leaves, dtype=np.int64)
            for pdf in batches:
                for at in range(0, len(pdf), SEND_ROWS):
                    per += np.bincount(visited(pdf.iloc[at:at + SEND_ROWS], again)[1], minlength=tree.n_leaves)
            yield pd.DataFrame({"leaf": np.flatnonzero(per), "n": per[per > 0]})

        n_asked = asked.count()
        per = checkpointed(asked.mapInPandas(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")))
        width, p = 1, len(feats)
        if (per.agg(F.sum("n")).first()[0] or 0) > REGIONS * n_asked:
            width = max(1, min(-(-tree.n_leaves // REGIONS), REGION_DOUBLES * tree.n_leaves // (n * p)))
        chunks = F.ceil(F.col("n") / chunk_queries)
        if width > 1:
            most = max(REGION_CHUNKS, -(-n_asked * p // REGION_DOUBLES))
            per = per.groupBy(F.floor(F.col("leaf") / width).alias("leaf")).agg(F.least(F.sum("n"), F.lit(n_asked)).alias("n"))
            chunks = F.least(chunks, F.lit(most).cast("bigint"))
        load = per.select("leaf", chunks.alias("_n"))
        many = T.StructField("cells", T.BinaryType())
        sent = T.StructType([*(base.schema[c] for c in ("qid", *feats)), T.StructField("reach", T.DoubleType()), T.StructField("leaf", T.LongType()), *([many] if width > 1 else [])])

        def send(batches):
            for pdf in batches:
                for at in range(0, len(pdf), SEND_ROWS):
                    part = pdf.iloc[at:at + SEND_ROWS]
                    i, leaves = visited(part, again)
                    place, which = np.unique(i * tree.n_leaves + leaves // width, return_inverse=True)
                    rows = part.iloc[place // tree.n_leaves][["qid", *feats]].copy()
                    rows["reach"] = part["reach" if again else "reach0"].to_numpy()[place // tree.n_leaves]
                    rows["leaf"] = place % tree.n_leaves
                    if width > 1:
                        bits = np.zeros((len(place), width), dtype=bool)
                        bits[which, leaves % width] = True
                        rows["cells"] = [r.tobytes() for r in np.packbits(bits, axis=1)]
                    if len(rows):
                        yield rows

        to = placed.withColumn("cell", F.col("leaf")).withColumn("leaf", F.floor(F.col("leaf") / width)) if width > 1 else placed
        return _pairs(*_dealt(asked.mapInPandas(send, sent), to, chunk_queries, load), feats, k, schema, flat, width)

    asked = checkpointed(bounded(found, "reach0", base))
    found = found.unionByName(checkpointed(searched(asked, False)))
    asked = checkpointed(bounded(found, "reach", asked))
    more = searched(asked, True)
    w = Window.partitionBy("qid").orderBy("dist", "least")  # at most k rows for each cell a query visits
    return found.unionByName(more).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def knn(queries: DataFrame, refs: DataFrame, features, k: int, key: str = "id", leaf: int = LEAF_POINTS,
        exclude_self: bool = True, seed: int = 0, mismatch: dict[str, float] | None = None) -> DataFrame:
    """(qid, rid, dist, rank) for the k nearest reference rows of every query row (rank 1 = nearest,
    ties by reference key). Rows must have no missing feature; a query need not be a reference row.

    ``mismatch`` names categorical features (numbers) and what a difference adds to the distance, squared. Rows meet the list of
    their point by value; points that hold over 1 / ``HOT_SHARE`` of the rows are under ``HOT_SHARE`` and are broadcast."""
    feats = list(features)
    keep = k + 1
    points = distinct_points(refs, feats, key, keep)
    asked = distinct_points(queries, feats, key, 1).select(F.col("least").alias("qid"), *feats, "n")
    flat = np.array([(mismatch or {}).get(f, 0.0) ** 2 for f in feats]) if mismatch else None
    asked = checkpointed(asked)
    found = nearest_points(asked.drop("n"), points, feats, keep, leaf, flat=flat)
    near = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("dist", "least", "ids"))).alias("_near"))  # k + 1 points
    # back to rows: every query row reads the list of its point
    at = [(F.col(f).cast("double") + F.lit(0.0)).alias(f) for f in feats]
    point_of = checkpointed(asked.join(near, "qid").select(*feats, "_near", "n"))
    hot = F.col("n") * HOT_SHARE > (asked.agg(F.sum("n")).first()[0] or 0)
    rows = queries.select(F.col(key).alias("qid"), *at)
    few = F.broadcast(point_of.where(hot).drop("n"))
    rows = rows.join(few, feats).unionByName(rows.join(few.select(*feats), feats, "left_anti").join(point_of.where(~hot).drop("n"), feats))
    each = F.flatten(F.transform("_near", lambda p: F.transform(p["ids"], lambda i: F.struct(p["dist"].alias("dist"), i.alias("rid")))))
    if exclude_self:
        each = F.filter(each, lambda e: e["rid"] != F.col("qid"))
    ranked = F.slice(F.array_sort(each), 1, k)
    return (rows.select("qid", F.posexplode(ranked).alias("_p", "_e"))
            .select("qid", F.col("_e.rid").alias("rid"), F.col("_e.dist").alias("dist"), (F.col("_p") + 1).cast("bigint").alias("rank")))
