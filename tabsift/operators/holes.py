"""IMP-4: exact kNN imputation under missing coordinates, over k-d cells.

Distances count the features that both rows have, so a row's holes matter as much as its values. Donors (equal ones merged) go
to the cells of one k-d tree over their values and, first of all, their holes: cells of common patterns hold one pattern. A cell
keeps the range of each feature over the donors that have it, and how many have it. For a query and a cell this
gives a lower bound of the distance to any donor there: gaps on the axes that the query and all donors share, scaled by the most
axes that any could share. A query first meets the nearest cells that can fill its holes, which bounds its k-th
distances, then every cell within these bounds and no other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.portable import hash52
from .nearest import CHUNK_QUERIES, LEAF_POINTS, MAX_LEAVES, SAMPLE_POINTS, Tree, _dealt, distinct_points
from .positions import checkpointed

#: Cells that a query visits at least in the first round for each hole, and queries whose bounds are worked out at once.
FIRST_CELLS, QUERY_ROWS = 2, 64


class Cells:
    """Ranges (over present values), present counts and sizes of the cells; lower bounds of a batch of queries to all of them."""

    def __init__(self, low: np.ndarray, high: np.ndarray, present: np.ndarray, size: np.ndarray):
        self.low, self.high, self.present, self.size = low, high, present, size

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """(query, cell): no donor of the cell is nearer. Infinite where no donor can share an axis."""
        have, p = ~np.isnan(q), q.shape[1]
        all_have, some_have = self.present == self.size[:, None], self.present > 0
        total, most = np.zeros((len(q), len(self.size))), np.zeros((len(q), len(self.size)))
        for j in range(p):
            shared = have[:, j][:, None] & all_have[:, j][None, :]
            v = np.where(have[:, j], q[:, j], 0.0)[:, None]
            gap = np.maximum(np.maximum(self.low[:, j][None, :] - v, v - self.high[:, j][None, :]), 0.0)
            total += np.where(shared, gap * gap, 0.0)
            most += have[:, j][:, None] & some_have[:, j][None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(most > 0, np.sqrt(total * (p / most)), np.inf)

    def first(self, q: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
        """(query, cell) mask: for each hole the nearest cells that hold ``k`` donors of it, ``FIRST_CELLS`` at least."""
        out = np.zeros(bounds.shape, dtype=bool)
        for i in range(len(q)):
            order = np.argsort(bounds[i], kind="stable")
            order = order[np.isfinite(bounds[i, order])]
            for j in np.flatnonzero(np.isnan(q[i])):
                able = order[self.present[order, j] > 0]
                n = max(FIRST_CELLS, int(np.searchsorted(np.cumsum(self.present[able, j]), k)) + 1)
                out[i, able[:n]] = True
        return out


def _extended(x: np.ndarray, fill: np.ndarray, far: float) -> np.ndarray:
    hole = np.isnan(x)
    return np.column_stack([np.where(hole, fill, x), hole * far])


def _in_cell(feats: list[str], k: int, schema: T.StructType):
    """The ``k`` nearest donors in a cell for every hole of every query there."""
    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("least")
            b, ids = right[feats].to_numpy(dtype=float), right["ids"].to_numpy()
            here = ~np.isnan(b)
            b0 = np.where(here, b, 0.0)
            a = left[feats].to_numpy(dtype=float)
            step = max(1, (1 << 20) // len(b))
            for at in range(0, len(a), step):
                q = a[at:at + step]
                have = ~np.isnan(q)
                q0 = np.where(have, q, 0.0)
                total, shared = np.zeros((len(q), len(b))), np.zeros((len(q), len(b)))
                for j in range(len(feats)):
                    both = have[:, j][:, None] & here[:, j][None, :]
                    d = q0[:, j][:, None] - b0[:, j][None, :]
                    total += np.where(both, d * d, 0.0)
                    shared += both
                with np.errstate(divide="ignore", invalid="ignore"):
                    dist = np.where(shared > 0, np.sqrt(total * (len(feats) / shared)), np.inf)
                for i in range(len(q)):
                    for j in np.flatnonzero(~have[i]):
                        ok = np.flatnonzero(here[:, j] & np.isfinite(dist[i]))
                        if len(ok) > k:  # all at the k-th distance stay, so that ties are settled by key
                            ok = ok[dist[i, ok] <= np.partition(dist[i, ok], k - 1)[k - 1]]
                        near = sorted((float(dist[i, r]), donor, float(b[r, j])) for r in ok for donor in ids[r])[:k]
                        out += [(left["qid"].iat[at + i], feats[j], d, donor, v) for d, donor, v in near]
        return pd.DataFrame(out, columns=[f.name for f in schema.fields])

    return search


def nearest_donors(holes: DataFrame, train: DataFrame, feats: list[str], k: int, key: str, leaf: int = LEAF_POINTS,
                   chunk_queries: int = CHUNK_QUERIES) -> tuple[DataFrame, DataFrame]:
    """(qid, feature, dist, donor, value) of the ``k`` nearest donors of every hole, and the (qid, leaf) visits that found them."""
    points = checkpointed(distinct_points(train, feats, key, k, missing=True))
    n = points.count()
    ids = train.schema[key].dataType
    schema = T.StructType([T.StructField("qid", ids), T.StructField("feature", T.StringType()), T.StructField("dist", T.DoubleType()),
                           T.StructField("donor", ids), T.StructField("value", T.DoubleType())])
    visit = T.StructType([T.StructField("qid", ids), *(T.StructField(f, T.DoubleType()) for f in feats), T.StructField("leaf", T.LongType())])
    if not n:
        spark = holes.sparkSession
        return spark.createDataFrame([], schema), spark.createDataFrame([], visit)
    share = min(1.0, SAMPLE_POINTS / n)
    h = hash52(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in feats])
    sample = points.where(h < F.lit(int(share * (1 << 52)))).select(*feats).toPandas().to_numpy(dtype=float).reshape(-1, len(feats))  # bounded
    known = ~np.isnan(sample).all(axis=0) if len(sample) else np.zeros(len(feats), dtype=bool)
    fill = np.array([np.nanmedian(sample[:, j]) if known[j] else 0.0 for j in range(len(feats))])
    spread = max((float(np.nanmax(sample[:, j]) - np.nanmin(sample[:, j])) for j in range(len(feats)) if known[j]), default=0.0)
    far = 2 * spread + 1.0
    tree = Tree.build(_extended(sample, fill, far) if len(sample) else np.zeros((1, 2 * len(feats))), int(max(1.0, leaf * share, len(sample) / MAX_LEAVES)))

    def place(batches):
        for pdf in batches:
            pdf["leaf"] = tree.leaf_of(_extended(pdf[feats].to_numpy(dtype=float), fill, far))
            yield pdf

    points = points.select(*feats, "ids", "least", "n")
    placed = checkpointed(points.mapInPandas(place, T.StructType([*points.schema.fields, T.StructField("leaf", T.LongType())])))
    p = len(feats)
    low, high = np.full((tree.n_leaves, p), np.inf), np.full((tree.n_leaves, p), -np.inf)
    present, size = np.zeros((tree.n_leaves, p)), np.zeros(tree.n_leaves)
    for r in placed.groupBy("leaf").agg(F.sum("n"), *[F.min(f) for f in feats], *[F.max(f) for f in feats],
                                        *[F.sum(F.when(F.col(f).isNotNull(), F.col("n")).otherwise(0)) for f in feats]).collect():  # MAX_LEAVES rows at most
        size[r[0]] = r[1]
        low[r[0]] = [np.inf if v is None else v for v in r[2:2 + p]]
        high[r[0]] = [-np.inf if v is None else v for v in r[2 + p:2 + 2 * p]]
        present[r[0]] = r[2 + 2 * p:]
    cells = Cells(low, high, present, size)
    placed = placed.select(*feats, "ids", "least", "leaf")
    asked = checkpointed(holes.select(F.col(key).alias("qid"), *feats))

    def sender(again: bool):
        def send(batches):
            for pdf in batches:
                for at in range(0, len(pdf), QUERY_ROWS):
                    part = pdf.iloc[at:at + QUERY_ROWS]
                    q = part[feats].to_numpy(dtype=float)
                    bounds = cells.bounds(q)
                    to = cells.first(q, bounds, k)
                    if again:
                        reach = np.stack([np.asarray(row, dtype=float) for row in part["reach"]])
                        reach = np.where(np.isnan(reach), np.inf, reach)  # fewer than k donors so far
                        within = np.zeros(to.shape, dtype=bool)
                        for j in range(p):
                            within |= np.isnan(q[:, j])[:, None] & (cells.present[:, j] > 0)[None, :] & (bounds <= reach[:, j][:, None] * (1 + 1e-9))
                        to = within & ~to & np.isfinite(bounds)
                    i, leaves = np.nonzero(to)
                    rows = part.iloc[i][["qid", *feats]].copy()
                    rows["leaf"] = leaves
                    if len(rows):
                        yield rows
        return send

    def met(visits: DataFrame) -> DataFrame:
        queries, donors = _dealt(visits, placed, chunk_queries)
        return queries.groupBy("leaf", "chunk").cogroup(donors.groupBy("leaf", "chunk")).applyInPandas(_in_cell(feats, k, schema), schema)

    first = checkpointed(asked.mapInPandas(sender(False), visit))
    found = checkpointed(met(first))
    kth = (found.groupBy("qid", "feature").agg(F.slice(F.array_sort(F.collect_list("dist")), 1, k).alias("d"))  # k a visited cell
           .groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.when(F.size("d") >= k, F.element_at("d", k)).alias("r")))).alias("m")))
    reach = asked.join(kth, "qid", "left").withColumn("reach", F.array(*[F.try_element_at("m", F.lit(f)) for f in feats])).drop("m")
    second = checkpointed(reach.mapInPandas(sender(True), visit))
    w = Window.partitionBy("qid", "feature").orderBy("dist", "donor")  # k rows a visited cell
    best = found.unionByName(met(second)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
    return best, first.select("qid", "leaf").unionByName(second.select("qid", "leaf"))


def knn_impute(df: DataFrame, features, part_col: str = "part", k: int = 5, key: str = "id", leaf: int = LEAF_POINTS) -> DataFrame:
    """IMP-4: a missing cell becomes the mean of its feature over the ``k`` nearest train rows that have it.

    Distance is Euclidean over the features that both rows have, scaled up by (all / shared); rows that share none are
    no donors. Ties go to the lesser key. A cell without donors takes the feature's train mean, a feature
    without any value 0.
    """
    feats = list(features)
    of_train = F.col(part_col) == "train" if part_col in df.columns else F.lit(True)
    x = checkpointed(df.select(key, *[F.col(f).cast("double").alias(f) for f in feats], of_train.alias("_t")))
    train = x.where("_t").drop("_t")
    holes = x.where(" OR ".join(f"`{f}` IS NULL" for f in feats)).drop("_t")
    found, _ = nearest_donors(holes, train, feats, k, key, leaf)
    fills = found.groupBy("qid").pivot("feature", feats).agg(F.avg("value"))
    fills = fills.select(F.col("qid").alias("_key"), *[F.col(f).alias(f"_fill_{f}") for f in feats])
    mean = train.agg(*[F.avg(f).alias(f) for f in feats]).first()
    joined = df.join(fills, F.col(key) == F.col("_key"), "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_fill_{c}"), F.lit(mean[c] if mean[c] is not None else 0.0)).alias(c)
                           if c in set(feats) else F.col(c) for c in df.columns])
