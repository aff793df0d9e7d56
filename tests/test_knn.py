"""The cell kNN equals brute force, also with duplicate rows and small cells."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tabsift.operators import holes, nearest
from tabsift.operators.impute import impute
from tabsift.operators.nearest import knn
from tabsift.operators.neighbours import oversample, smote


@pytest.mark.parametrize("dim,window", [(2, 8), (5, 16)])
def test_knn_matches_brute_force(spark, dim, window):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(150, dim)).round(1)
    x[100:110] = x[0]  # duplicate points
    feats = [f"f{j}" for j in range(dim)]
    rows = [(int(i), *map(float, x[i])) for i in range(len(x))]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{f} double" for f in feats))
    k = 4
    got = {}
    for r in knn(df, df, feats, k, leaf=window).collect():
        got.setdefault(r.qid, []).append((r.rank, r.rid, r.dist))
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = sorted((float(d[j]), j) for j in range(len(x)) if j != i)[:k]
        mine = sorted(got[i])
        assert [rid for _, rid, _ in mine] == [j for _, j in order], i
        assert [dist for _, _, dist in mine] == pytest.approx([dd for dd, _ in order])


def brute(x, q, k, ids, own=None):
    d = np.sqrt(((x - q) ** 2).sum(axis=1))
    return sorted((float(v), int(i)) for v, i in zip(d, ids) if i != own)[:k]


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, *map(float, r)) for i, r in enumerate(x)], ["id", *[f"f{j}" for j in range(x.shape[1])]])


def test_queries_that_are_no_references(spark):
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(300, 3)), rng.normal(size=(40, 3)) * 3
    feats = [f"f{j}" for j in range(3)]
    got = {}
    for r in knn(frame(spark, q, 10_000), frame(spark, x), feats, 5, leaf=20).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["dist"], r["rid"]))
    for i in range(len(q)):
        want = brute(x, q[i], 5, range(300))
        assert [rid for *_, rid in sorted(got[10_000 + i])] == [j for _, j in want]
        assert [d for _, d, _ in sorted(got[10_000 + i])] == pytest.approx([d for d, _ in want])


def test_many_equal_points_and_few_rows(spark):
    x = np.vstack([np.zeros((200, 2)), np.ones((3, 2)), [[5.0, 5.0]]])
    got = {}
    for r in knn(frame(spark, x).repartition(6), frame(spark, x), ["f0", "f1"], 4, leaf=1).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["rid"]))
    for i in (0, 3, 150, 200, 203):
        assert [j for _, j in sorted(got[i])] == [j for _, j in brute(x, x[i], 4, range(len(x)), i)]
    assert knn(frame(spark, x[:2]), frame(spark, x[:2]), ["f0", "f1"], 4).count() == 2  # fewer rows than neighbours


def test_chunks_of_a_visited_cell(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 2))
    points = nearest.distinct_points(frame(spark, x), ["f0", "f1"], "id", 4)
    asked = frame(spark, x).select(F.col("id").alias("qid"), "f0", "f1")
    a = sorted(map(tuple, nearest.nearest_points(asked, points, ["f0", "f1"], 4, leaf=30, chunk_queries=7).select("qid", "least", "dist").collect()))
    b = sorted(map(tuple, nearest.nearest_points(asked, points, ["f0", "f1"], 4, leaf=10_000).select("qid", "least", "dist").collect()))
    assert [(q, r) for q, r, _ in a] == [(q, r) for q, r, _ in b]


def test_candidates_stay_well_below_all_rows():
    """Ten Gaussian features, 20,000 rows: what a query's cells hold is far from everything."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20_000, 10))
    tree = nearest.Tree.build(x, 64)
    leaf = tree.leaf_of(x)
    low = np.array([x[leaf == i].min(axis=0) for i in range(tree.n_leaves)])
    high = np.array([x[leaf == i].max(axis=0) for i in range(tree.n_leaves)])
    tree.with_boxes(low, high)
    size = np.bincount(leaf)
    ask = rng.choice(20_000, 150, replace=False)
    kth = lambda i, cells: np.sort(nearest.distances(x[i:i + 1], x[np.isin(leaf, cells)])[0])[5]
    reach = np.array([kth(i, [leaf[i]]) for i in ask])
    q, leaves = tree.probes(x[ask], reach, leaf[ask])
    assert np.bincount(q).max() <= nearest.PROBES and (leaves != leaf[ask][q]).all()
    reach = np.array([kth(i, [leaf[i], *leaves[q == n]]) for n, i in enumerate(ask)])
    q, leaves = tree.near(x[ask], reach)
    per = np.bincount(q, weights=size[leaves], minlength=len(ask))
    assert per.mean() < 0.35 * len(x), per.mean()
    for n, i in enumerate(ask[:30]):  # nothing nearer than the reach lies in a cell that was left out
        inside = np.isin(leaf, leaves[q == n])
        assert (nearest.distances(x[i:i + 1], x[~inside])[0] > reach[n]).all()


def test_knn_imputation(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(160, 4)).round(2)
    x[rng.random(x.shape) < 0.15] = np.nan
    x[5] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], "train" if i % 4 else "test") for i, r in enumerate(x)]
    feats = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, part string")
    out = {r["id"]: [r[f] for f in feats] for r in impute(df, "knn_impute", feats).collect()}
    blocked = {r["id"]: [r[f] for f in feats] for r in holes.knn_impute(df, feats, leaf=4).collect()}
    train = [i for i in range(160) if i % 4]
    for i in range(160):
        for j in range(4):
            if not np.isnan(x[i, j]):
                want = x[i, j]
            else:
                near = []
                for t in train:
                    both = ~np.isnan(x[i]) & ~np.isnan(x[t])
                    if not np.isnan(x[t, j]) and both.any():
                        near.append((np.sqrt(((x[i, both] - x[t, both]) ** 2).sum() * 4 / both.sum()), t))
                want = np.mean([x[t, j] for _, t in sorted(near)[:5]]) if near else np.nanmean(x[train, j])
            assert out[i][j] == pytest.approx(want) and blocked[i][j] == pytest.approx(want), (i, j)


def test_imputation_visits_few_cells(spark):
    """Holes are filled from a small part of the donors, with the answer of all of them."""
    rng = np.random.default_rng(8)
    n, feats = 6000, [f"f{i}" for i in range(4)]
    x = rng.normal(size=(n, 4))
    x[rng.random(x.shape) < 0.03] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id long, " + ", ".join(f"{f} double" for f in feats)).cache()
    asked = df.where(" OR ".join(f"{f} IS NULL" for f in feats)).where("id % 7 = 0")
    found, visits = holes.nearest_donors(asked, df, feats, 5, "id", leaf=64)
    per = visits.groupBy("qid").count().agg(F.avg("count")).first()[0]
    assert per * 64 < 0.35 * n
    got = {}
    for r in found.collect():
        got.setdefault((r["qid"], r["feature"]), []).append((r["dist"], r["donor"]))
    for (i, f), near in list(got.items())[:60]:
        j = feats.index(f)
        have = ~np.isnan(x[i])
        both = have[None, :] & ~np.isnan(x)
        with np.errstate(invalid="ignore", divide="ignore"):
            dist = np.sqrt(np.where(both, (x - x[i]) ** 2, 0).sum(axis=1) * 4 / both.sum(axis=1))
        want = sorted((d, t) for t, d in enumerate(dist) if not np.isnan(x[t, j]) and both[t].any())[:5]
        assert [t for _, t in sorted(near)] == [t for _, t in want]


def test_bounds_hold():
    """No donor of a cell is nearer than the cell's bound."""
    rng = np.random.default_rng(4)
    x, cell = rng.normal(size=(300, 3)), rng.integers(0, 12, 300)
    x[rng.random(x.shape) < 0.25] = np.nan
    low, high = np.full((12, 3), np.inf), np.full((12, 3), -np.inf)
    for c in range(12):
        for j in range(3):
            v = x[cell == c, j]
            v = v[~np.isnan(v)]
            if len(v):
                low[c, j], high[c, j] = v.min(), v.max()
    present = np.array([(~np.isnan(x[cell == c])).sum(axis=0) for c in range(12)], dtype=float)
    cells = holes.Cells(low, high, present, np.bincount(cell, minlength=12).astype(float))
    q = rng.normal(size=(40, 3))
    q[rng.random(q.shape) < 0.4] = np.nan
    bounds = cells.bounds(q)
    for i in range(40):
        for t in range(300):
            both = ~np.isnan(q[i]) & ~np.isnan(x[t])
            if both.any():
                assert bounds[i, cell[t]] <= np.sqrt(((q[i, both] - x[t, both]) ** 2).sum() * 3 / both.sum()) + 1e-12


def test_rows_with_holes_are_refused(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "id long, a double")
    with pytest.raises(Exception, match="missing feature"):
        nearest.knn(df.where("id = 1"), df, ["a"], 1).count()


def test_oversampling_by_name(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 2))
    df = frame(spark, x).withColumn("target", F.when(F.col("id") % 4 == 0, 1.0).otherwise(0.0)).withColumn("y", F.col("f0") * 10 + F.col("id"))
    assert oversample(df, "SMOTEN", ["f0", "f1"]).count() == 40 and oversample(df, "BorderlineSMOTE", ["f0", "f1"]).count() >= 0
    with pytest.raises(ValueError):
        oversample(df, "smote", ["f0"])  # a name of the other task
    made = oversample(df.drop("target"), "smote", ["f0", "f1"], "regression", "y")
    assert set(made.columns) >= {"f0", "f1", "y", "_bin"}
    with pytest.raises(ValueError, match="at least 6"):
        smote(df.where("id in (0, 1, 2, 3, 5, 6, 7)"), ["f0", "f1"])


@pytest.mark.parametrize("columns, regions, doubles", [(12, 4, 1 << 23), (12, 4, 1500), (3, 1, 1 << 23)])
def test_queries_are_sent_to_regions_of_cells(spark, monkeypatch, columns, regions, doubles):
    """Where boxes exclude little a query is sent once to a region, not to every cell; neighbours and ties are those of brute force."""
    monkeypatch.setattr(nearest, "REGIONS", regions)
    monkeypatch.setattr(nearest, "REGION_DOUBLES", doubles)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, columns)).round(1)
    x[40:60] = x[:20]
    feats, sent, pairs = [f"f{j}" for j in range(columns)], [], nearest._pairs

    def seen(queries, points, *rest):
        sent.append(queries.count())
        return pairs(queries, points, *rest)

    monkeypatch.setattr(nearest, "_pairs", seen)
    got = {}
    for r in knn(frame(spark, x), frame(spark, x), feats, 4, leaf=8).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["rid"]))
    for i in range(300):
        assert [j for _, j in sorted(got[i])] == [j for _, j in brute(x, x[i], 4, range(300), i)]
    if columns == 12 and doubles > 1500:
        assert max(sent) <= regions * 300


def test_product_sieve_is_exact():
    rng = np.random.default_rng(1)
    for scale, shift in ((1.0, 0.0), (1e-3, 1e6), (1e4, 0.0)):
        q, b = (rng.normal(size=(n, 64)).round(2) * scale + shift for n in (40, 90))
        b[10:20], q[:5] = b[:10], b[:5]
        d = nearest.distances(q, b)
        reach = np.where(np.arange(40) % 2, np.inf, np.sort(d, axis=1)[:, 3])
        i, j, at = nearest._nearest(q, reach, b, 6, None)
        for r in range(40):
            want = [c for c in np.argsort(d[r], kind="stable")[:6] if d[r, c] <= reach[r]]
            assert j[i == r].tolist() == want and at[i == r].tolist() == d[r, want].tolist()
