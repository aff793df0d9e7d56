"""Selection and evaluation on hand-made frames with hand-computed answers."""

import pytest
from pyspark.sql import functions as F

from tabsift.operators import evaluate as ev
from tabsift.operators import select as sel
from tabsift.operators import summarise as rs

RUN = ["run"]


def test_correlation_filter_not_greedy(spark):
    # chain a–b–c: a–b and b–c above the threshold, a–c below; importance a > b > c.
    # b goes because of a; c goes because of b although b itself is dropped (a greedy rule would keep c).
    pairs = spark.createDataFrame([("a", "b", 0.97), ("b", "c", 0.97), ("a", "c", 0.5)], "a string, b string, r double")
    imp = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "rank int, feature string")
    dropped = {r.feature for r in sel.correlation_drops(pairs, imp, 0.95).collect()}
    assert dropped == {"b", "c"}


def test_correlation_filter_keeps_best_of_twins(spark, sf):
    from tabsift.sources.fixtures import W1_FEATURES, doc_features
    kept, ranking = sel.correlation_filter(doc_features(spark, sf), W1_FEATURES)
    assert ("n_chars" in kept) != ("n_chars_twin" in kept)


def test_feature_points_ranks(spark):
    sel_df = spark.createDataFrame([(0, 0, "j", 1, "f1"), (0, 0, "j", 10, "f10"), (0, 0, "j", 11, "f11"),
                                    (0, 0, "j", 12, "f12"), (1, 0, "j", 1, "f1")],
                                   "seed int, boot int, job string, rank int, feature string")
    pts = {r.feature: r.points for r in sel.feature_points(sel_df).collect()}
    assert pts == {"f1": 20, "f10": 1, "f11": 1, "f12": 1}


ROC8 = [(0.9, 1), (0.8, 1), (0.8, 0), (0.6, 1), (0.5, 0), (0.5, 1), (0.3, 0), (0.1, 0)]


def _roc8(spark):
    return spark.createDataFrame([("r", i, y, s) for i, (s, y) in enumerate(ROC8)], "run string, id long, y_true int, score double")


def test_auc_by_hand(spark):
    # pairs (pos, neg): 16; wins: 0.9 beats 4, 0.8(pos) beats 3 + tie 0.5, 0.6 beats 3, 0.5(pos) beats 2 + tie 0.5
    auc = ev.roc_auc(_roc8(spark), RUN).first().roc_auc
    assert auc == pytest.approx((4 + 3.5 + 3 + 2.5) / 16)
    trap = ev.auc_trapz(_roc8(spark), RUN, auto_flip=False).first().auc
    assert trap == pytest.approx(auc)


def test_youden_and_corner_by_hand(spark):
    y = ev.youden_threshold(_roc8(spark), RUN).first()
    # thresholds: 0.9 (1/4,0), 0.8 (2/4,1/4), 0.6 (3/4,1/4) → J = 0.5 first max at 0.6
    assert y.youden_thr == 0.6 and y.youden_objective == pytest.approx(0.5)
    c = ev.corner_threshold(_roc8(spark), RUN).first()
    assert c.corner_thr == 0.6


def test_roc_drops_collinear_points(spark):
    rows = [("r", i, 1 if i < 3 else 0, float(10 - i)) for i in range(6)]
    df = spark.createDataFrame(rows, "run string, id long, y_true int, score double")
    pts = sorted((r.thr, r.fps, r.tps) for r in ev.roc_points(df, RUN).collect())
    # scores 10,9,8 positive, 7,6,5 negative: the curve is (0,1)(0,2)(0,3)(1,3)(2,3)(3,3) in counts;
    # 9, 7 and 6 lie on straight segments, so the start, 10, 8 (the corner) and 5 remain
    assert [p[0] for p in pts] == [5.0, 8.0, 10.0, 11.0]


def test_single_class_auc_is_null(spark):
    df = spark.createDataFrame([("r", 1, 1, 0.3), ("r", 2, 1, 0.4)], "run string, id long, y_true int, score double")
    assert ev.roc_auc(df, RUN).first().roc_auc is None


def test_mann_whitney_ties_normal_and_exact(spark):
    a = [1.0, 2.0, 2.0, 3.0, 4.0, 5.0, 5.0, 6.0, 7.0, 8.0]
    b = [2.0, 3.0, 3.0, 4.0, 6.0, 6.0, 7.0, 9.0, 9.0, 10.0]
    rows = [("g", "a", v) for v in a] + [("g", "b", v) for v in b]
    df = spark.createDataFrame(rows, "grp string, sample string, value double")
    r = rs.mann_whitney(df, ["grp"]).first()
    assert r.n1 == 10 and r.n2 == 10
    # U1 by hand with average ranks
    allv = sorted(a + b)
    rank = {v: (allv.index(v) + 1 + allv.index(v) + allv.count(v)) / 2 for v in set(allv)}
    u1 = sum(rank[v] for v in a) - 10 * 11 / 2
    assert r.u == max(u1, 100 - u1)
    assert 0.0 <= r.p <= 1.0
    # exact branch: 3 vs 3 without ties, full separation → p = 2 / C(6,3) = 0.1
    ex = spark.createDataFrame([("h", "a", 1.0), ("h", "a", 2.0), ("h", "a", 3.0),
                                ("h", "b", 4.0), ("h", "b", 5.0), ("h", "b", 6.0)], "grp string, sample string, value double")
    assert rs.mann_whitney(ex, ["grp"]).first().p == pytest.approx(0.1)


def test_threshold_metrics_zero_division(spark):
    df = spark.createDataFrame([("r", 1, 0, 0.1), ("r", 2, 0, 0.2)], "run string, id long, y_true int, score double")
    m = ev.threshold_metrics(df, RUN, 0.5).first()
    assert m.precision == 0.0 and m.recall == 0.0 and m.specificity == 1.0 and m.accuracy == 1.0
