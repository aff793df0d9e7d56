"""Splits, bootstraps, folds, imputation and scaling invariants."""

import pytest
from pyspark.sql import functions as F

from tabsift.operators import impute as imp
from tabsift.operators import scale as sc
from tabsift.operators import split as sp
from tabsift.sources.fixtures import W1_FEATURES, W2_FEATURES, doc_features, order_features


def test_split_disjoint_complete_balanced(spark, sf):
    w1 = doc_features(spark, sf)
    s = sp.stratified_split(w1, 0.3, 42)
    rows = s.collect()
    assert len(rows) == w1.count() and len({r.id for r in rows}) == len(rows)
    n = len(rows)
    n_test = sum(r.part == "test" for r in rows)
    assert n_test == -(-3 * n // 10)  # ceil(0.3 n)
    for cls in (0.0, 1.0):
        nc = sum(r.target == cls for r in rows)
        tc = sum(r.target == cls and r.part == "test" for r in rows)
        assert abs(tc - n_test * nc / n) < 1.0  # largest-remainder share of the test quota


def test_split_same_under_repartition(spark, sf):
    w1 = doc_features(spark, sf)
    a = {r.id: r.part for r in sp.stratified_split(w1, 0.3, 42).collect()}
    b = {r.id: r.part for r in sp.stratified_split(w1.repartition(17), 0.3, 42).collect()}
    assert a == b


def test_bootstrap_size_and_oob(spark, sf):
    w1 = doc_features(spark, sf)
    n = w1.count()
    drawn = sp.stratified_bootstrap(w1, 42, 0, 0.3)
    assert drawn.count() == int(0.7 * n)
    oob = sp.out_of_bag(w1, drawn)
    assert oob.join(drawn, "id").count() == 0
    assert oob.count() + drawn.select("id").distinct().count() == n


def test_folds_partition_rows(spark, sf):
    w1 = doc_features(spark, sf)
    f = sp.repeated_stratified_kfold(w1, 3, 2, 1).collect()
    n = w1.count()
    assert len(f) == 2 * n
    for rep in (0, 1):
        sizes = [sum(1 for r in f if r.repeat == rep and r.fold == k) for k in range(3)]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 2


def test_median_impute_keeps_observed_and_fills_all(spark, sf):
    s = sp.stratified_split(order_features(spark, sf), 0.3, 7)
    out = imp.simple_impute(s, W2_FEATURES)
    assert out.select([F.sum(F.col(c).isNull().cast("int")).alias(c) for c in W2_FEATURES]).first().asDict() == {
        c: 0 for c in W2_FEATURES}
    j = s.alias("a").join(out.alias("b"), "id")
    diff = j.where(F.col("a.acctbal").isNotNull() & (F.col("a.acctbal") != F.col("b.acctbal"))).count()
    assert diff == 0


def test_zscore_fit_on_train(spark, sf):
    s = imp.simple_impute(sp.stratified_split(order_features(spark, sf), 0.3, 7), W2_FEATURES)
    out, scaled = sc.normalise(s, W2_FEATURES, "z_score_norm")
    assert "is_building" not in scaled and "totalprice" in scaled
    tr = out.where("part = 'train'").agg(F.avg("totalprice"), F.stddev_pop("totalprice")).first()
    assert tr[0] == pytest.approx(0, abs=1e-9) and tr[1] == pytest.approx(1, abs=1e-9)
    te = out.where("part = 'test'").agg(F.avg("totalprice")).first()[0]
    assert abs(te) > 1e-6


def test_unknown_imputer_rejected(spark, sf):
    with pytest.raises(ValueError):
        imp.impute(doc_features(spark, sf), "nope", W1_FEATURES)


def test_generate_seeds():
    assert sp.generate_seeds(545, 1) == [545]
    s = sp.generate_seeds(545, 4)
    assert len(set(s)) == 4 and all(0 <= x < 2 ** 32 for x in s)
