"""Splits by hash cuts, narrow numbering, and the bounded level test."""

from pyspark.sql import functions as F

from tabsift.operators.frames import levels_map, levels_up_to
from tabsift.operators.resample import random_oversample
from tabsift.operators.split import class_quotas, repeated_stratified_kfold, stratified_bootstrap, stratified_split, with_seeds


def frame(spark, n=4000):
    return spark.range(n).select("id", F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 3 == 0, 1.0).otherwise(0.0).alias("target"), (F.col("id") * 2.0).alias("x"))


def test_split_keeps_null_classes_and_quotas(spark):
    df = frame(spark)
    out = stratified_split(df, 0.3, 11)
    assert out.columns == [*df.columns, "part"] and out.count() == df.count()
    quota = {r["target"]: r["quota"] for r in class_quotas(df.withColumn("seed", F.lit(11)), 0.3).collect()}
    got = {r["target"]: r["count"] for r in out.where("part = 'test'").groupBy("target").count().collect()}
    assert got == quota and None in got


def test_split_takes_the_least_hashes(spark):
    from tabsift.functions.portable import hash52
    df = frame(spark, 500)
    out = stratified_split(df, 0.25, 3).withColumn("h", hash52(F.col("id"), F.lit(3).cast("bigint"))).collect()
    for cls in (None, 0.0, 1.0):
        test = [r["h"] for r in out if r["target"] == cls and r["part"] == "test"]
        train = [r["h"] for r in out if r["target"] == cls and r["part"] == "train"]
        assert max(test) < min(train)


def test_split_moves_no_feature(spark):
    """The plan of the split rows has no shuffle: only the cuts are broadcast."""
    out = stratified_split(frame(spark), 0.3, 11)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Sort" not in plan and "Window" not in plan


def test_many_seeds_at_once(spark):
    df = with_seeds(frame(spark, 900), [1, 2, 3])
    out = stratified_split(df, 0.3).groupBy("seed", "part").count().collect()
    assert {r["count"] for r in out if r["part"] == "test"} == {270} and len(out) == 6


def test_folds_and_draws_with_null_classes(spark):
    df = frame(spark, 600)
    folds = repeated_stratified_kfold(df, 3, 4, 5)
    assert folds.columns == [*df.columns, "repeat", "fold"] and folds.count() == 2400
    sizes = [r["count"] for r in folds.groupBy("repeat", "fold", "target").count().collect()]
    assert len(sizes) == 36 and max(sizes) - min(sizes) <= 320 / 3
    assert stratified_bootstrap(df, 1, 0, 0.3).count() == 420
    over = random_oversample(df).groupBy("target").count().collect()
    assert len({r["count"] for r in over}) == 1 and len(over) == 3


def test_levels_up_to(spark):
    df = spark.createDataFrame([(i % 2, float(i % 3), float(i), None, 1.0) for i in range(300)], "k int, a double, b double, c double, d double").repartition(7)
    assert levels_map(df, ["a", "b", "c", "d"], 5) == {"a": 3, "b": 6, "c": 0, "d": 1}
    by = {(r["k"], r["feature"]): r["n_levels"] for r in levels_up_to(df, ["a", "b", "d"], 2, ["k"]).collect()}
    assert by == {(k, f): n for k in (0, 1) for f, n in (("a", 3), ("b", 3), ("d", 1))}
    plan = levels_up_to(df, ["a", "b"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan
