"""The study's shared steps: weights as literals, seeds side by side, characters counted by runs (F6)."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from tabsift.operators import models as ml
from tabsift.plans import study
from tabsift.sources.fixtures import _count_chars


def test_weights_are_literals(spark):
    df = spark.createDataFrame([(i, None if i == 9 else float(i % 3 == 0), float(i)) for i in range(10)], "id long, target double, x double")
    out = ml.class_weights(df)
    assert out.columns == ["target", "id", "x", "weight"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    got = {r["id"]: r["weight"] for r in out.collect()}  # three groups: 6 rows of 0, 3 of 1, 1 without a class
    assert got == {i: 10.0 / (3.0 * (3 if i % 3 == 0 else 6)) for i in range(9)}


def test_weights_of_many_classes(spark):
    n = ml.WEIGHT_CASES + 3
    out = ml.class_weights(spark.range(2 * n).select("id", (F.col("id") % n).cast("double").alias("target")))
    assert {r["weight"] for r in out.collect()} == {1.0} and out.count() == 2 * n


def test_seeds_run_side_by_side(spark, tmp_path, monkeypatch):
    base = spark.range(240).select("id", (F.col("id") % 2).cast("double").alias("target"), ((F.col("id") * 37) % 101).cast("double").alias("a"),
                                   (F.col("id") % 13).cast("double").alias("b"))
    both, split = threading.Barrier(2, timeout=120), study.stratified_split

    def met(*args):
        both.wait()  # broken where one seed waits for the other
        return split(*args)
    monkeypatch.setattr(study, "stratified_split", met)
    seen = []
    out = study.run_study(spark, base, ["a", "b"], str(tmp_path / "s"), "e", [1, 2], [["z_score_norm"]], [1, 2], {"logistic_regression": {}},
                          on_cell=lambda s, j: seen.append(s))
    assert sorted(seen) == [1, 2]
    assert {(r["seed"], r["n_top"]): r["count"] for r in out.groupBy("seed", "n_top").count().collect()} == {(s, n): 72 for s in (1, 2) for n in (1, 2)}


@pytest.mark.parametrize("chars", ["0123456789", ".,;:!?"])
def test_counted_characters(spark, chars):
    texts = ["", None, "12", "a1b22,\n.;!?:", "…1😀2é3\r\n ٣", chars * 3, "  x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", _count_chars(F.col("t"), chars).alias("n"))
    assert {r["i"]: r["n"] for r in rows.collect()} == {i: None if t is None else sum(t.count(c) for c in chars) for i, t in enumerate(texts)}
