"""A whole study that can be resumed: seeds → split → impute → jobs → verification, one committed partition a (seed, job).

The plan is the list of cells; a cell whose predictions hold every size and model that it can have is stored and left alone,
the rest is computed by seed (the jobs of a seed share their common steps) and written with dynamic partition
overwrite, a few seeds at once. A study that was interrupted goes on where it stopped; the result table is what the summaries read.
"""

from __future__ import annotations

from collections.abc import Callable
from threading import Lock

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import models as ml
from ..operators.impute import simple_impute
from ..operators.positions import checkpointed
from ..operators.split import repeated_stratified_kfold, stratified_split
from ..sources.io import resume_plan, save_results
from .jobs import job_name, resolved_jobs, run_jobs

CELL = ["experiment", "seed", "job"]
#: Seeds whose cells are computed side by side: the short jobs of one fill the cores that the other leaves idle.
SEEDS_AT_ONCE = 2
SCHEMA = T.StructType([T.StructField("n_top", T.LongType()), T.StructField("model", T.StringType()), T.StructField("id", T.LongType()),
                       T.StructField("y_true", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("score_kind", T.StringType()),
                       T.StructField("prob1", T.DoubleType()), T.StructField("y_pred", T.IntegerType()), T.StructField("experiment", T.StringType()),
                       T.StructField("seed", T.LongType()), T.StructField("job", T.StringType())])


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The predictions stored so far (none: an empty table)."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def best_params(train: DataFrame, feats, models: dict, grids: dict, folds: tuple[int, int], seed: int) -> dict:
    """``models`` with the parameters that their grid's search over repeated folds prefers, for those with a grid."""
    if not grids:
        return models
    table = checkpointed(repeated_stratified_kfold(train.select("id", "target"), folds[0], folds[1], seed).select("id", "repeat", "fold"))
    out = dict(models)
    for name in models:
        if name in grids:
            _, best, _ = ml.grid_search(train, feats, name, grids[name], table, seed=seed)
            out[name] = {**models[name], **{k: v for k, v in best.items() if k != "n_rows"}}
    return out


def run_study(spark: SparkSession, base: DataFrame, features, path: str, experiment: str, seeds, jobs, n_tops, models: dict,
              grids: dict | None = None, folds: tuple[int, int] = (3, 10), model_seed: int = 0, params: dict | None = None,
              on_cell: Callable[[int, str], None] | None = None) -> DataFrame:
    """Predictions of every (seed, job, n_top, model) of the study, from ``path``; cells that are stored are not computed again.

    ``base`` has id, target and the features, with holes. ``grids`` are searched for each size over ``folds`` (splits, repeats) of
    the train part; a job that leaves no feature has no rows. ``on_cell`` is told each (seed, job) that was computed.
    """
    jobs = resolved_jobs(jobs)
    plan = spark.createDataFrame([(experiment, int(s), job_name(j)) for s in seeds for j in jobs], "experiment string, seed long, job string")
    left = {(r["seed"], r["job"]) for r in resume_plan(plan, stored(spark, path), CELL).collect()}  # the plan's size
    base.count()  # a cached base is filled here, by all cores, and not by several seeds at once
    writing = Lock()

    def one_seed(seed):
        todo = [j for j in jobs if (int(seed), job_name(j)) in left]
        if not todo:
            return
        data = checkpointed(simple_impute(stratified_split(base, 0.3, int(seed)), features))
        for name, (frame, feats) in run_jobs(data, features, todo, {"n_top_features": list(n_tops), **(params or {})}).items():
            if not feats:
                continue
            frame = checkpointed(frame)
            train, test = (frame.where(F.col("part") == p) for p in ("train", "test"))
            sizes = [n for n in n_tops if n <= len(feats)] or [len(feats)]
            tables = [ml.verify_top_n(train, test, feats, [n], best_params(train, feats[:n], models, grids or {}, folds, int(seed)), seed=model_seed)
                      for n in sizes] if grids else [ml.verify_top_n(train, test, feats, sizes, models, seed=model_seed)]
            for i, t in enumerate(tables):
                tables[i] = t.select("n_top", "model", "id", "y_true", "score", "score_kind", "prob1", "y_pred")
            out = tables[0]
            for t in tables[1:]:
                out = out.unionByName(t)
            with writing:  # one commit into the study's folder at a time
                save_results(out.select("*", F.lit(experiment).alias("experiment"), F.lit(int(seed)).cast("long").alias("seed"), F.lit(name).alias("job")), path, CELL)
                if on_cell is not None:
                    on_cell(int(seed), name)

    ml.concurrently(spark, one_seed, list(dict.fromkeys(seeds)), SEEDS_AT_ONCE, "tabsift-seed")
    return stored(spark, path)
