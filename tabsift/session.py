"""Spark session and shared-folder helpers.

Scratch data (round trips, lineage cuts) always goes under the folder the
cluster names in ``spark.checkpoint.dir``. Only when that setting is unset
(local tests) do we pick a folder ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(app: str = "tabsift", **settings: str) -> SparkSession:
    """The active session, or one from the launcher's settings and the SQL settings that the library relies on.

    Master, memory and shuffle partitions are the launcher's business: ``settings`` passes any of them on
    (``get_spark(**{"spark.master": "local[8]"})``), nothing here overrides them.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def local_settings(cpus: str | None = None) -> dict[str, str]:
    """Settings of a one-machine session, for the benchmark, scripts and tests."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return {"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="tabsift-ckpt-")  # one machine only
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tabsift-tables/{name}-{uuid.uuid4().hex}"
