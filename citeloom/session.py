"""Session factory and the few session settings the library relies on."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def get_spark(app: str = "citeloom", cores: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings of the tests and the bench; on a cluster pass your own session instead."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CITELOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``. Where the setting is unset, a folder of our own in local mode, as
    in tests; on a cluster that's an error, since executors don't share local folders."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir isn't set")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="citeloom-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df):
    """Write ``df`` to the shared checkpoint folder, so that lost executors don't replay what led to it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
