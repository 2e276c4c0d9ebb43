"""Session defaults: UTC, ANSI casts, adaptive plans."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def session(app: str = "siftline", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return builder.config(map=defaults | conf).getOrCreate()


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it isn't installed."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH", ""), ROOT]))
    return spark


def cut(df):
    """Write ``df`` to the folder that all executors share and read it from there, so that it is worked out once.

    The folder is ``spark.checkpoint.dir``; where it is unset, a new one in local mode and an error on a cluster.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="siftline-"))
    return df.checkpoint()


def numbered(rows, order: list, name: str):
    """Adds ``name``: 1, 2, 3, ... in ``order``, by a sort in ranges; only one count for each range meets in one task."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    ranged = cut(rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_range", F.spark_partition_id()))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_ahead")).withColumn("_ahead", F.coalesce(F.sum("_ahead").over(ahead), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn(name, within).join(F.broadcast(counts), "_range").withColumn(name, F.col(name) + F.col("_ahead")).drop("_range", "_ahead")


def table(spark: SparkSession, sf_dir: str, name: str):
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")
