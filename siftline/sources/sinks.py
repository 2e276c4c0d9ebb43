"""Where results go: JSON, CSV and Markdown reports, and metrics that are only added to.

Each writes through Spark's committers, so a reader sees a whole table or, beside ``_SUCCESS``, none; ``replaced``
writes beside the old folder first where a reader must never see it gone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def write_json(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One JSON object a line; a folder for each value of ``by``."""
    w = df.write.mode("overwrite").option("ignoreNullFields", "false")
    (w.partitionBy(*by) if by else w).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a head in each file; nested columns must be written out before."""
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_lines(lines: DataFrame, path: str, order: str = "ord", line: str = "line") -> None:
    """Lines of a report, such as a Markdown table, in one file: a report is small."""
    lines.orderBy(order).select(line).coalesce(1).write.mode("overwrite").text(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Adds to a log of JSON lines; what is there stays."""
    df.write.mode("append").json(path)


def replaced(spark: SparkSession, df: DataFrame, folder: str) -> str:
    """Writes ``df`` as a new version below ``folder`` and returns its path; earlier versions stay until they are no
    longer read."""
    path = f"{folder.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def _markers(spark: SparkSession, base: str):
    """(file system, folder of the markers): one empty file for each version that is whole."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/_versions")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def versions(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the versions below ``base`` that are whole, oldest first."""
    files, folder = _markers(spark, base)
    return sorted(int(s.getPath().getName()) for s in files.listStatus(folder)) if files.exists(folder) else []


def publish(df: DataFrame, base: str, version: int) -> bool:
    """Make ``df`` version ``version`` of the table below ``base``; False where that version is there already.

    The data are written first and one empty marker last, which the file system creates whole or not at all: until
    then, and after a write that failed, readers see the version before. A batch that is run again writes over what it
    had left, or, once its marker stands, does nothing, so ``foreachBatch`` may hand over its batch number.
    """
    spark = df.sparkSession
    if version in versions(spark, base):
        return False
    df.write.mode("overwrite").parquet(f"{base.rstrip('/')}/{version}")
    files, folder = _markers(spark, base)
    files.create(spark._jvm.org.apache.hadoop.fs.Path(folder, str(version)), True).close()
    return True


def current(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """The newest whole version of the table below ``base``, or an older one; a reader keeps the one that it began with."""
    there = versions(spark, base)
    if not there or version is not None and version not in there:
        raise ValueError(f"no version {'' if version is None else version} below {base}")
    return spark.read.parquet(f"{base.rstrip('/')}/{there[-1] if version is None else version}")


def drop_versions(spark: SparkSession, base: str, keep: int = 2) -> list[int]:
    """Remove all but the newest ``keep`` versions, the marker before the data; returns what went."""
    files, folder = _markers(spark, base)
    old = versions(spark, base)[: -keep or None]
    for version in old:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, str(version)), False)
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{version}"), True)
    return old
