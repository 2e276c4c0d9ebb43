"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
import string
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REPO_ROOT = str(Path(__file__).resolve().parents[2])

#: Bytes of one Arrow batch of texts, about, so that a Python worker's memory stays bounded when texts are long.
BATCH_BYTES = 1 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and bound Arrow batches by their bytes too, not by their rows alone."""
    env = spark.sparkContext.environment
    if REPO_ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH", ""), REPO_ROOT]))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))  # rows: as the session has it
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. A new local one where it is unset and Spark runs
    in one process; on a cluster that is an error, as executors wouldn't see each other's files."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="siftline-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder, so that lost executors don't recompute what led to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def lower_az(col: Column | str) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def held_out(doc_id: Column | str) -> Column:
    """Rows that no model may learn from: crc32 of the id as text is a multiple of five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_texts(docs: DataFrame, labels: DataFrame, target: str, per_class: int, sample_bytes: int) -> tuple[DataFrame, dict[int, int]]:
    """``(texts, counts)``: texts (doc_id, label, text) to learn from, and how many ids bear each label.

    Held-out ids and ids without label are left out. Of each label up to ``per_class`` ids are taken by hashed
    order, and of those as many as have ``sample_bytes`` bytes of text together, at least one. An id that repeats
    counts once, with its smallest label, and the text of the smallest hash.
    """
    known = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.min(F.col(target).cast("int")).alias("label"))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    turn = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = [known.where(F.col("label") == k).orderBy(*turn).limit(per_class) for k in (0, 1)]
    picked = F.broadcast(some[0].unionByName(some[1]))  # at most 2 * per_class ids
    texts = only(docs, "doc_id", "text").join(picked, "doc_id").groupBy("doc_id", "label").agg(F.min_by(F.coalesce("text", F.lit("")), F.struct(F.xxhash64("text"), "text")).alias("text"))
    texts = cut(texts)
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("label").orderBy(*turn).rowsBetween(Window.unboundedPreceding, 0))
    first = F.row_number().over(Window.partitionBy("label").orderBy(*turn)) == 1
    return texts.withColumn("upto", upto).withColumn("first", first).where((F.col("upto") <= sample_bytes) | F.col("first")).select("doc_id", "label", "text"), counts


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, so that extra columns of the input can't clash with the operator's own."""
    return df.select(*names)


def unused(columns: list[str], *names: str) -> list[str]:
    """``names`` with a beginning that no column has, so that an operator's own columns can't clash with them."""
    taken = [c.lower() for c in columns]
    begin = "_"
    while any(c.startswith(begin) for c in taken):
        begin += "_"
    return [begin + n for n in names]


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... in ``order``, which must tell rows apart; rows are sorted in ranges, not in one task."""
    part, = unused(rows.columns, "part")
    ranged = cut(rows.repartitionByRange(partitions(rows), *order).withColumn(part, F.spark_partition_id()))
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    counts = ranged.groupBy(part).agg(F.count("*").alias(name)).withColumn(name, F.coalesce(F.sum(name).over(ahead), F.lit(0)))
    within = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return ranged.withColumn(name + part, within).join(F.broadcast(counts), part).withColumn(name, F.col(name) + F.col(name + part)).drop(part, name + part)


def keep_rows(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of ``docs`` that ``groups`` (doc_id, text_hash, kept) keeps; of rows equal in id and text, one.

    Texts are shuffled once: the join and the removal of repeats need the same partitioning.
    """
    name, = unused(docs.columns, "row_key")
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("none")), F.xxhash64("text").cast("string"))
    kept = groups.where("kept").select(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.col("text_hash").cast("string")).alias(name))
    return docs.withColumn(name, key).join(kept, name, "left_semi").dropDuplicates([name]).drop(name)


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
