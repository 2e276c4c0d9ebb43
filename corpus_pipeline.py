"""From raw documents to packed sequences, in five stages, each written as Parquet before the next reads it.

quality: documents that the classifier rejects go. exact dedup: of equal texts the largest doc_id stays.
near dedup: one document of each group of near copies stays: five-word shingles, a similarity of 0.8 or more.
mixing: documents are dropped or repeated so that the sources meet their target weights. packing: the pieces of all
documents in sequences of at most 2048 tokens.

An empty table passes through every stage, and so do further columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import common, exact_dedup, mixing, near_dedup, packing, quality


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for label 1. Null and empty texts are scored as empty ones; a
    repeated row is judged each time."""
    common.prepare(spark)
    score, good_ = common.unused(docs.columns, "score", "good")
    scored = quality.score_quality(docs, common.read(spark, sf_dir, "labels"), threshold=0.3, names=(score, good_))
    return scored.where(F.col(good_) == 1).select(*docs.columns)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for A-Z's case the row with the largest doc_id; null counts as empty, a row without id stays
    only if no other has its text, and of rows that repeat id and text one stays."""
    common.prepare(spark)
    return exact_dedup.exact_kept(docs, keep="largest")


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the row with the smallest doc_id, a null id after all others. Texts without words are no copies,
    but of rows that repeat id and text one stays."""
    common.prepare(spark)
    return near_dedup.near_kept(docs, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, from never to three times. Null sources are one source; rows that
    repeat id, text and source are taken alike; documents without words go with their block."""
    common.prepare(spark)
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document; null and empty texts have their end id alone, a repeated row has pieces each time."""
    common.prepare(spark)
    return packing.best_fit_packing(docs, capacity=2048, end_id=0)


STAGES = [("quality classifier", good), ("exact dedup", distinct_texts), ("MinHash near-dedup", no_near_copies), ("mixing sources", mixed), ("best-fit packing", packed)]

#: A trained network, minhashes, random draws and a tokenizer can't be expressed in SQL; tests compare each
#: stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(spark, docs, f"pipeline-{k}")
    return docs
