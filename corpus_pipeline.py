"""Preparation of a training corpus: five stages over the table ``documents``.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of documents. Null and empty texts pass the filters
(near duplicates and repeated strings: they have nothing to share; quality:
they get the share of good labels). A null id is an id like any other: rows
are judged by id and text together, so rows with equal or null ids don't share
their fate. Of rows equal in id and text one is left by the second stage. An
empty table goes through to an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktide.llm import decontaminate, near_dedup, packing, quality, substring_dedup
from sparktide.llm._common import Workspace, read_table

#: Name of a column that a stage adds and removes.
KEY = "_pipeline_row_key"
#: Words of the shortest passage that may not repeat.
WORDS = 51


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (7) does not reject."""
    return quality.good_documents(docs, read_table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (10): the smallest id. A row is
    known by its id and text, so rows of equal or null ids are judged one by one; a
    null id is larger than any other."""
    keyed = docs.withColumn(KEY, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text")))
    kept = near_dedup.near_duplicates(keyed, KEY).where("kept").select(F.col("doc_id").alias("kept_key")).distinct()
    return keyed.join(kept, F.col(KEY) == F.col("kept_key"), "left_semi").dropDuplicates([KEY]).drop(KEY)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of over 50 words that repeat, and of the rest
    without strings of 400 bytes that repeat (2): those may be of few words, or of
    a script without spaces."""
    return substring_dedup.without_repeats(substring_dedup.without_repeats(docs, words=WORDS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark (9)."""
    return decontaminate.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens (6)."""
    out = packing.packed(docs.select("doc_id", "text"))
    return out.select("row.doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The stages are no SQL; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ws = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = ws.table(stage(spark, docs, sf_dir), name)
        if k:
            ws.drop(STAGES[k - 1][0])
    return docs
