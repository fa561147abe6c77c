"""Five stages from raw documents to packed training sequences; each stage reads what the one before it wrote.

Every stage keeps all columns of documents, others with clashing names too, and an empty table stays empty; the last one
returns pieces instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontamination, importance, line_dedup, near_dedup, packing
from siltstone.llm.support import delete, scratch_dropped, scratch_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents and those that importance resampling rejects go, each row by its own text.

    A null or empty text has weight 0; a row without an id draws its noise from its text. Without labels all rows stay.
    """
    return importance.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but the first; each row stays, with what is left of its text.

    A null text stays null; a row without an id keeps its lines; rows that repeat an id lose the same lines.
    """
    done = line_dedup.dedup(docs)
    text = F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col("line_dedup.kept"))
    return done.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).drop("line_dedup")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that with the smallest id.

    Rows are told apart whether ids repeat or are null: of equal rows one stays, and rows of one id with other texts are
    documents of their own. A row without words is in no group.
    """
    return near_dedup.without_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated rows go, each by its own hits, whatever its id; a row without words stays."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece of each row's text with its sequence and its place there; null text has its end token alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near dedup", near_duplicates),
    ("decontamination", decontamination_stage),
    ("best-fit packing", sequences),
]

#: Hashed n-gram models, tokenizer and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, as a table. What a stage wrote besides its result goes when it is done, its result when the next is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name.replace(' ', '-')}")
        with scratch_dropped(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
