"""Probe results as a stream that is drained in batches: facts or a failure for each file, written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import parsers

#: Files of a batch.
BATCH = 50
PROBES = "path string, output string, error string"


def read_probes(spark: SparkSession, folder: str, batch: int = BATCH) -> DataFrame:
    """A stream of captured probes, one JSON file of (path, output, error) each, so many files a batch."""
    return spark.readStream.schema(PROBES).option("maxFilesPerTrigger", batch).json(folder)


def probed_files(probes: DataFrame) -> DataFrame:
    """(path, status, probe_error, facts): a probe that failed, or whose output says nothing, is recorded and not tried again."""
    facts = parsers.probed(F.col("output"))
    found = probes.withColumn("facts", facts)
    broken = F.coalesce(F.nullif(F.trim("error"), F.lit("")), F.when(F.col("facts.container").isNull(), "The probe's output could not be read."))
    return found.select("path", F.when(broken.isNull(), "Probed").otherwise("ProbeFailed").alias("status"), broken.alias("probe_error"), F.when(broken.isNull(), F.col("facts")).alias("facts"))


def into(folder: str) -> Callable[[DataFrame, int], None]:
    """A batch writer for ``progress.drain``: a batch that is repeated after a failure replaces what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        probed_files(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write
