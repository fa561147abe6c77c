"""What the training-data operators share: tables, shared scratch tables, word splitting and hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space, as the contracts' classes name it; ``bytes.split()`` splits at just these.
SPACE = " \t\n\x0b\x0c\r"
#: Lower-cases A-Z in UTF-8 bytes and leaves all else.
LOWER_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master, where all run in one machine, falls back to a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark, "_llm_scratch", None)
    if own is None:
        own = spark._llm_scratch = f"file://{tempfile.mkdtemp(prefix='spark-llm-')}"
    return own


_scopes: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch_dropped(spark: SparkSession) -> Iterator[None]:
    """Deletes at the end, if there is no error, what ``materialise`` wrote inside: for jobs whose result is written there."""
    _scopes.append([])
    try:
        yield
    except BaseException:
        _scopes.pop()
        raise
    for path in _scopes.pop():
        delete(spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: computed once, without lineage, and safe from lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete a table of ``materialise`` that nothing will read any more."""
    files = df.inputFiles()
    path = files[0].rsplit("/", 1)[0] if files else ""
    if "/llm/" in path:
        delete(df.sparkSession, path)


def ascii_lower(col) -> F.Column:
    return F.translate(col, UPPER, LOWER)


def byte_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of other than ASCII white space, as UTF-8; with lower, A-Z lower-cased."""
    raw = (text or "").encode()
    return (raw.translate(LOWER_TABLE) if lower else raw).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the result depends on every bit of x (uint64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
