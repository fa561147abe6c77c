"""A walk over folders, level by level: the folders of a level are rows that tasks list, and so is what could not be listed."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.files import extensions_for
from siltstone.sources.shared import checkpointed

ENTRIES = "folder string, path string, is_folder boolean, length long, modified double, error string, level int"
#: Name, whether it is a folder, bytes, and seconds since 1970 of each entry of a folder.
Listing = Callable[[str], Iterable[tuple[str, bool, int, float]]]


def local_listing(folder: str) -> Iterator[tuple[str, bool, int, float]]:
    """The entries of a folder of a file system that all executors see; links are not followed, what vanishes meanwhile is left out."""
    with os.scandir(folder) as entries:
        for entry in entries:
            try:
                facts = entry.stat(follow_symlinks=False)
            except FileNotFoundError:
                continue
            if not entry.is_symlink():
                yield entry.name, entry.is_dir(follow_symlinks=False), facts.st_size, facts.st_mtime


def walk(spark: SparkSession, root: str, listing: Listing = local_listing, folders_a_task: int = 64) -> DataFrame:
    """Everything below root: files and folders with their level, and a row with an error for each folder that can't be listed.

    A level's folders are dealt to tasks, and one that fails takes nothing from others. There is a job for each level; no
    task, and not the driver, sees all folders of a level.
    """

    def step(level: int):
        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for folder in batch.column(0).to_pylist():
                    try:
                        rows = [(folder, f"{folder}/{name}", is_folder, size, at, None, level) for name, is_folder, size, at in listing(folder)]
                    except Exception as error:  # noqa: BLE001  whatever a file system raises, the walk goes on
                        rows = [(folder, folder, True, 0, None, f"{type(error).__name__}: {error}"[:500], level)]
                    columns = list(zip(*rows)) or [()] * 7
                    kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.float64(), pa.string(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in ENTRIES.split(", ")])

        return listed

    frontier, n, levels = spark.createDataFrame([(root.rstrip("/"),)], "folder string"), 1, []
    while n:
        found = checkpointed(frontier.repartition(max(1, -(-n // folders_a_task))).mapInArrow(step(len(levels)), ENTRIES))
        levels.append(found)
        frontier = found.where("is_folder and error is null").select(F.col("path").alias("folder"))
        n = frontier.count()
    return reduce(DataFrame.unionByName, levels)


def walked(entries: DataFrame, root: str, media_type: str, now_seconds: float, settling_seconds: int = 120) -> DataFrame:
    """(path, relative_path, size_bytes, modified_at, settled) of the media files of a walk."""
    base = root.rstrip("/")
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    media = entries.where(~F.col("is_folder") & extension.isin(*extensions_for(media_type)))
    return media.select("path", F.substring("path", len(base) + 2, 1 << 30).alias("relative_path"), F.col("length").alias("size_bytes"), F.timestamp_micros((F.col("modified") * 1_000_000).cast("long")).alias("modified_at"), (F.lit(now_seconds) - F.col("modified") >= settling_seconds).alias("settled"))


def walk_counts(entries: DataFrame, media_type: str) -> DataFrame:
    """One row: media files, other files, folders, and folders that could not be listed."""
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    file, media = ~F.col("is_folder"), F.coalesce(extension.isin(*extensions_for(media_type)), F.lit(False))
    return entries.agg(F.count_if(file & media).alias("media"), F.count_if(file & ~media).alias("others"), F.count_if(F.col("is_folder") & F.col("error").isNull()).alias("folders"), F.count_if(F.col("error").isNotNull()).alias("failed"))
