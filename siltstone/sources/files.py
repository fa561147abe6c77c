"""Sources: a folder scan with a settling time, and typed settings from keys and values."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions by media type.
EXTENSIONS = {
    "Video": (".mkv", ".mp4", ".m4v", ".avi", ".mov", ".wmv", ".ts", ".m2ts", ".mts", ".flv", ".webm", ".mpg", ".mpeg"),
    "Music": (".flac", ".mp3", ".m4a", ".m4b", ".aac", ".opus", ".ogg", ".oga", ".wav", ".wma", ".aiff", ".aif", ".ape", ".wv", ".mka", ".dsf", ".dff"),
    "Photos": (".jpg", ".jpeg", ".png", ".webp", ".gif", ".bmp", ".tif", ".tiff", ".heic", ".heif", ".avif", ".jxl"),
}


# What else those media types are called.
SAME_EXTENSIONS = {"Film": "Video", "Tv": "Video", "Photo": "Photos"}


def extensions_for(media_type: str) -> tuple[str, ...]:
    """The media type's extensions; all of them for Other."""
    kind = SAME_EXTENSIONS.get(media_type, media_type)
    if kind not in (*EXTENSIONS, "Other"):
        raise ValueError(f"{media_type!r} is none of: {', '.join((*EXTENSIONS, *SAME_EXTENSIONS, 'Other'))}")
    return EXTENSIONS.get(kind) or tuple(e for group in EXTENSIONS.values() for e in group)


def listed(files: DataFrame, root: str, media_type: str, now: Column, settling_seconds: int = 120) -> DataFrame:
    """(path, relative_path, size_bytes, modified_at, settled) of (path, length, modificationTime) rows below root.

    A row a file, also where paths repeat; further columns stay, after these.
    """
    base = root.rstrip("/").removeprefix("file://")
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    relative = F.substring(F.col("path"), F.locate(base, F.col("path")) + F.lit(len(base) + 1), F.length("path"))
    settled = now - F.col("modificationTime") >= F.expr(f"INTERVAL {settling_seconds} SECONDS")
    named = files.where(extension.isin(*extensions_for(media_type)))
    further = [c for c in files.columns if c not in ("path", "length", "modificationTime")]
    return named.select("path", relative.alias("relative_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), settled.alias("settled"), *further)


def scan_counts(found: DataFrame) -> DataFrame:
    """One row: how many files are settled, and how many are left for the next scan."""
    return found.agg(F.count_if("settled").alias("files"), F.count_if(~F.col("settled")).alias("unsettled"))


def scan(spark: SparkSession, root: str, media_type: str = "Other", now: datetime | None = None, settling_seconds: int = 120) -> DataFrame:
    """``listed`` for the files below root, in all its folders.

    The files' contents are not read; one that vanishes meanwhile is left out. A file younger than the settling time is
    left for the next scan: settled is false. Spark lists as the user that it runs as, so a folder that this user can't
    read is an error of the file system, and attributes such as hidden or system are not known to it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(root).select("path", "length", "modificationTime")
    return listed(files, root, media_type, F.current_timestamp() if now is None else F.lit(now), settling_seconds)


def settings(rows: DataFrame, defaults: dict[str, object], least: dict[str, object] | None = None) -> DataFrame:
    """One row of (key, value) rows: each key's value in its default's type, the default where it is missing or damaged."""
    wide = rows.where(F.col("key").isin(*defaults)).groupBy().pivot("key", list(defaults)).agg(F.first("value"))
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    columns = {}
    for key, default in defaults.items():
        value = F.coalesce(F.col(f"`{key}`").try_cast(kinds[type(default)]), F.lit(default))
        columns[key] = F.greatest(value, F.lit(least[key])) if least and key in least else value
    return wide.select(*[v.alias(k) for k, v in columns.items()])
