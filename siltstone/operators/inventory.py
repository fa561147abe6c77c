"""The inventory as a whole: every file's decision, its pages, what is queued from it, and what a rescan resets.

``candidates`` joins files, libraries, history and exclusions into one decision per file. A file without a library, or with
one that is gone, is judged by the default profile's rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.media import primary_codec
from siltstone.functions.scalars import normal_folder, path_stem

from . import filters, joins, merge, rules

# Statuses of jobs that are still to end, the longest reason that a job keeps.
ACTIVE = ("Queued", "Probing", "Transcoding", "Verifying", "ReadyToReplace")
REASON_LENGTH = 512
#: Per-library lists that the rules compare files with.
LISTS = ("exclude_segments", "keep_audio_languages", "keep_subtitle_languages")
OVERLAYS = ("completed_at", "failed_at", "excluded")


def history(jobs: DataFrame) -> DataFrame:
    """(media_file_id, completed_at, failed_at): when a normal job of each file last ended either way."""
    ended = jobs.where((F.col("type") == "Normal") & F.col("finished_at").isNotNull() & F.col("status").isin("Completed", "Failed"))
    last = lambda status: F.max(F.when(F.col("status") == status, F.col("finished_at")))
    return ended.groupBy("media_file_id").agg(last("Completed").alias("completed_at"), last("Failed").alias("failed_at"))


def with_rules(files: DataFrame, libraries: DataFrame) -> DataFrame:
    """files with the resolved rules of their libraries, the default profile's where there is none."""
    spark = files.sparkSession
    resolved = rules.resolved_rules(libraries, spark)
    names = [c for c in resolved.columns if c in {*rules.RULE_COLUMNS, *LISTS}]
    of_library = resolved.select(F.col("id").alias("__library"), F.struct(*names).alias("__rules"))
    kinds = {f.name: f.dataType for f in resolved.schema}
    default = F.struct(*[F.lit(rules.DEFAULT_RULES.get(c)).cast(kinds[c]).alias(c) for c in names])
    joined = files.join(of_library, F.col("library_id") == F.col("__library"), "left")
    return joined.withColumn("__rules", F.coalesce("__rules", default)).select(*files.columns, "__rules.*")


def candidates(files: DataFrame, libraries: DataFrame, jobs: DataFrame | None = None, exclusions: DataFrame | None = None) -> DataFrame:
    """One row per probed file: its facts, profile, and decision struct<eligible, reason> after all overlays.

    Without jobs, as when a single file is checked again just before it is worked on, history does not count.
    """
    probed = files.where(F.col("status") == "Probed").withColumn("audio_codec", primary_codec(F.col("audio_codecs")))
    judged = rules.evaluate(with_rules(probed, libraries)).withColumn("__stem", path_stem("relative_path"))
    marked = F.coalesce(F.col("optimised_marker") != "", F.lit(False))
    judged = joins.sibling_flag(judged, ["library_id", "__stem"], marked, "__sibling")
    last = {}
    if jobs is not None:
        judged = judged.join(history(jobs).withColumnRenamed("media_file_id", "id"), "id", "left")
        last = {"completed": F.col("completed_at"), "failed": F.col("failed_at"), "modified": F.col("modified_at")}
    excluded = None
    if exclusions is not None:
        judged = judged.join(exclusions.select(F.col("path").alias("__path"), F.lit(True).alias("excluded")).distinct(), F.col("path") == F.col("__path"), "left")
        excluded = F.col("excluded")
    decision = rules.overlaid(F.col("decision"), F.col("__sibling"), excluded=excluded, **last)
    codec = F.when(F.col("media_kind") == "Audio", F.col("audio_codec")).otherwise(F.col("video_codec"))
    return judged.select(
        F.col("id").alias("media_file_id"), "library_id", "path", "relative_path", "size_bytes", "video_codec", "height", "is_hdr", "media_kind",
        codec.alias("codec"), "profile", decision.alias("decision"),
    ).select("*", "decision.*").drop("decision")


def summary(decided: DataFrame) -> DataFrame:
    """Per library how many files are eligible and how many are skipped."""
    counted = F.count_if("eligible").alias("eligible"), F.count_if(~F.col("eligible")).alias("skipped")
    return decided.where(F.col("library_id").isNotNull()).groupBy("library_id").agg(*counted)


def listing(files: DataFrame, decided: DataFrame, term: str | None = None, wanted: str = "all", number: int = 1, size: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page, tallies): files that match the term with their verdicts, null where not probed, those wanted, ordered by path.

    Tallies count what matches the term before the verdict is asked for.
    """
    verdicts = decided.select(F.col("media_file_id").alias("id"), "eligible", "reason")
    rows = files.where(filters.conjunction([filters.search("path", term)])).join(verdicts, "id", "left")
    tallies = rows.agg(F.count("*").alias("n_all"), *[F.count_if(filters.verdict(F.col("eligible"), v)).alias(f"n_{v}") for v in ("eligible", "skipped", "unprobed")])
    return filters.page(rows.where(filters.verdict(F.col("eligible"), wanted)), [F.col("relative_path"), F.col("id")], number, size), tallies


def enqueue(decided: DataFrame, jobs: DataFrame, libraries: DataFrame, import_folders: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(new jobs, counts): eligible files as queued jobs, without those that are being worked on or imported.

    import_folders: (folder, place); a file is being imported if it lies in one of them, whatever its separators.
    counts is one row: enqueued, active, ineligible, importing.
    """
    busy = jobs.where((F.col("type") == "Normal") & F.col("status").isin(*ACTIVE)).select(F.col("media_file_id"), F.lit(True).alias("active")).distinct()
    folders = import_folders.select(normal_folder("folder").alias("folder"), "place")
    joined = decided.withColumn("path", normal_folder("path")).join(busy, "media_file_id", "left")
    placed = joins.under_folders(joined, "path", folders, "folder", F.min_by("folder", "place"), "importing")
    active, importing = F.coalesce("active", F.lit(False)), F.col("importing").isNotNull()
    new = F.col("eligible") & ~active & ~importing
    counts = placed.agg(F.count_if(new).alias("enqueued"), F.count_if(F.col("eligible") & active).alias("active"), F.count_if(~F.col("eligible")).alias("ineligible"), F.count_if(F.col("eligible") & ~active & importing).alias("importing"))
    priorities = libraries.select(F.col("id").alias("library_id"), "priority")
    made = placed.where(new).join(priorities, "library_id", "left").select(
        "media_file_id", "library_id", F.lit("Queued").alias("status"), F.lit("Normal").alias("type"), F.coalesce("priority", F.lit(0)).alias("priority"),
        F.substring("reason", 1, REASON_LENGTH).alias("enqueue_reason"), at.alias("enqueued_at"),
    )
    return made, counts


# What a file is after its content has changed and before it is probed again; other probed facts are null.
RESET = {"status": "Discovered", "media_kind": "Unknown", "attached_picture_count": 0, "max_audio_channels": 0, "is_hdr": False, "is_dolby_vision": False}


def rescanned(current: DataFrame, scanned: DataFrame, facts: Sequence[str]) -> DataFrame:
    """The next state of current (path, relative_path, size_bytes, modified_at, facts) after a scan, with what was done.

    A file whose size or time has changed loses its facts: each is set as RESET says, else to null. A moved one keeps them.
    A new one starts without them, a vanished one is left out.
    """
    content, all_ = ["size_bytes", "modified_at"], ["relative_path", "size_bytes", "modified_at"]
    done = merge.diff(current, scanned, "path", all_).where("action <> 'removed'")
    changed = F.lit(False)
    for c in content:
        changed = changed | ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    kinds = {f.name: f.dataType for f in current.schema}
    joined = done.join(current.select("path", *facts), "path", "left")
    next_ = {c: F.when((F.col("action") == "added") | changed, F.lit(RESET.get(c)).cast(kinds[c])).otherwise(F.col(c)) for c in facts}
    return joined.select("path", *[F.col(f"new_{c}").alias(c) for c in all_], *[v.alias(c) for c, v in next_.items()], "action")
