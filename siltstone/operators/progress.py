"""The key=value protocol of a running transcode as a batch: blocks of lines, progress that never goes back, what is kept.

Lines are rows (job_id, line_no, line, duration), with a total order of line_no in each job. A ``progress`` line ends a
block; lines without ``=`` are passed over, of equal names in a block the last counts. ``piece`` (see ``sequences``) is a
column that never goes back along line_no; with it a job with a large part of all lines is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import sequences

#: Progress of a job that is still running is never all of it; it is kept from the last kept one on in such steps.
MOST, STEP = 0.999, 0.01


def seconds(us: Column, ms: Column, clock: Column) -> Column:
    """Elapsed seconds: two names for microseconds first, then hours, minutes and seconds; null for what says nothing."""
    part = F.regexp_extract(F.trim(clock), r"^(\d+):([0-5]?\d):([0-5]?\d(?:\.\d*)?)$", 0)
    h, m, s = (F.split_part(part, F.lit(":"), F.lit(k)).try_cast("double") for k in (1, 2, 3))
    return F.coalesce(F.trim(us).try_cast("long") / 1e6, F.trim(ms).try_cast("long") / 1e6, F.when(part != "", h * 3600 + m * 60 + s))


def blocks(lines: DataFrame, piece: Column | None = None) -> DataFrame:
    """(job_id, line_no, elapsed, fps, speed, done, duration) for each block that is ended; line_no is that of its last line."""
    split = lines.where(F.contains("line", F.lit("="))).withColumns({"name": F.trim(F.split_part("line", F.lit("="), F.lit(1))), "value": F.trim(F.expr("substr(line, instr(line, '=') + 1)"))})
    numbered = sequences.blocks(split, "job_id", ["line_no"], F.col("name") == "progress", "block", piece)
    last = lambda name: F.max_by("value", F.when(F.col("name") == name, F.col("line_no")))
    names = ["out_time_us", "out_time_ms", "out_time", "fps", "speed", "progress"]
    found = numbered.groupBy("job_id", "block").agg(*[last(n).alias(n) for n in names], F.max("line_no").alias("line_no"), F.max_by("duration", "line_no").alias("duration")).where("progress is not null")
    return found.select(
        "job_id", "line_no", seconds(F.col("out_time_us"), F.col("out_time_ms"), F.col("out_time")).alias("elapsed"), F.col("fps").try_cast("double").alias("fps"),
        F.regexp_replace("speed", "x$", "").try_cast("double").alias("speed"), (F.col("progress") == "end").alias("done"), "duration",
    )


def live(found: DataFrame, piece: Column | None = None) -> DataFrame:
    """(job_id, line_no, progress, fps, speed, remaining, kept) of blocks with a known elapsed time and duration.

    progress is the greatest share so far, within 0 and MOST; kept tells if it is written down: the first above 0, then each
    a STEP above the last one written. A block that is done ends a run: the job's next one starts from nothing.
    """
    runs = sequences.blocks(found, "job_id", ["line_no"], F.col("done"), "run", piece).withColumn("of_run", F.concat_ws("/", F.col("job_id").cast("string"), F.col("run").cast("string")))
    known = runs.where("elapsed is not null and duration > 0")
    share = F.greatest(F.lit(0.0), F.least(F.lit(MOST), F.col("elapsed") / F.col("duration")))
    raised = sequences.high_water(known, "of_run", ["line_no"], share, "progress", piece)
    raised = sequences.checkpointed(raised)
    kept = sequences.emissions(raised, "of_run", ["line_no"], "progress", STEP, piece, eager=True).select("of_run", "line_no", F.lit(True).alias("kept"))
    return raised.join(kept, ["of_run", "line_no"], "left").select(
        "job_id", "line_no", "progress", "fps", "speed", F.when(F.col("speed") > 0, (F.col("duration") - F.col("progress") * F.col("duration")) / F.col("speed")).alias("remaining"), F.coalesce("kept", F.lit(False)).alias("kept")
    )
