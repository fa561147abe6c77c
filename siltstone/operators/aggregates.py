"""Aggregates: weighted and harmonic means, common values, samples of groups, counters that don't go below zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weight_of(frames: Column) -> Column:
    """At least 1; 1 where unknown."""
    return F.greatest(F.coalesce(frames, F.lit(1)), F.lit(1))


def weighted_mean(value: Column, frames: Column) -> Column:
    """Null values don't count."""
    w = weight_of(frames)
    return F.try_divide(F.sum(value * w), F.sum(F.when(value.isNotNull(), w)))


def harmonic_mean(value: Column, frames: Column) -> Column:
    """Weighted, over values above zero."""
    w = F.when(value > 0, weight_of(frames))
    return F.try_divide(F.sum(w), F.sum(F.try_divide(w, value)))


def guarded_mean(value: Column, frames: Column) -> Column:
    """Weighted if every row has frames, else plain."""
    return F.when(F.bool_and(F.coalesce(frames > 0, F.lit(False))), F.try_divide(F.sum(value * frames), F.sum(F.when(value.isNotNull(), frames)))).otherwise(F.avg(value))


def common_value(text: Column) -> Column:
    """The only value that isn't blank, else null."""
    kept = F.nullif(F.trim(text), F.lit(""))
    return F.when(F.min(kept) == F.max(kept), F.min(kept))


def with_samples(rows: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """The first rows of each group, with their place and the group's count; two shuffles at most, by the group.

    A group-limited window keeps ``most`` rows of each group and task before the shuffle, so a hot group is small by then.
    """
    counts = rows.groupBy(group).agg(F.count("*").alias("group_count"))
    ranked = rows.withColumn("sample", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("sample") <= most)
    return ranked.join(counts, group)


def clamped_counter(rows: DataFrame, key: str, order: list[str], delta: str, out: str, piece: Column | None = None) -> DataFrame:
    """A running sum that is set to zero whenever it would be less: the sum less the least sum so far, if below zero.

    piece is as in ``sequences``: for keys that may have a large part of all rows.
    """
    keys = [key] if piece is None else [key, "__piece"]
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if piece is not None:
        rows = rows.withColumn("__piece", piece)
    summed = rows.withColumn("__sum", F.sum(delta).over(so_far)).withColumn("__least", F.min("__sum").over(so_far))
    if piece is not None:
        per = summed.groupBy(key, "__piece").agg(F.sum(delta).alias("__all"), F.min("__sum").alias("__low"))
        before = Window.partitionBy(key).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
        start = per.withColumn("__start", F.coalesce(F.sum("__all").over(before), F.lit(0)))
        left = start.select(F.col(key).alias("__key"), F.col("__piece").alias("__of"), "__start", F.min(F.col("__start") + F.col("__low")).over(before).alias("__before"))
        joined = summed.join(left, F.col(key).eqNullSafe(F.col("__key")) & F.col("__piece").eqNullSafe(F.col("__of")))
        summed = joined.withColumn("__least", F.least(F.col("__start") + F.col("__least"), "__before")).withColumn("__sum", F.col("__start") + F.col("__sum"))
    return summed.withColumn(out, F.col("__sum") - F.least(F.lit(0), F.col("__least"))).select(*[c for c in rows.columns if c != "__piece"], out)


def combined_windows(windows: DataFrame, key: str, order: str, keys: DataFrame | None = None, sampling: Column | None = None) -> DataFrame:
    """One row per key of quality windows (measured, error, mean, harmonic, least, p5, frames, model): all in one, or why not.

    The first window that was not measured, in order, fails the whole with its error. The tail is the weakest window's: the
    least of the least scores and of the fifth percentiles, which can't be pooled from summaries. With keys, a table with
    key, those without a window are rows that failed. With sampling, the text that says how windows were chosen, windows
    have (psnr, ssim, preprocessing) too: their means, and what they have in common before that text.
    """
    bad = ~F.coalesce(F.col("measured"), F.lit(False))
    first_bad = F.min_by(F.struct(F.coalesce("error", F.lit("A VMAF sample produced no usable score.")).alias("error")), F.when(bad, F.col(order)))["error"]
    scores = {"mean": weighted_mean(F.col("mean"), F.col("frames")), "harmonic": harmonic_mean(F.col("harmonic"), F.col("frames")), "least": F.min("least"), "p5": F.min("p5"), "model": common_value(F.col("model")), "frames": F.sum(F.coalesce("frames", F.lit(0)))}
    if sampling is not None:
        scores |= {n: weighted_mean(F.col(n), F.col("frames")) for n in ("psnr", "ssim")}
        scores["preprocessing"] = F.concat_ws("; ", common_value(F.col("preprocessing")), F.max(sampling))
    found = windows.groupBy(key).agg(F.bool_or(bad).alias("__bad"), first_bad.alias("error"), *[c.alias(n) for n, c in scores.items()])
    if keys is not None:
        found = keys.select(key).distinct().join(found, key, "left").withColumn("error", F.when(F.col("__bad").isNull(), "No VMAF samples were measured.").otherwise(F.col("error")))
    ok = ~F.coalesce("__bad", F.lit(True))
    return found.select(key, ok.alias("measured"), F.when(~ok, F.col("error")).alias("error"), *[F.when(ok, F.col(n)).alias(n) for n in scores])


def exact_percentile(rows: DataFrame, keys: list[str], value: str, share: float, out: str, bins: int = 4096) -> DataFrame:
    """keys with the share's percentile of value, linear between neighbours as ``percentile`` has it; null values don't count.

    ``percentile`` holds all distinct values of a group in one buffer. Here each group's range is cut into bins, which are
    counted; only rows of the one or two bins that hold the ranks asked for go on, as counted values, to be ranked.
    """
    some = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    ends = some.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    same = lambda names: [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in names]
    joined = some.alias("l").join(ends.alias("r"), same(keys)).select("l.*", *[f"r.{c}" for c in ("__n", "__low", "__high")])
    width = F.col("__high") - F.col("__low")
    binned = joined.withColumn("__bin", F.when(width > 0, F.least(F.floor((F.col("__v") - F.col("__low")) / width * bins), F.lit(bins - 1))).otherwise(0))
    rank = (F.col("__n") - 1) * F.lit(share)
    low, high = F.floor(rank), F.ceil(rank)
    counted = binned.groupBy(*keys, "__bin").agg(F.count("*").alias("__in"), F.first("__n").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("__in").over(before), F.lit(0))
    wanted = counted.withColumn("__start", start).where((F.col("__start") <= high) & (F.col("__start") + F.col("__in") > low))
    few = binned.alias("l").join(wanted.alias("r"), same([*keys, "__bin"])).select("l.*", "r.__start")
    values = few.groupBy(*keys, "__bin", "__start", "__n", "__v").agg(F.count("*").alias("__in"))
    inside = Window.partitionBy(*keys, "__bin").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("__start") + F.coalesce(F.sum("__in").over(inside), F.lit(0))
    ranked = values.withColumn("__first", first)
    at = lambda r: F.max(F.when((F.col("__first") <= r) & (F.col("__first") + F.col("__in") > r), F.col("__v")))
    both = ranked.groupBy(*keys, "__n").agg(at(low).alias("__a"), at(high).alias("__b"))
    return both.select(*keys, (F.col("__a") + (F.col("__b") - F.col("__a")) * (rank - low)).alias(out))
