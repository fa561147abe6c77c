"""Sequences: regressions, high-water marks, streaks, blocks, counter deltas, heads and tails.

Each is a window over a key; rows of one key are ordered by the given columns, which must be a total order. A window holds
one key in one task, sorted and spilled. Where a key may have a large part of all rows, give ``piece``: a column that never
goes back along the order, such as the day of a time. Each piece of a key is then a task's by itself, and what one piece
leaves to the next is worked out from one row a piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.shared import checkpointed


def in_order(key: str, order: list[str]):
    return Window.partitionBy(key).orderBy(*order)


def places(rows: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """rows, which have their group's group_count, with the place of the group among all; groups are sorted in one task."""
    groups = rows.groupBy(*group).agg(F.first("group_count").alias("group_count"))
    placed = groups.select(*group, F.row_number().over(Window.orderBy(*order)).cast("long").alias(out))
    return rows.join(placed, group)


def _so_far(key: list[str], order: list[str]):
    return Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def carried(rows: DataFrame, key: str, facts: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """rows with the carry columns of their (key, __piece): facts are aggregates of a piece, carry windows over earlier pieces.

    carry is given over rows of (key, __piece, facts) and may use ``earlier``.
    """
    per = rows.groupBy(key, "__piece").agg(*[c.alias(n) for n, c in facts.items()])
    found = per.select(F.col(key).alias("__key"), F.col("__piece").alias("__of"), *[c.alias(n) for n, c in carry.items()])
    return rows.join(found, F.col(key).eqNullSafe(F.col("__key")) & F.col("__piece").eqNullSafe(F.col("__of"))).drop("__key", "__of")


def earlier(key: str, last: int = -1):
    """The window of a key's pieces before one, or up to it with last=0."""
    return Window.partitionBy(key).orderBy("__piece").rowsBetween(Window.unboundedPreceding, last)


def _keys(key: str, piece: Column | None) -> list[str]:
    return [key] if piece is None else [key, "__piece"]


def regressions(rows: DataFrame, key: str, order: list[str], stamp: str, shown: str, piece: Column | None = None) -> DataFrame:
    """Per key: rows, those with a stamp below the last one that wasn't null, the first of them, and the greatest stamp."""
    if piece is not None:
        last = F.max_by(stamp, F.when(F.col(stamp).isNotNull(), F.struct(*order)))
        rows = carried(rows.withColumn("__piece", piece), key, {"__last": last}, {"__carry": F.last("__last", ignorenulls=True).over(earlier(key))})
    before = F.last(stamp, ignorenulls=True).over(Window.partitionBy(*_keys(key, piece)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("__before", before if piece is None else F.coalesce(before, F.col("__carry")))
    marked = marked.withColumn("__back", F.coalesce(F.col(stamp) < F.col("__before"), F.lit(False)))
    return marked.groupBy(key).agg(
        F.count(stamp).alias("n"),
        F.count_if("__back").alias("regressions"),
        F.min_by(shown, F.when(F.col("__back"), F.struct(*order))).alias("first_regression"),
        F.max(stamp).alias("greatest"),
    )


def high_water(rows: DataFrame, key: str, order: list[str], value: Column, out: str, piece: Column | None = None) -> DataFrame:
    """The greatest value so far."""
    local = F.max(value).over(_so_far(_keys(key, piece), order))
    if piece is None:
        return rows.withColumn(out, local)
    rows = carried(rows.withColumn("__piece", piece), key, {"__max": F.max(value)}, {"__carry": F.max("__max").over(earlier(key))})
    return rows.withColumn(out, F.greatest(local, "__carry")).drop("__piece", "__carry")


def streaks(rows: DataFrame, key: str, order: list[str], failed: Column, reset: Column, out: str, piece: Column | None = None) -> DataFrame:
    """Failures in a row: up by one with each, back to zero with a reset, else as before."""
    keys = _keys(key, piece)
    if piece is not None:
        rows = rows.withColumn("__piece", piece)
    islands = rows.withColumn("__island", F.sum(F.when(reset, 1).otherwise(0)).over(_so_far(keys, order)))
    found = islands.withColumn(out, F.sum(F.when(failed, 1).otherwise(0)).over(_so_far([*keys, "__island"], order)))
    if piece is None:
        return found.drop("__island")
    # a piece leaves the streak at its end; one without a reset adds it to what it was left
    facts = {"__end": F.max_by(out, F.struct(*order)), "__reset": F.max("__island") > 0}
    per = found.groupBy(key, "__piece").agg(*[c.alias(n) for n, c in facts.items()])
    run = per.withColumn("__run", F.sum(F.col("__reset").cast("int")).over(earlier(key, 0)))
    total = run.withColumn("__total", F.sum("__end").over(Window.partitionBy(key, "__run").orderBy("__piece").rowsBetween(Window.unboundedPreceding, 0)))
    left = total.select(F.col(key).alias("__key"), F.col("__piece").alias("__of"), F.coalesce(F.lag("__total").over(Window.partitionBy(key).orderBy("__piece")), F.lit(0)).alias("__carry"))
    joined = found.join(left, F.col(key).eqNullSafe(F.col("__key")) & F.col("__piece").eqNullSafe(F.col("__of")))
    return joined.withColumn(out, F.col(out) + F.when(F.col("__island") == 0, F.col("__carry")).otherwise(0)).drop("__island", "__piece", "__key", "__of", "__carry")


def blocks(rows: DataFrame, key: str, order: list[str], ends: Column, out: str, piece: Column | None = None) -> DataFrame:
    """Number, from 0, of the block that each row is in; a row that ends a block is its last."""
    ended = F.when(ends, 1).otherwise(0)
    before = Window.partitionBy(*_keys(key, piece)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum(ended).over(before), F.lit(0))
    if piece is None:
        return rows.withColumn(out, local)
    rows = carried(rows.withColumn("__piece", piece), key, {"__ends": F.sum(ended)}, {"__carry": F.coalesce(F.sum("__ends").over(earlier(key)), F.lit(0))})
    return rows.withColumn(out, local + F.col("__carry")).drop("__piece", "__carry")


def utilisation(rows: DataFrame, key: str, order: list[str], total: str, idle: str, out: str) -> DataFrame:
    """Busy share of each step of cumulative counters, in percent; 0 where the total doesn't grow, null at the first."""
    w = Window.partitionBy(key).orderBy(*order)
    dt, di = F.col(total) - F.lag(total).over(w), F.col(idle) - F.lag(idle).over(w)
    busy = F.when(dt > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.try_divide(dt - di, dt) * 100))).when(dt.isNotNull(), F.lit(0.0))
    return rows.withColumn(out, busy)


def head_and_tail(rows: DataFrame, key: str, order: list[str], head: int, tail: int) -> DataFrame:
    """The first and last rows of each key, with their number and how many between are left out."""
    w = Window.partitionBy(key)
    numbered = rows.withColumn("line_no", F.row_number().over(w.orderBy(*order))).withColumn("lines", F.count("*").over(w))
    kept = numbered.where((F.col("line_no") <= head) | (F.col("line_no") > F.col("lines") - tail))
    return kept.withColumn("elided", F.greatest(F.col("lines") - head - tail, F.lit(0).cast("long")))


def emitted_changes(values: Column, step: float) -> Column:
    """Of a list of values, those at least step above the last one that was taken; the first counts from 0."""
    start = F.struct(F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(values, start, lambda s, v: F.when(v >= s["last"] + step, F.struct(v.alias("last"), F.concat(s["out"], F.array(v)).alias("out"))).otherwise(s), lambda s: s["out"])


def records(rows: DataFrame, key: str, order: list[str], value: str, piece: Column | None = None) -> DataFrame:
    """The rows whose value is above all values before; those without a key or a finite value are passed over."""
    known = rows.where(F.col(key).isNotNull() & (F.abs(value) < float("inf")))  # a NaN is above all numbers
    before = F.max(value).over(Window.partitionBy(*_keys(key, piece)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    if piece is not None:
        known = carried(known.withColumn("__piece", piece), key, {"__max": F.max(value)}, {"__carry": F.max("__max").over(earlier(key))})
        before = F.greatest(before, "__carry")
    return known.withColumn("__before", before).where(F.col("__before").isNull() | (F.col(value) > F.col("__before"))).drop("__before", "__piece", "__carry")


def next_jumps(values: DataFrame, step: float) -> DataFrame:
    """(key, value, next): for each (key, value) of a key's growing values the first that is at least value + step, or null.

    Values are dealt to buckets a step wide: the next one is in the bucket of value + step, or else the least of the next
    bucket that has any. So what is sorted together is one bucket of a key, and one row for each of a key's buckets.
    """
    bucket = lambda x: F.floor(x / step)
    at = values.select("key", bucket(F.col("value")).alias("bucket"), F.col("value").alias("x"), F.col("value").alias("there"), F.lit(None).cast("double").alias("value"))
    asked = values.select("key", bucket(F.col("value") + step).alias("bucket"), (F.col("value") + step).alias("x"), F.lit(None).cast("double").alias("there"), "value")
    within = Window.partitionBy("key", "bucket").orderBy("x", F.col("there").asc_nulls_first()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = at.unionByName(asked).withColumn("near", F.min("there").over(within)).where(F.col("there").isNull())
    # the least value of each bucket, and of the next that has any, for the buckets that are asked for
    least = at.groupBy("key", "bucket").agg(F.min("there").alias("least")).unionByName(asked.select("key", "bucket", F.lit(None).cast("double").alias("least"))).groupBy("key", "bucket").agg(F.min("least").alias("least"))
    later = least.select("key", "bucket", F.min("least").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    return found.join(later, ["key", "bucket"]).select("key", "value", F.coalesce("near", "later").alias("next"))


def emissions(rows: DataFrame, key: str, order: list[str], value: str, step: float, piece: Column | None = None, eager: bool = False) -> DataFrame:
    """The rows whose value is at least a step above the last one emitted for their key, which starts at 0.

    With eager, the first one only has to be above 0. A row that is emitted is above all before it, so the question is put
    to those rows alone. Each points to the next that is a step above it; from the start, the places that 1, 2, 4, ...
    jumps lead to are joined until no jump is left. Each doubling is a shuffle by key and value, cut off by a checkpoint;
    there are as many as the logarithm of the most rows emitted for one key. With ``piece`` (see above) a key with a large
    part of all rows is split everywhere. Rows without a key or a finite value are passed over. step is above 0.
    """
    columns = list(dict.fromkeys([key, *order, value]))
    above = records(rows.select(*columns), key, order, value, piece).where(F.col(value) > 0 if eager else F.col(value) >= step)
    above = checkpointed(above.withColumn("__value", F.col(value).cast("double")))
    values = above.select(F.col(key).alias("key"), F.col("__value").alias("value"))
    jumps = checkpointed(next_jumps(values, step).where("next is not null"))
    reached = values.groupBy("key").agg(F.min("value").alias("value"))
    while True:
        # what is reached by up to 2^k jumps, and by one more leap of 2^k from there
        reached = checkpointed(reached.unionByName(reached.join(jumps, ["key", "value"]).select("key", F.col("next").alias("value"))))
        jumps = checkpointed(jumps.join(jumps.select("key", F.col("value").alias("next"), F.col("next").alias("__next")), ["key", "next"]).select("key", "value", F.col("__next").alias("next")))
        if jumps.isEmpty():
            break
    reached = reached.select(F.col("key").alias("__key"), F.col("value").alias("__reached"))
    return above.join(reached, (F.col(key) == F.col("__key")) & (F.col("__value") == F.col("__reached")), "left_semi").select(*columns)
