"""Join shapes: dimensions with defaults, siblings, path prefixes, positions and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scalars import bound


def with_dimension(facts: DataFrame, dimension: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join; columns of the dimension that stay null get their default. Spark broadcasts the dimension if its size allows."""
    joined = facts.join(dimension, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def with_counts(dimension: DataFrame, facts: DataFrame, key: str, counts: dict[str, Column]) -> DataFrame:
    """Each row of the dimension with conditional counts over its facts, 0 where it has none."""
    counted = facts.groupBy(key).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    return dimension.join(counted, key, "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in counts})


def sibling_flag(rows: DataFrame, keys: list[str], marked: Column, flag: str) -> DataFrame:
    """Whether a row that isn't marked has a marked row with equal keys; null keys are equal to each other.

    One shuffle by the keys on the side of the marked rows' distinct keys; rows are joined null-safely.
    """
    others = rows.where(marked).select(*[F.col(k).alias(f"__s_{k}") for k in keys]).distinct().withColumn("__hit", F.lit(True))
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__s_{k}"))
    return rows.join(others, condition, "left").withColumn(flag, ~F.coalesce(marked, F.lit(False)) & F.coalesce("__hit", F.lit(False))).drop("__hit", *[f"__s_{k}" for k in keys])


def path_prefixes(path: Column, separator: str = "/") -> Column:
    """The path and every folder above it."""
    parts = F.split(path, separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))


def under_folders(paths: DataFrame, path: str, folders: DataFrame, folder: str, pick: Column, value: str) -> DataFrame:
    """paths with value: the picked one of the folders that hold it (equal to it or above it), null if none does.

    Each distinct path is exploded into its few prefixes, which makes an equi-join of a containment test, so neither side has
    to be small and no nested loop is needed. What is found is joined back by the path itself, which a lost and recomputed
    task can't change. ``pick`` aggregates over the folders found.
    """
    known = paths.where(F.col(path).isNotNull()).select(F.col(path).alias("__path")).distinct()
    exploded = known.select("__path", F.explode(path_prefixes(F.col("__path"))).alias("__prefix"))
    named = folders.where(F.col(folder) != "").withColumn("__prefix", F.col(folder))
    found = exploded.join(named, "__prefix").groupBy("__path").agg(pick.alias(value))
    return paths.join(found, F.col(path) == F.col("__path"), "left").drop("__path")


def first_difference(expected: Column, actual: Column) -> Column:
    """The first position, from 0, where two lists differ; null if they are equal."""
    zipped = F.zip_with(expected, actual, lambda x, y: ~x.eqNullSafe(y))
    return F.when(~expected.eqNullSafe(actual), F.array_position(zipped, F.lit(True)) - 1)


def without_positions(items: Column, removed: Column) -> Column:
    """items without those whose index, from 0, is in removed."""
    return F.filter(items, lambda x, i: ~F.array_contains(removed, i))


def last_of_keys(entries: Column) -> Column:
    """A map of array<struct<key, value>>; of entries with equal keys the last one counts."""
    last = lambda all_: F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda later: later["key"] == e["key"]))
    return bound(entries, lambda all_: F.map_from_entries(last(all_)))


def tags_preserved(source: Column, output: Column) -> Column:
    """Whether every tag of source is in output with an equal value; keys without regard to case."""
    low = lambda tags: last_of_keys(F.transform(F.map_entries(tags), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    kept = low(output)
    return bound(kept, lambda k: F.forall(F.map_entries(low(source)), lambda e: k[e["key"]].eqNullSafe(e["value"])))
