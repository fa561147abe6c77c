"""Comparing a scan with a table, upserts and cascades: the next state and what was done, as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(current: DataFrame, scanned: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """One row per key of either side with action added, removed, updated or unchanged, and both sides' compared columns."""
    old = current.select(F.col(key), F.lit(True).alias("__old"), *[F.col(c).alias(f"old_{c}") for c in compared])
    new = scanned.select(F.col(key), F.lit(True).alias("__new"), *[F.col(c).alias(f"new_{c}") for c in compared])
    changed = F.lit(False)
    for c in compared:
        changed = changed | ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    action = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(changed, "updated").otherwise("unchanged")
    return old.join(new, key, "full_outer").withColumn("action", action).drop("__old", "__new")


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """target with rows of equal keys replaced by source's, and source's other rows added."""
    return target.join(source, keys, "left_anti").unionByName(source, allowMissingColumns=True)


def delete_cascade(parents: DataFrame, children: DataFrame, key: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both without the rows whose key is in gone."""
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def totals(actions: DataFrame) -> DataFrame:
    """One row: how many keys were added, removed, updated and left unchanged, and how many were seen."""
    return actions.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("added", "removed", "updated", "unchanged")], F.count("*").alias("seen"))
