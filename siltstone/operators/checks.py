"""Verification reports: a list of named checks, those that apply, with an outcome and a detail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: name, passed, detail, and whether it applies (None: always)
Check = tuple[str, Column, Column, Column | None]


def check(name: str, passed: Column, detail: Column, applies: Column | None = None) -> Column:
    """A struct, or null where the check doesn't apply. An unknown condition fails."""
    outcome = F.when(F.coalesce(passed, F.lit(False)), "Passed").otherwise("Failed")
    made = F.struct(F.lit(name).alias("name"), outcome.alias("outcome"), detail.cast("string").alias("detail"))
    return made if applies is None else F.when(F.coalesce(applies, F.lit(False)), made)


def report(*checks: Column) -> Column:
    return F.filter(F.array(*checks), lambda c: c.isNotNull())


def all_passed(checks: Column) -> Column:
    """True for a report without checks, too."""
    return F.forall(checks, lambda c: c["outcome"] == "Passed")


def failed_names(checks: Column) -> Column:
    return F.transform(F.filter(checks, lambda c: c["outcome"] == "Failed"), lambda c: c["name"])


def failed_text(checks: Sequence[Check], separator: str = ", ") -> Column:
    """``failed_names`` of a report as one text, without the report: no detail is worked out, and the code is generated."""
    failed = lambda name, passed: F.when(~F.coalesce(passed, F.lit(False)), name)
    return F.concat_ws(separator, *[failed(name, passed) if applies is None else F.when(F.coalesce(applies, F.lit(False)), failed(name, passed)) for name, passed, _, applies in checks])


def first_failure(rules: Sequence[tuple[Column, str]]) -> Column:
    """The message of the first rule that doesn't hold, or is unknown; null if all hold."""
    out = F.lit(None).cast("string")
    for holds, message in reversed(rules):
        out = F.when(~F.coalesce(holds, F.lit(False)), message).otherwise(out)
    return out


def outcomes(rows: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """(name, outcome, n, keys): how often each named check of column checks had each outcome, and in how many keys.

    Rows become counts by key first, two numbers a check, so distinct keys are counted without a shuffle of their own.
    """
    kinds = [(name, outcome) for name in names for outcome in ("Passed", "Failed")]
    number = F.create_map(*[F.lit(x) for k, kind in enumerate(kinds) for x in ("\0".join(kind), k)])
    flat = rows.select(key, F.explode(F.transform("checks", lambda c: F.try_element_at(number, F.concat_ws("\0", c["name"], c["outcome"])))).alias("__k"))
    per_key = flat.groupBy(key).agg(*[F.count_if(F.col("__k") == k).alias(f"__{k}") for k in range(len(kinds))])
    total = per_key.agg(*[c for k in range(len(kinds)) for c in (F.coalesce(F.sum(f"__{k}"), F.lit(0)).alias(f"n{k}"), F.count_if(F.col(f"__{k}") > 0).alias(f"k{k}"))])
    listed = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(outcome).alias("outcome"), F.col(f"n{k}").alias("n"), F.col(f"k{k}").alias("keys")) for k, (name, outcome) in enumerate(kinds)])
    return total.select(F.inline(listed)).where("n > 0")
