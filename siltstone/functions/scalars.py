"""Scalar expressions of the inventory domain. All are built-in functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value worked out once a row; a column that is used several times in lambdas is worked out for each use."""
    return F.get(F.transform(F.array(value), f), 0)


def path_stem(path) -> Column:
    """The path without its last extension; a lone trailing dot stays."""
    return F.regexp_replace(path, r"\.[^./\\]+$", "")


def path_extension(path) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def normal_folder(path) -> Column:
    """Forward slashes, none at the end."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+$", "")


def blank_to_null(text) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def clamp(value, low, high) -> Column:
    """Null stays null, though greatest and least skip nulls."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def percent_change(before, after) -> Column:
    return F.when(before > 0, (after - before) / before * 100).otherwise(F.lit(0.0))


def saving_percent(before, after) -> Column:
    return F.when(before > 0, (1 - after / before) * 100).otherwise(F.lit(0.0))


def minute_of_day(ts) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def in_daily_window(minute: Column, start: int, end: int) -> Column:
    """Half open; wraps past midnight if it starts after it ends; equal ends mean always."""
    if start == end:
        return F.lit(True)
    return (minute >= start) & (minute < end) if start < end else (minute >= start) | (minute < end)


def first_match(cases: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first case that holds; a null condition doesn't."""
    out = None
    for condition, name in cases:
        held = F.coalesce(condition, F.lit(False))
        out = F.when(held, name) if out is None else out.when(held, name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    low, out = F.lower(text), F.lit(False)
    for needle in needles:
        out = out | low.contains(needle.lower())
    return out


def trimmed_number(value: Column, digits: int = 1) -> Column:
    """With up to so many decimals, zeros at the end dropped."""
    return F.regexp_replace(F.format_string(f"%.{digits}f", value.cast("double")), r"\.?0+$", "") if digits else F.format_string("%.0f", value.cast("double"))


def human_size(size: Column) -> Column:
    """Binary megabytes, or gigabytes from one on, with up to one decimal."""
    mib = size.cast("double") / (1 << 20)
    return F.when(mib >= 1024, F.concat(trimmed_number(mib / 1024), F.lit(" GB"))).otherwise(F.concat(trimmed_number(mib), F.lit(" MB")))


def duration_text(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60)
    return F.when(minutes >= 60, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m"))).otherwise(F.concat(minutes.cast("string"), F.lit("m")))


def rational(text: Column) -> Column:
    """``24000/1001`` as a number; null if it is none."""
    parts = F.split(text, "/")
    return F.coalesce(F.try_divide(F.try_element_at(parts, F.lit(1)).try_cast("double"), F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("double"), F.when(F.size(parts) == 1, F.lit(1.0)))), F.lit(None).cast("double"))


def alnum_key(text) -> Column:
    """Letters and digits, lower case: for fuzzy equality."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{Nd}]", ""))


def remaining_seconds(duration: Column, elapsed: Column, speed: Column) -> Column:
    left = duration - elapsed
    return F.when(speed > 0, F.when(left > 0, left / speed).otherwise(F.lit(0.0)))
