"""Optional predicates, searches and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def conjunction(conditions: Sequence[Column | None]) -> Column:
    """All conditions that are given; true if none is."""
    out = F.lit(True)
    for condition in conditions:
        if condition is not None:
            out = out & condition
    return out


def member(column: str, given: str | None, allowed: Sequence[str]) -> Column | None:
    """Equality with the allowed value that is given, without regard to case; an error that lists the allowed ones for another."""
    if given is None:
        return None
    found = next((a for a in allowed if a.lower() == given.strip().lower()), None)
    if found is None:
        raise ValueError(f"{given!r} is none of: {', '.join(allowed)}")
    return F.col(column) == found


def search(column: str, term: str | None) -> Column | None:
    """Case-insensitive substring; % and _ in the term are wildcards. No condition for a blank term."""
    return F.col(column).ilike(f"%{term.strip()}%") if term and term.strip() else None


def time_range(column: Column, start=None, end=None) -> Column:
    """Inclusive, open where an end isn't given."""
    return conjunction([None if start is None else column >= F.lit(start), None if end is None else column <= F.lit(end)])


def verdict(column: Column, wanted: str) -> Column:
    """all, eligible, skipped, or unprobed (null)."""
    return {"all": F.lit(True), "eligible": F.coalesce(column, F.lit(False)), "skipped": F.coalesce(~column, F.lit(False)), "unprobed": column.isNull()}[wanted]


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page number (from 1) of size rows; size 0 is everything. A top-k plan, so no global sort of all rows in one task.

    A task holds the rows of all pages up to the one asked for, so deep pages are read with ``after`` or ``deep_page`` instead.
    """
    ordered = df.orderBy(*order)
    return ordered if size == 0 else ordered.offset((max(1, number) - 1) * size).limit(size)


def after(df: DataFrame, order: Sequence[str], last: Sequence[object] | None, size: int) -> DataFrame:
    """The next size rows in ascending order of columns without nulls, after the values of the last row seen; no row before is kept."""
    if last is not None:
        beyond = F.lit(False)
        for k in range(len(order)):
            equal = conjunction([F.col(c) == F.lit(v) for c, v in zip(order[:k], last[:k])])
            beyond = beyond | (equal & (F.col(order[k]) > F.lit(last[k])))
        df = df.where(beyond)
    return df.orderBy(*order).limit(size)


def _before(order: Sequence[tuple[str, bool]], row: Row, or_equal: bool) -> Column:
    """If a row comes before another one in an order of (column, ascending); nulls come first upwards and last downwards."""
    earlier, equal = F.lit(False), F.lit(True)
    for name, up in order:
        column, value = F.col(name), row[name]
        if value is None:
            less = F.lit(False) if up else column.isNotNull()
        else:
            less = F.coalesce(column < F.lit(value), F.lit(True)) if up else F.coalesce(column > F.lit(value), F.lit(False))
        earlier, equal = earlier | (equal & less), equal & column.eqNullSafe(F.lit(value))
    return earlier | equal if or_equal else earlier


def ranges(df: DataFrame, order: Sequence[tuple[str, bool]], parts: int) -> list[Row]:
    """(first, last, n) of each of about so many ranges that df's rows fall into by order, in order; a row a range on the driver."""
    by = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    entry = F.struct(*[c for c, _ in order])
    sorted_parts = df.select(*[c for c, _ in order]).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    per = sorted_parts.groupBy(F.spark_partition_id().alias("part")).agg(F.first(entry).alias("first"), F.last(entry).alias("last"), F.count("*").alias("n"))
    return per.orderBy("part").collect()


def deep_page(df: DataFrame, order: Sequence[tuple[str, bool]], number: int, size: int, parts: int = 200) -> DataFrame:
    """Page number (from 1) of size rows, however deep; size 0 is everything. order: (column, ascending), a total order.

    The order's columns are dealt to ranges, and the ranges counted; prefix sums of the counts tell which ranges hold the
    page, and only their rows are read again, by a filter that reaches the scan, and sorted. So no task holds the pages
    before. Size 0 is sorted by ranges, without one task that sees all. An empty or too deep page has no rows.
    """
    by = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    if size == 0:
        return df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    start, seen, held = (max(1, number) - 1) * size, 0, []
    for row in ranges(df, order, parts):
        if seen < start + size and seen + row["n"] > start:
            held.append((seen, row))
        seen += row["n"]
    if not held:
        return df.limit(0)
    inside = ~_before(order, held[0][1]["first"], False) & _before(order, held[-1][1]["last"], True)
    # the leading column by itself, which a scan can skip blocks by
    (name, up), bounds = order[0], [held[0][1]["first"][order[0][0]], held[-1][1]["last"][order[0][0]]]
    if None not in bounds:
        low, high = bounds if up else bounds[::-1]
        inside = inside & F.col(name).between(F.lit(low), F.lit(high))
    return df.where(inside).orderBy(*by).offset(start - held[0][0]).limit(size)
