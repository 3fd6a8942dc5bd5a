"""Small formatting and conversion expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_contains(col: Column, token: str) -> Column:
    return F.lower(col).contains(token.lower())


def formatted(pattern: str, *cols: Column) -> Column:
    """``format_string`` that is null, not the text "null", when a value is missing."""
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
    return F.when(known, F.format_string(pattern, *cols))


def percent_text(col: Column, digits: int = 2) -> Column:
    return formatted(f"%.{digits}f%%", col * F.lit(100.0))


def fixed_text(col: Column, digits: int = 4) -> Column:
    return formatted(f"%.{digits}f", col)


def joined(col: Column, sep: str = ", ") -> Column:
    return F.array_join(col, sep)


def strip_prefix(col: Column, prefix: str = "model__") -> Column:
    return F.regexp_replace(col, f"^{prefix}", "")


def seconds_between(start: Column, end: Column) -> Column:
    """Exact difference in seconds, fractions kept."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(1_000_000.0)


def hours_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / F.lit(3600.0)


def minutes_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / F.lit(60.0)


def max_of(col: Column) -> Column:
    return F.array_max(col)


def max_abs(col: Column) -> Column:
    return F.array_max(F.transform(col, F.abs))


def flattened(col: Column) -> Column:
    return F.flatten(col)


def records_json(records: Column) -> Column:
    return F.to_json(records)
