"""Label and number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(c: Column, labels: list[str]) -> Column:
    """Label of a 0-based code."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), c.cast("int") + 1)


def clock_label(hour: Column) -> Column:
    """5 -> 05:00"""
    return F.format_string("%02d:00", hour.cast("int"))


def short(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def month_prefix(name: Column) -> Column:
    """YYYYMM at the front of a file name."""
    return F.substring(name, 1, 6)


def month_name_key(year: Column, month: Column) -> Column:
    return F.format_string("%d%02d", year.cast("int"), month.cast("int"))


def human(c: Column) -> Column:
    """1234567 -> 1.2M, 45000 -> 45K, 12 -> 12"""
    return (
        F.when(c >= 1e6, F.format_string("%.1fM", c / 1e6))
        .when(c >= 1e3, F.format_string("%.0fK", c / 1e3))
        .otherwise(F.format_string("%.0f", c.cast("double")))
    )


def percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c.cast("double"))


def name_list(c: Column) -> Column:
    """Comma list -> trimmed lower-case array."""
    return F.transform(F.split(c, ","), lambda x: F.lower(F.trim(x)))
