"""Wall-clock functions.

Everything here works on TIMESTAMP_NTZ and gives the same answer under any session time zone.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wall(text: str) -> Column:
    """A literal wall-clock time."""
    return F.lit(text).cast(NTZ)


def parse_wall(c: Column | str) -> Column:
    """Text to wall-clock time; null where the text is not a time."""
    return _col(c).try_cast(NTZ)


def floor_day(c: str) -> Column:
    return F.expr(f"CAST(to_date({c}) AS timestamp_ntz)")


def floor_hour(c: str) -> Column:
    return F.expr(f"CAST(to_date({c}) AS timestamp_ntz) + make_dt_interval(0, hour({c}))")


def floor_to(c: str, grain: str) -> Column:
    return {"hour": floor_hour, "day": floor_day}[grain](c)


def hour_of_day(c: str) -> Column:
    return F.expr(f"CAST(hour({c}) AS tinyint)")


def day_of_week(c: str) -> Column:
    """0 = Monday."""
    return F.expr(f"CAST(weekday({c}) AS tinyint)")


def month(c: str) -> Column:
    return F.expr(f"CAST(month({c}) AS tinyint)")


def is_weekend(c: str) -> Column:
    return F.expr(f"CAST(weekday({c}) >= 5 AS tinyint)")


def _to_utc(c: Column, tz: str) -> Column:
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), c)


def _to_wall(utc: Column, tz: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def is_nonexistent(c: Column | str, tz: str) -> Column:
    """True for wall-clock times the spring shift skips."""
    c = _col(c)
    return _to_wall(_to_utc(c, tz), tz) != c


def is_ambiguous(c: Column | str, tz: str) -> Column:
    """True for wall-clock times the autumn shift repeats: the shift later shows the same clock.

    Clocks shift by an hour, in a few zones by half an hour.
    """
    c = _col(c)
    utc = _to_utc(c, tz)
    hour, half = F.expr("INTERVAL 1 HOUR"), F.expr("INTERVAL 30 MINUTE")
    return (_to_wall(utc + hour, tz) == c) | (_to_wall(utc + half, tz) == c)


def dst_edges(tz: str, lo: str, hi: str) -> list[tuple[str, datetime, datetime]]:
    """Wall-clock intervals [start, end) between two times that a zone skips or repeats."""
    zone = ZoneInfo(tz)

    def offset(instant: datetime) -> timedelta:
        return instant.astimezone(zone).utcoffset()

    day = timedelta(days=1)
    at = datetime.fromisoformat(lo).replace(tzinfo=timezone.utc) - 2 * day
    stop = datetime.fromisoformat(hi).replace(tzinfo=timezone.utc) + 2 * day
    edges = []
    while at < stop:
        before, after = offset(at), offset(at + day)
        if before != after:
            left, right = at, at + day
            while right - left > timedelta(seconds=1):
                middle = left + (right - left) / 2
                left, right = (middle, right) if offset(middle) == before else (left, middle)
            moment = right.replace(microsecond=0, tzinfo=None)
            bounds = sorted([moment + before, moment + after])
            edges.append(("nonexistent" if after > before else "ambiguous", *bounds))
        at += day
    return edges


def within_edges(c: Column | str, edges: list[tuple[str, datetime, datetime]]) -> Column:
    """True inside one of the intervals: plain comparisons, which also reach a Parquet scan."""
    c = _col(c)
    hits = [
        (c >= wall(start.isoformat(" "))) & (c < wall(end.isoformat(" "))) for _, start, end in edges
    ]
    return reduce(Column.__or__, hits, F.lit(False))


def instant_to_wall(c: Column | str, tz: str) -> Column:
    """Text with a UTC offset (or a TIMESTAMP) to the wall clock of ``tz``."""
    seconds = (F.unix_micros(_col(c).cast("timestamp")) / 1_000_000).cast("decimal(18,6)")
    return _to_wall(wall("1970-01-01") + F.make_dt_interval(secs=seconds), tz)


def block_of(c: str, days: int) -> Column:
    """Number of the fixed-length block of days the time falls in, counted from 1970-01-01."""
    return F.expr(f"CAST(floor(unix_date(to_date({c})) / {days}) AS int)")


def split_of(c: str, train_end: str, val_end: str) -> Column:
    """Time split: left-inclusive, right-exclusive bounds."""
    return F.expr(
        f"CASE WHEN {c} < timestamp_ntz'{train_end}' THEN 'train' "
        f"WHEN {c} < timestamp_ntz'{val_end}' THEN 'val' ELSE 'test' END"
    )


def with_offset(c: Column | str, tz: str) -> Column:
    """Wall-clock text with the UTC offset ``tz`` has at that time: 2023-01-01 05:00:00-05:00"""
    c = _col(c)
    gap = c - _to_utc(c, tz)
    minutes = (
        F.extract(F.lit("DAY"), gap) * 1440
        + F.extract(F.lit("HOUR"), gap) * 60
        + F.extract(F.lit("MINUTE"), gap)
    ).cast("int")
    size = F.abs(minutes)
    offset = F.format_string("%02d:%02d", (size / 60).cast("int"), size % 60)
    sign = F.when(minutes < 0, "-").otherwise("+")
    return F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), sign, offset)
