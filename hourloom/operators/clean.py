"""Row filters of the raw event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.functions import clock


def valid_trips(df: DataFrame, ts: str = "started_at", key: str = "start_station_id") -> DataFrame:
    """Read the time column as wall clock and drop rows without a time or a key."""
    if df.schema[ts].dataType != T.TimestampNTZType():
        df = df.withColumn(ts, clock.parse_wall(ts))
    return df.dropna(subset=[ts, key])


def in_span(ts: str, lo: str, hi: str) -> Column:
    return F.expr(f"{ts} BETWEEN timestamp_ntz'{lo}' AND timestamp_ntz'{hi}'")


def between_times(df: DataFrame, lo: str, hi: str, ts: str = "started_at") -> DataFrame:
    """Both bounds belong to the range."""
    return df.where(in_span(ts, lo, hi))


def drop_dst_edges(
    df: DataFrame,
    tz: str,
    ts: str = "started_at",
    lo: str | None = None,
    hi: str | None = None,
) -> DataFrame:
    """Drop wall-clock times that name no instant or two instants in ``tz``.

    When the times are known to lie between ``lo`` and ``hi``, the few clock changes of that range
    are looked up once and rows are only compared with them; else every row is converted.
    """
    if lo and hi:
        return df.where(~clock.within_edges(ts, clock.dst_edges(tz, lo, hi)))
    return df.where(~(clock.is_nonexistent(ts, tz) | clock.is_ambiguous(ts, tz)))


def dst_edge_report(df: DataFrame, tz: str, ts: str = "started_at") -> DataFrame:
    """How many rows ``drop_dst_edges`` keeps and why it drops the others, in one pass."""
    state = (
        F.when(clock.is_nonexistent(ts, tz), "nonexistent")
        .when(clock.is_ambiguous(ts, tz), "ambiguous")
        .otherwise("kept")
    )
    return df.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def for_split(df: DataFrame, *splits: str) -> DataFrame:
    """Rows of the named splits; prunes partitions when the table is partitioned by split."""
    return df.where(F.col("split").isin(*splits))
