"""Joins with dimensions. Broadcasts are asked for only where the row bound is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.operators.counts import one_name_per_key

# A side may be broadcast by hint up to this many rows; beyond it the planner decides from sizes.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast when the caller's row bound is small, else leave the join to the planner."""
    return F.broadcast(df) if max_rows <= BROADCAST_ROWS else df


def join_dim(
    facts: DataFrame, dim: DataFrame, key: str = "station_id", dedupe: bool = True
) -> DataFrame:
    """Left join with the entity dimension.

    ``dedupe=False`` joins every (id, name) row, so a renamed entity multiplies its fact rows.
    The dimension grows with the data, hence no hint.
    """
    return facts.join(one_name_per_key(dim, key) if dedupe else dim, key, "left")


def fan_out_report(
    dim: DataFrame, key: str = "station_id", name: str = "station_name"
) -> DataFrame:
    """Entities with more than one name."""
    return (
        dim.groupBy(key)
        .agg(
            F.count("*").alias("n_names"),
            F.min(name).alias("kept_name"),
            F.max(name).alias("last_name"),
        )
        .where("n_names > 1")
    )


def join_hourly(
    df: DataFrame, hours: DataFrame, ts: str = "datetime", max_rows: int | None = None
) -> DataFrame:
    """Left join with a table of one row per time step."""
    side = hours if max_rows is None else bounded(hours, max_rows)
    return df.join(side, ts, "left")


def flag_dates(
    df: DataFrame,
    dates: DataFrame,
    ts: str = "datetime",
    date: str = "date",
    flag: str = "is_holiday",
) -> DataFrame:
    """1 where the row's date is in the table of dates, else 0."""
    marks = dates.select(F.col(date).alias("_date")).distinct().withColumn("_hit", F.lit(1))
    return (
        df.join(marks, F.to_date(F.col(ts)) == F.col("_date"), "left")
        .withColumn(flag, F.coalesce("_hit", F.lit(0)))
        .drop("_date", "_hit")
    )


def on_dates(
    df: DataFrame, dates: DataFrame, ts: str = "datetime", date: str = "date"
) -> DataFrame:
    """Only the rows whose date is in the table of dates."""
    days = dates.select(F.col(date).alias("_date"))
    return df.join(days, F.to_date(F.col(ts)) == F.col("_date"), "left_semi")


def with_labels(
    df: DataFrame, labels: dict[str, str], code: str = "feature", out: str = "label"
) -> DataFrame:
    """Display name of a code; a code without one keeps itself."""
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return df.withColumn(out, F.coalesce(F.element_at(F.create_map(*pairs), F.col(code)), code))


def with_label_table(
    df: DataFrame, labels: DataFrame, code: str = "feature", label: str = "label"
) -> DataFrame:
    """As ``with_labels``, from a table of (code, label)."""
    return df.join(labels.select(code, label), code, "left").withColumn(
        label, F.coalesce(F.col(label), F.col(code).cast("string"))
    )
