"""Event counts per entity and time step, and the entity dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.functions import clock


def hourly_counts(
    trips: DataFrame,
    key: str = "start_station_id",
    ts: str = "started_at",
    grain: str = "hour",
    out_key: str = "station_id",
    out_ts: str = "datetime",
    out: str = "departures",
) -> DataFrame:
    """Rows per entity and time step. The map-side combine keeps a hot entity cheap.

    Null keys and times are left out. Saying so here, rather than leaving it to the joins that
    follow, gives every consumer of the counts the same plan, so that one exchange serves them all.
    """
    steps = trips.select(F.col(key).alias(out_key), clock.floor_to(ts, grain).alias(out_ts))
    known = steps.where(f"{out_key} IS NOT NULL AND {out_ts} IS NOT NULL")
    return known.groupBy(out_key, out_ts).agg(F.expr(f"count(*) AS {out}"))


def modal_dim(
    trips: DataFrame,
    keys: list[str],
    cols: list[str],
) -> DataFrame:
    """Most frequent value of each column per key group, the columns independently.

    Ties go to the smallest value. Groups with a null key are left out, and so are rows with a null
    in any of the columns. Values are counted before they meet in their group, so a hot group costs
    one row per distinct value and map task.
    """
    axes = ", ".join(f"struct('{c}' AS axis, CAST({c} AS double) AS value)" for c in cols)
    counted = (
        trips.dropna(subset=[*keys, *cols])
        .selectExpr(*keys, f"inline(array({axes}))")
        .groupBy(*keys, "axis", "value")
        .agg(F.expr("count(*) AS n"))
    )
    best = "min(CASE WHEN axis = '{0}' THEN struct(-n AS rank, value) END).value AS {0}"
    return counted.groupBy(*keys).agg(*[F.expr(best.format(c)) for c in cols])


def station_dim(
    trips: DataFrame,
    key: str = "start_station_id",
    name: str = "start_station_name",
    coords: tuple[str, str] = ("start_lat", "start_lng"),
) -> DataFrame:
    """One row per (id, name) with the modal coordinates."""
    return modal_dim(trips, [key, name], list(coords)).withColumnsRenamed(
        {key: "station_id", name: "station_name"}
    )


def one_name_per_key(
    dim: DataFrame, key: str = "station_id", order: str = "station_name"
) -> DataFrame:
    """First row per key in the given order: the dimension that cannot fan out a join."""
    rest = [c for c in dim.columns if c not in (key, order)]
    first = F.min(F.struct(order, *rest)).alias("first")
    return dim.groupBy(key).agg(first).select(key, *[f"first.{c}" for c in [order, *rest]])


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key group in the given order, as an aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    lead = [*order, *[c for c in rest if c not in order]]
    first = F.min(F.struct(*lead)).alias("first")
    return df.groupBy(*keys).agg(first).select(*keys, *[f"first.{c}" for c in rest])


def distinct_on(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Distinct on a subset of columns with a stated survivor."""
    return first_per_key(df, keys, order).select(*df.columns)


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"))
