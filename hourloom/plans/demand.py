"""Event log -> hourly demand -> features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom import schema as S
from hourloom.functions import clock
from hourloom.operators.clean import between_times, drop_dst_edges, valid_trips
from hourloom.operators.counts import hourly_counts, one_name_per_key, station_dim
from hourloom.operators.fill import forward_fill
from hourloom.operators.joins import flag_dates, join_dim, join_hourly
from hourloom.operators.panel import Span, dense_panel, join_span

LAGS = (1, 2, 24)


def clean(trips: DataFrame, lo: str, hi: str, tz: str | None) -> DataFrame:
    """Trips with a usable time and key, inside the closed range."""
    kept = between_times(valid_trips(trips), lo, hi)
    return drop_dst_edges(kept, tz, lo=lo, hi=hi) if tz else kept


def keys_of(counts: DataFrame, key: str = "station_id", value: str = "departures") -> DataFrame:
    """Entities with at least one event. Reads the counts as they are, so their exchange is shared."""
    return counts.groupBy(key).agg(F.expr(f"sum({value}) AS _n")).where("_n > 0").select(key)


def hours_of(counts: DataFrame, ts: str = "datetime", value: str = "departures") -> DataFrame:
    """Time steps with at least one event anywhere."""
    return counts.groupBy(ts).agg(F.expr(f"sum({value}) AS _n")).where("_n > 0").select(ts)


def hour_dim(hours: DataFrame, weather: DataFrame, holidays: DataFrame) -> DataFrame:
    """Weather and holiday flag per time step; gaps in the weather take the step before."""
    joined = join_hourly(hours, weather)
    filled = forward_fill(joined, "datetime", S.WEATHER_COLS)
    return flag_dates(filled, holidays)


def hourly_demand(
    counts: DataFrame,
    dim: DataFrame,
    weather: DataFrame,
    holidays: DataFrame,
    span: Span,
    dedupe: bool = True,
) -> DataFrame:
    """Departures per station and hour with place, weather and holiday flag.

    ``counts`` are the station-hours with departures, ``dim`` the (id, name) dimension.
    """
    hours = hour_dim(hours_of(counts), weather, holidays)
    placed = join_dim(counts, dim, dedupe=dedupe)
    return join_span(placed, hours, span).select(*S.HOURLY_DEMAND.names)


def calendar_columns(df: DataFrame, ts: str = "datetime") -> DataFrame:
    return df.withColumns(
        {
            "hour_of_day": clock.hour_of_day(ts),
            "day_of_week": clock.day_of_week(ts),
            "month": clock.month(ts),
            "is_weekend": clock.is_weekend(ts),
        }
    )


def feature_panel(
    stations: DataFrame,
    counts: DataFrame,
    hours: DataFrame,
    span: Span,
    train_end: str,
    val_end: str,
    lags: tuple[int, ...] = LAGS,
) -> DataFrame:
    """Dense panel with hour attributes, calendar columns, lags and split.

    ``stations`` has one row per station, ``hours`` one row per hour with weather and holiday flag.
    """
    panel = dense_panel(stations, counts, span, lags=lags)
    return calendar_columns(join_span(panel, hours, span)).withColumn(
        "split", clock.split_of("datetime", train_end, val_end)
    )


def features(
    counts: DataFrame,
    dim: DataFrame,
    weather: DataFrame,
    holidays: DataFrame,
    span: Span,
    train_end: str,
    val_end: str,
    filled: bool = False,
) -> DataFrame:
    """Features from station-hour counts and the (id, name) dimension.

    Stations, hours and panel all start from the one exchange of the counts. ``filled`` gives the
    table a model reads: hour attributes without gaps. The fill runs over hours, where it costs
    nothing, and comes before the split, so reading one split stays a matter of partition pruning.
    """
    stations = join_dim(keys_of(counts), dim)
    hours = hour_dim(hours_of(counts), weather, holidays)
    if filled:
        hours = filled_hours(hours, span)
    return feature_panel(stations, counts, hours, span, train_end, val_end)


def features_from_trips(
    trips: DataFrame,
    weather: DataFrame,
    holidays: DataFrame,
    span: Span,
    train_end: str,
    val_end: str,
    filled: bool = False,
) -> DataFrame:
    """Features from clean trips. The log is scanned for the counts and for the dimension."""
    return features(
        hourly_counts(trips), station_dim(trips), weather, holidays, span, train_end, val_end, filled
    )


def features_from_hourly(hourly: DataFrame, span: Span, train_end: str, val_end: str) -> DataFrame:
    """Features from a stored hourly table."""
    stations = one_name_per_key(
        hourly.select("station_id", "station_name", "start_lat", "start_lng")
    )
    hours = hourly.groupBy("datetime").agg(*[F.min(c).alias(c) for c in S.HOUR_COLS])
    counts = hourly.select("station_id", "datetime", "departures")
    return feature_panel(stations, counts, hours, span, train_end, val_end)


def filled_hours(hours: DataFrame, span: Span, lags: tuple[int, ...] = LAGS) -> DataFrame:
    """Hour attributes for every step that has lags: last known value, 0 before the first one."""
    all_steps = span.hours(hours).where(f"datetime >= {span.first} + {span.steps(max(lags))}")
    return forward_fill(join_hourly(all_steps, hours), "datetime", S.HOUR_COLS, default=0)


def refill(features: DataFrame, span: Span) -> DataFrame:
    """Replace the hour attributes of a feature table by their filled values.

    The attributes are the same for all stations, so the fill runs over hours, not over rows.
    """
    hours = features.groupBy("datetime").agg(*[F.min(c).alias(c) for c in S.HOUR_COLS])
    return join_span(features.drop(*S.HOUR_COLS), filled_hours(hours, span), span)


def cast_features(df: DataFrame, features: list[str] = S.FEATURES) -> DataFrame:
    """Model inputs as single-precision numbers."""
    return df.withColumns({c: F.col(c).cast("float") for c in features})
