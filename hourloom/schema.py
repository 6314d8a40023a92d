"""Schemas, column lists and settings of the demand panel."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TRIPS = _struct(
    ride_id=T.StringType(),
    started_at=T.TimestampNTZType(),
    start_station_id=T.StringType(),
    start_station_name=T.StringType(),
    start_lat=T.DoubleType(),
    start_lng=T.DoubleType(),
)

WEATHER = _struct(
    datetime=T.TimestampNTZType(),
    temperature=T.DoubleType(),
    precipitation=T.DoubleType(),
    snowfall=T.DoubleType(),
    snow_depth=T.DoubleType(),
)

HOLIDAYS = _struct(date=T.DateType(), holiday_name=T.StringType())

HOURLY_DEMAND = _struct(
    station_id=T.StringType(),
    station_name=T.StringType(),
    start_lat=T.DoubleType(),
    start_lng=T.DoubleType(),
    datetime=T.TimestampNTZType(),
    departures=T.LongType(),
    temperature=T.DoubleType(),
    precipitation=T.DoubleType(),
    snowfall=T.DoubleType(),
    snow_depth=T.DoubleType(),
    is_holiday=T.IntegerType(),
)

METRICS = _struct(
    model=T.StringType(), split=T.StringType(), rmse=T.DoubleType(), mae=T.DoubleType()
)

CURVE = _struct(
    model=T.StringType(),
    fraction=T.DoubleType(),
    n_rows=T.LongType(),
    val_rmse=T.DoubleType(),
    test_rmse=T.DoubleType(),
    elapsed_s=T.DoubleType(),
)

WEATHER_COLS = ["temperature", "precipitation", "snowfall", "snow_depth"]
HOUR_COLS = [*WEATHER_COLS, "is_holiday"]
TARGET = "departures"

# Model inputs in vector order.
FEATURES = [
    "hour_of_day", "day_of_week", "month", "is_weekend", "is_holiday",
    "start_lat", "start_lng",
    "temperature", "precipitation", "snowfall", "snow_depth",
    "lag_1h", "lag_2h", "lag_24h",
]

# Display names of the model inputs.
FEATURE_LABELS = {
    "lag_1h": "Lag 1h",
    "lag_24h": "Lag 24h",
    "lag_2h": "Lag 2h",
    "hour_of_day": "Hour of day",
    "temperature": "Temperature",
    "day_of_week": "Day of week",
    "month": "Month",
    "start_lat": "Latitude",
    "start_lng": "Longitude",
    "is_weekend": "Is weekend",
    "precipitation": "Precipitation",
    "snow_depth": "Snow depth",
    "snowfall": "Snowfall",
    "is_holiday": "Is holiday",
}

# Demand buckets are half-open, [edge, next edge).
BUCKET_EDGES = [0, 1, 3, 6, 10, 20, 50, 200]
BUCKET_LABELS = ["0", "1-2", "3-5", "6-9", "10-19", "20-49", "50+"]

# Weekday names, 0 = Monday.
DOW_LABELS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]

# Training fractions of the learning curve and the default seed.
FRACTIONS = [0.10, 0.20, 0.40, 0.60, 0.80, 1.00]
SEED = 42
