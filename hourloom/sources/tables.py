"""Readers of the engine's inputs and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom import schema as S
from hourloom.functions import clock
from hourloom.operators.clean import drop_dst_edges
from hourloom.sources import files


def read_trips(spark: SparkSession, pattern: str, on_bad_file: str = "skip") -> DataFrame:
    """Trip CSV files: ids stay text, unreadable times become null."""
    return files.read_csv_by_name(spark, pattern, S.TRIPS, on_bad_file)


def read_weather(spark: SparkSession, pattern: str, tz: str | None = None) -> DataFrame:
    """Hourly weather; with ``tz``, hours that name no single instant there are dropped."""
    weather = files.read_csv_by_name(spark, pattern, S.WEATHER, "fail")
    return drop_dst_edges(weather, tz, "datetime") if tz else weather


def read_holidays(spark: SparkSession, path: str | None) -> DataFrame:
    """Holiday dates; a missing file is an empty calendar."""
    if path is None or not files.exists(spark, path):
        return spark.createDataFrame([], S.HOLIDAYS)
    return files.read_csv_by_name(spark, path, S.HOLIDAYS, "fail")


def read_hourly(spark: SparkSession, pattern: str, tz: str) -> DataFrame:
    """Hourly demand CSV. Times with a UTC offset come back as wall clock of ``tz``."""
    text = S.T.StructType(
        [S.T.StructField(f.name, S.T.StringType()) if f.name == "datetime" else f for f in S.HOURLY_DEMAND]
    )
    raw = files.read_csv_by_name(spark, pattern, text, "fail")
    stamp = F.col("datetime")
    local = F.when(stamp.rlike(r"[+-]\d\d:?\d\d$"), clock.instant_to_wall(stamp, tz)).otherwise(
        clock.parse_wall(stamp)
    )
    return raw.withColumn("datetime", local)


def read_features(spark: SparkSession, path: str, *splits: str) -> DataFrame:
    """Feature table; naming splits reads only their partitions."""
    df = spark.read.parquet(path)
    return df.where(F.col("split").isin(*splits)) if splits else df


def explode_hourly_json(df: DataFrame, col: str = "payload") -> DataFrame:
    """Weather service payload, a struct of parallel arrays, to one row per hour."""
    # Field names of the payload.
    fields = {
        "time": "datetime",
        "temperature_2m": "temperature",
        "precipitation": "precipitation",
        "snowfall": "snowfall",
        "snow_depth": "snow_depth",
    }
    kinds = ", ".join(f"{f}: array<{'string' if f == 'time' else 'double'}>" for f in fields)
    hourly = F.from_json(col, f"hourly struct<{kinds}>")["hourly"]
    rows = df.select(hourly.alias("h")).select(
        F.inline(F.arrays_zip(*[F.col(f"h.{f}").alias(f) for f in fields]))
    )
    return rows.select(
        clock.parse_wall("time").alias("datetime"),
        *[F.col(f).alias(name) for f, name in fields.items() if f != "time"],
    )
