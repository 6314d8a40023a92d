"""Incremental ingest: only files that have not been read yet are read.

The stream's checkpoint remembers the files, and the file sink's log makes every batch count once,
also after a lost run. Counting stays the batch operator, over the ingested table, so late rows and
late files need no rule of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from hourloom import schema as S
from hourloom.operators.clean import valid_trips
from hourloom.sources import files


def new_trips(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of the usable trips in the CSV files under a folder, all of one column layout."""
    text = T.StructType([T.StructField(c, T.StringType()) for c in S.TRIPS.names])
    raw = spark.readStream.schema(text).option("header", True).csv(folder)
    return valid_trips(files.typed(raw, S.TRIPS))


def ingest_new_files(spark: SparkSession, folder: str, checkpoint: str, table: str) -> None:
    """Append the trips of the files that are new since the last call, then stop."""
    (
        new_trips(spark, folder)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", table)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def read_ingested(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.schema(S.TRIPS).parquet(table)
