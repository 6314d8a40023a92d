"""Writers."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.functions import clock
from hourloom.operators.results import upsert
from hourloom.session import materialize  # noqa: F401  kept under its old name
from hourloom.sources import files

# Versions of a small table that are kept, the newest among them.
KEPT_VERSIONS = 8


def write_hourly(df: DataFrame, path: str, tz: str | None = None) -> None:
    """Hourly demand as CSV, globally ordered by (station, hour) across the part files.

    With ``tz`` the times carry their UTC offset.
    """
    out = df.repartitionByRange("station_id", "datetime").sortWithinPartitions("station_id", "datetime")
    if tz:
        out = out.withColumn("datetime", clock.with_offset("datetime", tz))
    else:
        out = out.withColumn("datetime", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss"))
    out.write.mode("overwrite").option("header", True).csv(path)


def write_features(df: DataFrame, path: str) -> None:
    """Feature table, one directory per split, so that a split can be read alone."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def append_result(df: DataFrame, path: str) -> None:
    """Append rows to a small table of results; it stays one file, and two writers at once lose no row."""
    upsert_versioned(df, path, [])


def read_results(spark: SparkSession, path: str | None, schema: T.StructType | str) -> DataFrame:
    """All appended rows so far; none if there is no table yet."""
    found = read_versioned(spark, path) if path else None
    return spark.createDataFrame([], schema) if found is None else found


def write_best(best: DataFrame, path: str) -> None:
    """The best trial as a JSON object."""
    best.select(F.to_json(F.struct(*best.columns)).alias("value")).write.mode("overwrite").text(path)


def _log(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of the committed versions, oldest first."""
    out = []
    for entry in files.glob(spark, f"{path}/_log/*"):
        folder = files.read_text(spark, entry)
        if folder:  # an entry that is being written is no version yet
            out.append((int(entry.rsplit("/", 1)[1]), folder))
    return sorted(out)


def read_versioned(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest committed version of a small table, or None."""
    log = _log(spark, path)
    return spark.read.parquet(f"{path}/{log[-1][1]}") if log else None


def upsert_versioned(new: DataFrame, path: str, keys: list[str], keep: int = KEPT_VERSIONS) -> DataFrame:
    """Replace the rows with these keys and add the others; without keys, add all.

    The result is written beside the version it was made from and becomes the next one by an entry in
    the log, which is only made if there is none of that number. Whoever finds the number taken merges
    again with what the other writer has committed, so no row is lost, a table is never overwritten
    while it is being read, and a failed run leaves the last version in force. Of old versions ``keep``
    stay.
    """
    spark = new.sparkSession
    while True:
        log = _log(spark, path)
        merged = new
        if log:
            old = spark.read.parquet(f"{path}/{log[-1][1]}")
            merged = upsert(old, new, keys) if keys else old.unionByName(new)
        number, folder = (log[-1][0] + 1 if log else 0), f"data-{uuid.uuid4().hex}"
        merged.coalesce(1).write.parquet(f"{path}/{folder}")
        if files.write_if_absent(spark, f"{path}/_log/{number:08d}", folder):
            for _, old_folder in log[: max(0, len(log) + 1 - keep)]:
                files.remove(spark, f"{path}/{old_folder}")
            return spark.read.parquet(f"{path}/{folder}")
        files.remove(spark, f"{path}/{folder}")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
