"""A stored panel that follows its ingested events: only what changed is counted, laid out and lagged again.

The panel is stored by block of days and part of the entities. After an ingest the files that are new
since the last refresh say which (block, part) have new events; a block whose successor reaches back into
it with its lags touches that one too, and an entity that was never seen touches every block of its part.
These partitions are computed from the whole ingested table and replaced, the others are not read or
written. Files count as done only after their partitions are in place, so a refresh that broke off is
repeated with the same result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.functions import clock
from hourloom.operators import panel
from hourloom.operators.counts import hourly_counts
from hourloom.operators.panel import BLOCK, Span
from hourloom.sources import files, sinks
from hourloom.streaming.ingest import read_ingested

PART = "_part"
PARTS = 16
LAGS = (1, 2, 24)
_DONE = "file string"
# Ranges of time that a filter names one by one; beyond, it names the whole range.
_FEW_RANGES = 64


def _part_of(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def refresh(spark: SparkSession, table: str, store: str, span: Span, lags: tuple[int, ...] = LAGS, parts: int = PARTS) -> list[tuple[int, int]]:
    """Bring the panel at ``store`` up to the ingested ``table``; gives the replaced (block, part)."""
    done = {r.file for r in sinks.read_results(spark, f"{store}/done", _DONE).collect()}
    new = [f for f in read_ingested(spark, table).inputFiles() if f not in done]
    if not new:
        return []
    trips = spark.read.schema(read_ingested(spark, table).schema).parquet(*new)
    fresh = hourly_counts(trips).where(F.col("datetime").between(F.expr(span.first), F.expr(span.last)))
    fresh = sinks.materialize(fresh.select("station_id", "datetime", _part_of("station_id", parts).alias(PART)), "fresh")
    known = _keys(spark, store)
    newcomers = sinks.materialize(
        fresh.select("station_id", PART).distinct().join(known, "station_id", "left_anti"), "newcomers"
    )
    first, last = span.blocks
    touched = panel._lead_in(fresh, "datetime", span, max(lags)).select(BLOCK, PART)
    every = newcomers.select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias(BLOCK), PART)
    # At most as many rows as the span has blocks, times the parts.
    found = sorted((r[BLOCK], r[PART]) for r in touched.unionByName(every).where(F.col(BLOCK) <= last).distinct().collect())
    if found:
        keys = known.unionByName(newcomers)
        _write(spark, table, store, span, lags, parts, keys, found)
    # The order matters: entities first, then the files that brought them.
    newcomers.write.mode("append").parquet(f"{store}/keys")
    sinks.append_result(spark.createDataFrame([(f,) for f in new], _DONE), f"{store}/done")
    return found


def _keys(spark: SparkSession, store: str) -> DataFrame:
    schema = T.StructType([T.StructField("station_id", T.StringType()), T.StructField(PART, T.IntegerType())])
    if not files.exists(spark, f"{store}/keys"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{store}/keys").distinct()


def _write(
    spark: SparkSession, table: str, store: str, span: Span, lags: tuple[int, ...], parts: int,
    keys: DataFrame, found: list[tuple[int, int]],
) -> None:
    only = spark.createDataFrame(found, f"{BLOCK} int, {PART} int")
    # The counts of a block, and the end of the one before, which its lags reach.
    needed = sorted({b - k for b, _ in found for k in (0, 1)})
    ranges = [(b, b) for b in needed] if len(needed) <= _FEW_RANGES else [(needed[0], needed[-1])]
    days = [(lo * span.block_days, (hi + 1) * span.block_days) for lo, hi in ranges]
    within = [
        (F.col("started_at") >= F.expr(f"CAST(date_from_unix_date({lo}) AS timestamp_ntz)"))
        & (F.col("started_at") < F.expr(f"CAST(date_from_unix_date({hi}) AS timestamp_ntz)"))
        for lo, hi in days
    ]
    some = sorted({p for _, p in found})
    trips = read_ingested(spark, table).where(reduce(Column.__or__, within))
    trips = trips.where(_part_of("start_station_id", parts).isin(some))
    counts = hourly_counts(trips).where(F.col("datetime").between(F.expr(span.first), F.expr(span.last)))
    rows = panel.dense_panel(keys.join(only, PART).select("station_id", BLOCK), counts, span, lags=lags)
    rows = rows.withColumn(BLOCK, clock.block_of("datetime", span.block_days)).withColumn(PART, _part_of("station_id", parts))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BLOCK, PART).parquet(f"{store}/panel")


def read_panel(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/panel").drop(BLOCK, PART)
