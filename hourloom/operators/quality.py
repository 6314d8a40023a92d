"""Row accounting and numeric summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.functions import clock
from hourloom.operators.clean import in_span
from hourloom.operators.quantile import exact_quantiles


def quality_report(
    trips: DataFrame,
    lo: str,
    hi: str,
    tz: str,
    ts: str = "started_at",
    key: str = "start_station_id",
) -> DataFrame:
    """Rows left after each cleaning step, from one pass over the raw log."""
    raw = trips.select(clock.parse_wall(ts).alias("t"), F.col(key).alias("k"))
    valid = F.col("t").isNotNull() & F.col("k").isNotNull()
    ranged = valid & in_span("t", lo, hi)
    edge = clock.within_edges("t", clock.dst_edges(tz, lo, hi))
    return raw.agg(
        F.count("*").alias("n_loaded"),
        F.count_if(F.col("t").isNull()).alias("n_bad_time"),
        F.count_if(F.col("k").isNull()).alias("n_no_key"),
        F.count_if(valid).alias("n_valid"),
        F.count_if(ranged).alias("n_in_range"),
        F.count_if(ranged & edge).alias("n_dst_edge"),
        F.count_if(ranged & ~edge).alias("n_kept"),
    )


def null_report(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null count per column, as rows."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in cols])
    return counts.select(F.inline(rows))


def describe_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, sample standard deviation, min, quartiles and max of each column."""
    long = df.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in cols]
            )
        )
    )
    moments = long.groupBy("column_name").agg(
        F.count("x").alias("n"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    quartiles = (
        exact_quantiles(long, "x", [0.25, 0.5, 0.75], by=["column_name"])
        .groupBy("column_name")
        .agg(
            *[
                F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name)
                for name, p in {"q25": 0.25, "q50": 0.5, "q75": 0.75}.items()
            ]
        )
    )
    return moments.join(quartiles, "column_name", "left")
