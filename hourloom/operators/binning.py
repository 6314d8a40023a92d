"""Bucket, histogram and hexagon counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.functions.errors import clip, rmse


def bucket_index(c: Column, edges: list[float]) -> Column:
    """Number of the half-open bucket [edge, next edge) a value lies in; null outside all."""
    pairs = list(zip(edges[:-1], edges[1:]))
    index = F.when((c >= pairs[0][0]) & (c < pairs[0][1]), 0)
    for i, (lo, hi) in enumerate(pairs[1:], start=1):
        index = index.when((c >= lo) & (c < hi), i)
    return index


def bucket_dim(df: DataFrame, labels: list[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).alias("bucket_no"), F.lit(x).alias("bucket"))
                     for i, x in enumerate(labels)])
    return df.sparkSession.range(1).select(F.inline(rows))


def bucket_error(
    scored: DataFrame,
    edges: list[float],
    labels: list[str],
    y: str = "departures",
    p: str = "pred",
) -> DataFrame:
    """RMSE and rows per demand bucket; an empty bucket reports 0 and 0."""
    found = (
        scored.withColumn("bucket_no", bucket_index(F.col(y), edges))
        .where("bucket_no IS NOT NULL")
        .groupBy("bucket_no")
        .agg(rmse(y, p).alias("rmse"), F.count("*").alias("n"))
    )
    return bucket_dim(scored, labels).join(found, "bucket_no", "left").select(
        "bucket_no",
        "bucket",
        F.coalesce("rmse", F.lit(0.0)).alias("rmse"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def histogram(
    df: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None
) -> DataFrame:
    """Equal-width counts over [min, max] of the values, clipped first if bounds are given.

    The last bin is closed; empty bins are listed.
    """
    x = F.col(value).cast("double")
    if low is not None and high is not None:
        x = clip(x, low, high)
    clipped = df.where(F.col(value).isNotNull()).select(x.alias("_x"))
    flat = F.min("_x") == F.max("_x")
    span = clipped.agg(
        (F.min("_x") - F.when(flat, 0.5).otherwise(0.0)).alias("lo"),
        (F.max("_x") + F.when(flat, 0.5).otherwise(0.0)).alias("hi"),
    ).select(F.struct("lo", "hi"))
    width = F.col("s.hi") - F.col("s.lo")
    counted = (
        clipped.withColumn("s", span.scalar())
        .select(
            F.least(
                F.lit(bins - 1), F.floor((F.col("_x") - F.col("s.lo")) / width * bins)
            ).cast("int").alias("bin")
        )
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )
    frame = (
        df.sparkSession.range(bins)
        .select(F.col("id").cast("int").alias("bin"))
        .withColumn("s", span.scalar())
    )
    edge = lambda i: F.col("s.lo") + width * i / bins
    return frame.join(counted, "bin", "left").select(
        "bin",
        edge(F.col("bin")).alias("bin_lo"),
        edge(F.col("bin") + 1).alias("bin_hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def hexbin(
    scored: DataFrame,
    x: str = "departures",
    y: str = "pred",
    gridsize: int = 60,
    cap: float = 30.0,
    min_count: int = 1,
) -> DataFrame:
    """Counts on a hexagonal grid over both values, capped.

    Hexagon centres form two rectangular lattices, one shifted by half a cell. A point belongs to
    the nearer of its nearest centres. The bounds get the usual hair of padding.
    """
    nx, ny = gridsize, int(gridsize / math.sqrt(3))
    points = scored.select(
        F.least(F.col(x).cast("double"), F.lit(float(cap))).alias("_x"),
        F.least(F.col(y).cast("double"), F.lit(float(cap))).alias("_y"),
    )

    def padded(c: str) -> list[Column]:
        lo, hi = F.min(c), F.max(c)
        flat = lo == hi
        lo_, hi_ = F.when(flat, lo - 0.1).otherwise(lo), F.when(flat, hi + 0.1).otherwise(hi)
        pad = (hi_ - lo_) * 1e-9
        return [(lo_ - pad).alias(f"{c}lo"), (hi_ + pad).alias(f"{c}hi")]

    bounds = points.agg(*padded("_x"), *padded("_y"))
    cell = bounds.select(
        F.struct(
            F.col("_xlo").alias("x0"),
            ((F.col("_xhi") - F.col("_xlo")) / nx).alias("sx"),
            F.col("_ylo").alias("y0"),
            ((F.col("_yhi") - F.col("_ylo")) / ny).alias("sy"),
        )
    )
    u, v = F.col("_u"), F.col("_w")
    near = (u - F.rint(u)) * (u - F.rint(u)) + 3.0 * (v - F.rint(v)) * (v - F.rint(v))
    du, dv = u - F.floor(u) - 0.5, v - F.floor(v) - 0.5
    shifted = du * du + 3.0 * dv * dv
    lattice = F.when(near < shifted, 0).otherwise(1)
    counted = (
        points.withColumn("c", cell.scalar())
        .select(
            "c",
            ((F.col("_x") - F.col("c.x0")) / F.col("c.sx")).alias("_u"),
            ((F.col("_y") - F.col("c.y0")) / F.col("c.sy")).alias("_w"),
        )
        .withColumn("lattice", lattice)
        .withColumn("ix", F.when(F.col("lattice") == 0, F.rint(u)).otherwise(F.floor(u)).cast("int"))
        .withColumn("iy", F.when(F.col("lattice") == 0, F.rint(v)).otherwise(F.floor(v)).cast("int"))
        .groupBy("lattice", "ix", "iy")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_count)
        .withColumn("c", cell.scalar())
    )
    half = F.col("lattice") * 0.5
    return counted.select(
        "lattice",
        "ix",
        "iy",
        (F.col("c.x0") + (F.col("ix") + half) * F.col("c.sx")).alias("x"),
        (F.col("c.y0") + (F.col("iy") + half) * F.col("c.sy")).alias("y"),
        "n",
        F.log10(F.col("n")).alias("log_n"),
    )
