"""Error reports over a scored table.

Input: station_id, station_name, start_lat, start_lng, datetime, hour_of_day, day_of_week, month,
split, departures and the clipped prediction ``pred``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.functions.errors import mae, residual, rmse
from hourloom.functions.text import lookup, short
from hourloom.operators.binning import histogram
from hourloom.operators.quantile import exact_quantiles
from hourloom.operators.sampling import sample_exact

Y, P = "departures", "pred"


def residual_summary(scored: DataFrame) -> DataFrame:
    r = scored.select(residual(Y, P).alias("r"))

    def percent(cond: Column) -> Column:
        return F.avg(cond.cast("int")) * 100.0

    return r.agg(
        F.count("*").alias("n"),
        F.avg("r").alias("mean_residual"),
        F.stddev_pop("r").alias("std_residual"),
        percent(F.col("r") > 0).alias("pct_over"),
        percent(F.col("r") < 0).alias("pct_under"),
    )


def residual_histogram(scored: DataFrame, bins: int = 80, clip: float = 20.0) -> DataFrame:
    return histogram(scored.select(residual(Y, P).alias("residual")), "residual", bins, -clip, clip)


def scatter_sample(
    scored: DataFrame,
    n: int = 30_000,
    seed: int = 42,
    keys: tuple[str, ...] = ("station_id", "datetime"),
    method: str = "xxhash64",
) -> DataFrame:
    """Actual and predicted value of ``n`` rows, with the common axis maximum."""
    points = sample_exact(scored, n, seed, list(keys), method).select(*keys, Y, P)
    top = points.agg(F.greatest(F.max(Y).cast("double"), F.max(P)))
    return points.withColumn("axis_max", top.scalar())


def error_by(scored: DataFrame, col: str, labels: list[str] | dict[int, str] | None = None) -> DataFrame:
    """RMSE and rows per value of a calendar column (at most a few dozen), the extremes marked."""
    grouped = scored.groupBy(col).agg(rmse(Y, P).alias("rmse"), F.count("*").alias("n"))
    out = mark_extremes(grouped, "rmse")
    if isinstance(labels, dict):
        pairs = [F.lit(x) for pair in labels.items() for x in pair]
        return out.withColumn("label", F.element_at(F.create_map(*pairs), F.col(col).cast("int")))
    if labels:
        return out.withColumn("label", lookup(F.col(col), labels))
    return out


def ranked(value: str) -> Column:
    """A score to rank by. The last digits of a mean depend on the order of the sum, so scores
    that agree to nine digits count as equal and ties are settled by name, on every run alike."""
    return F.round(value, 9)


def mark_extremes(df: DataFrame, value: str) -> DataFrame:
    """Flags on the rows of a short report that hold the largest and the smallest value."""
    everything = Window.partitionBy()
    return df.withColumns(
        {
            "is_max": ranked(value) == F.max(ranked(value)).over(everything),
            "is_min": ranked(value) == F.min(ranked(value)).over(everything),
        }
    )


def entity_error(scored: DataFrame, min_support: int = 100) -> DataFrame:
    """Per entity: place, RMSE, mean demand and hours; entities with few hours left out.

    An entity has one place as a rule, so rows are summed per entity and place, a hash aggregate;
    should an entity have several, the place of its earliest rows stands.
    """
    place = ["station_name", "start_lat", "start_lng"]
    miss = residual(Y, P)
    parts = scored.groupBy("station_id", *place).agg(
        F.min("datetime").alias("since"),
        F.sum(miss * miss).alias("sse"),
        F.sum("departures").alias("total"),
        F.count("departures").alias("n"),
    )
    first = F.min(F.struct("since", *place))
    return (
        parts.groupBy("station_id")
        .agg(
            first.alias("first"),
            F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"),
            (F.sum("total") / F.sum("n")).alias("mean_demand"),
            F.sum("n").alias("n_hours"),
        )
        .where(F.col("n_hours") >= min_support)
        .select(
            "station_id",
            "first.station_name",
            F.col("first.start_lat").alias("lat"),
            F.col("first.start_lng").alias("lng"),
            "rmse",
            "mean_demand",
            "n_hours",
        )
    )


def top_entities(table: DataFrame, k: int = 10, worst: bool = True) -> DataFrame:
    """The k entities with the largest (or smallest) RMSE; ties in id order."""
    order = ranked("rmse").desc() if worst else ranked("rmse").asc()
    return (
        table.orderBy(order, "station_id")
        .limit(k)
        .withColumn("short_name", short(F.col("station_name"), 30))
    )


def trend(table: DataFrame, x: str = "mean_demand", y: str = "rmse") -> DataFrame:
    """Least-squares line."""
    return table.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.max(x).alias("x_max"),
    )


def error_trend(table: DataFrame, points: int = 200) -> DataFrame:
    """The trend line at evenly spaced demand values from 0 to the largest."""
    step = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    x = F.col("x_max") * F.col("point") / F.lit(float(points - 1))
    return (
        trend(table)
        .select("slope", "intercept", "x_max", step)
        .select("point", x.alias("x"), (F.col("slope") * x + F.col("intercept")).alias("y"))
    )


def _quantile_row(table: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Named quantiles of the RMSE as one row."""
    q = exact_quantiles(table, "rmse", list(probs.values()))
    return q.agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name) for name, p in probs.items()]
    )


def geo_error(table: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Entity places with RMSE and the colour limits of a map."""
    limits = _quantile_row(table, {"vmin": low, "vmax": high}).select(F.struct("vmin", "vmax"))
    return table.withColumn("q", limits.scalar()).select(
        "station_id", "lat", "lng", "rmse", "q.vmin", "q.vmax"
    )


def entity_summary(table: DataFrame) -> DataFrame:
    """Distribution of the entities' RMSE, with the names at both ends; ties in id order."""
    q = _quantile_row(table, {"median": 0.5, "p90": 0.9}).select(F.struct("median", "p90"))
    worst = F.min(F.struct((-ranked("rmse")).alias("r"), "station_id", "station_name"))
    best = F.min(F.struct(ranked("rmse").alias("r"), "station_id", "station_name"))
    return (
        table.agg(
            F.count("*").alias("n_entities"),
            F.avg("rmse").alias("mean_rmse"),
            F.max("rmse").alias("max_rmse"),
            worst.getField("station_name").alias("max_name"),
            F.min("rmse").alias("min_rmse"),
            best.getField("station_name").alias("min_name"),
        )
        .withColumn("q", q.scalar())
        .select("*", F.col("q.median").alias("median_rmse"), F.col("q.p90").alias("p90_rmse"))
        .drop("q")
    )


def total_series(scored: DataFrame) -> DataFrame:
    """Totals over all entities per time step."""
    return scored.groupBy("datetime").agg(
        F.sum("departures").alias("departures"), F.sum("pred").alias("pred")
    )


def daily_totals(series: DataFrame) -> DataFrame:
    """Totals per day; a day without rows inside the range is there with 0."""
    per_day = series.groupBy(F.to_date("datetime").alias("day")).agg(
        F.sum("departures").alias("departures"), F.sum("pred").alias("pred")
    )
    days = series.agg(
        F.to_date(F.min("datetime")).alias("first"), F.to_date(F.max("datetime")).alias("last")
    ).select(F.explode(F.sequence("first", "last")).alias("day"))
    return days.join(per_day, "day", "left").fillna(0, ["departures", "pred"])


def error_of(df: DataFrame) -> DataFrame:
    """RMSE and MAE of a table of actual and predicted values."""
    return df.agg(rmse(Y, P).alias("rmse"), mae(Y, P).alias("mae"), F.count("*").alias("n"))


def daily_error(series: DataFrame) -> DataFrame:
    return error_of(daily_totals(series))


def focus_entity(scored: DataFrame, min_support: int = 600) -> DataFrame:
    """The entity with the highest mean demand among those with enough hours; ties in id order."""
    return (
        scored.groupBy("station_id", "station_name")
        .agg(F.avg("departures").alias("mean_demand"), F.count("departures").alias("n"))
        .where(F.col("n") >= min_support)
        .orderBy(ranked("mean_demand").desc(), "station_id")
        .limit(1)
    )


def focus_series(scored: DataFrame, min_support: int = 600) -> DataFrame:
    """Rows of the focus entity; the joined side is a single row."""
    pick = focus_entity(scored, min_support).select("station_id")
    return scored.join(F.broadcast(pick), "station_id", "left_semi").select(
        "station_id", "station_name", "datetime", "departures", "pred"
    )


def focus_error(scored: DataFrame, min_support: int = 600) -> DataFrame:
    return error_of(focus_series(scored, min_support))
