"""The panel's inputs, taken from the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom import schema as S
from hourloom.functions import clock
from hourloom.functions.errors import mae, rmse
from hourloom.operators.counts import hourly_counts, modal_dim
from hourloom.operators.panel import Span
from hourloom.plans import demand

TZ = "America/New_York"
TRAIN_END, VAL_END = "2024-01-22", "2024-01-27"
HOLIDAY_DATES = {"2024-01-01": "New Year's Day", "2024-01-15": "Martin Luther King Jr. Day"}
# Days that put a January day on the spring and on the autumn clock change of 2024.
SPRING_DAYS, FALL_DAYS = 60, 298


# Declared, so that a read does not start a job to look at file footers.
SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
    "props string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def span(spark: SparkSession, sf_dir: str) -> Span:
    """The whole days that the events cover, from one aggregate."""
    lo, hi = table(spark, sf_dir, "events").agg(F.min("ts"), F.max("ts")).first()
    return Span(f"{lo:%Y-%m-%d} 00:00:00", f"{hi:%Y-%m-%d} 23:00:00")


def cleaned(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    days = span(spark, sf_dir)
    return demand.clean(rows, days.lo, f"{days.hi[:10]} 23:59:59.999999", TZ)


def rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trips, without station names. Every 50th user is renamed late in the range."""
    k = "CAST(get_json_object(props, '$.k') AS int)"
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(event_id AS string) AS ride_id",
        "ts AS started_at",
        "CAST(user_id AS string) AS start_station_id",
        f"CAST({k} % 7 AS double) AS start_lat",
        f"CAST({k} % 5 AS double) AS start_lng",
        "user_id",
        "user_id % 50 = 0 AND ts >= timestamp_ntz'2024-01-20 00:00:00' AS moved",
    )


def with_names(spark: SparkSession, sf_dir: str, df: DataFrame, out: str) -> DataFrame:
    """Names from the customer table; a renamed user carries a suffix."""
    names = table(spark, sf_dir, "customer").selectExpr("c_custkey AS user_id", "c_name")
    name = F.expr("CASE WHEN moved THEN concat(c_name, ' (moved)') ELSE c_name END")
    return df.join(names, "user_id", "left").withColumn(out, name)


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_names(spark, sf_dir, rides(spark, sf_dir), "start_station_name").select(*S.TRIPS.names)


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departures per station and hour. Names play no part, so the log is not joined."""
    return hourly_counts(cleaned(spark, sf_dir, rides(spark, sf_dir)))


def dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name) dimension. The log is aggregated first; names join one row per entity."""
    clean = cleaned(spark, sf_dir, rides(spark, sf_dir))
    places = modal_dim(clean, ["user_id", "start_station_id", "moved"], ["start_lat", "start_lng"])
    return with_names(spark, sf_dir, places, "station_name").select(
        F.col("start_station_id").alias("station_id"), "station_name", "start_lat", "start_lng"
    )


def shifted_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trips moved onto the spring and, once more, onto the autumn clock change."""
    base = rides(spark, sf_dir).select("ride_id", "started_at", "start_station_id")
    days = F.explode(F.array(F.lit(SPRING_DAYS), F.lit(FALL_DAYS))).alias("_days")
    return (
        base.select("*", days)
        .withColumn("started_at", F.col("started_at") + F.make_dt_interval(days=F.col("_days")))
        .drop("_days")
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly readings from the error events; hours without one are missing."""
    errors = table(spark, sf_dir, "events").where("event_type = 'error'")
    readings = {
        "temperature": "max(value)",
        "precipitation": "min(value)",
        "snowfall": "CAST(0 AS double)",
        "snow_depth": "CAST(count(*) AS double)",
    }
    return errors.groupBy(clock.floor_hour("ts").alias("datetime")).agg(
        *[F.expr(f"{sql} AS {name}") for name, sql in readings.items()]
    )


def holidays(spark: SparkSession) -> DataFrame:
    rows = ", ".join(
        f'struct(date\'{d}\' AS date, "{name}" AS holiday_name)' for d, name in HOLIDAY_DATES.items()
    )
    return spark.range(1).selectExpr(f"inline(array({rows}))")


def hourly(spark: SparkSession, sf_dir: str, dedupe: bool = True) -> DataFrame:
    return demand.hourly_demand(
        counts(spark, sf_dir), dim(spark, sf_dir), weather(spark, sf_dir), holidays(spark),
        span(spark, sf_dir), dedupe,
    )


def features(spark: SparkSession, sf_dir: str, filled: bool = False) -> DataFrame:
    return demand.features(
        counts(spark, sf_dir),
        dim(spark, sf_dir),
        weather(spark, sf_dir),
        holidays(spark),
        span(spark, sf_dir),
        TRAIN_END,
        VAL_END,
        filled,
    )


def model_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir, filled=True)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with a stated forecast, so that every report can be checked value by value."""
    weights = {"lag_1h": 0.5, "lag_2h": 0.2, "lag_24h": 0.3}
    blend = " + ".join(f"{w}D * CAST({lag} AS double)" for lag, w in weights.items())
    return features(spark, sf_dir).withColumn("pred", F.expr(f"greatest(0D, {blend})"))


def lag_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of three persistence forecasts and of the stated blend, for the result tables."""
    rows = scored(spark, sf_dir).where("split IN ('val', 'test')")
    models = {"lag_1h": "lag_1h", "lag_2h": "lag_2h", "lag_24h": "lag_24h", "blend": "pred"}
    long = rows.select(
        "split",
        "departures",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("p"))
                    for m, c in models.items()
                ]
            )
        ),
    )
    return long.groupBy("model", "split").agg(
        rmse("departures", "p").alias("rmse"),
        mae("departures", "p").alias("mae"),
    )


def supplier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items per supplier and ship day: a second panel at a daily step."""
    return hourly_counts(
        table(spark, sf_dir, "lineitem"), "l_suppkey", "l_shipdate", "day", "supplier_id", "day", "items"
    )


def supplier_span(spark: SparkSession, sf_dir: str) -> Span:
    """The whole years in which items were shipped."""
    lo, hi = table(spark, sf_dir, "lineitem").agg(F.min("l_shipdate"), F.max("l_shipdate")).first()
    return Span(f"{lo:%Y}-01-01 00:00:00", f"{hi:%Y}-12-31 00:00:00", "day", block_days=365)


def events_as_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips as the text columns of a raw file."""
    t = trips(spark, sf_dir)
    return t.select(*[F.col(c).cast("string") for c in S.TRIPS.names])
