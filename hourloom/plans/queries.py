"""Registered queries: every operator over the benchmark tables.

A query is a function of (spark, folder of the tables). Results come in plain types (long, double,
string, boolean), numbers rounded to six digits, so that two engines can be compared value by value.
"""

from __future__ import annotations

import zipfile
from collections.abc import Callable
from contextlib import ExitStack
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom import schema as S
from hourloom.functions import clock, text
from hourloom.functions.errors import mae, rmse
from hourloom.models import boosting, curve, importance, linear, mlp, search, trees
from hourloom.operators import (
    binning, calendar, clean, counts, diagnostics, joins, panel, quality, quantile, results, sampling,
)
from hourloom.plans import demand, driver
from hourloom.session import shared_dir, tune
from hourloom.sources import archives, files, sinks, tables
from hourloom.streaming import ingest, refresh

# Results as the engine gives them, and the same in plain types.
RAW: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DIGITS = 6
ROW = ["station_id", "datetime"]


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(fn(tune(spark), sf_dir))

    RAW[fn.__name__] = fn
    QUERIES[fn.__name__] = run
    return fn


def tidy(df: DataFrame) -> DataFrame:
    def plain(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FractionalType, T.DecimalType)):
            c = F.round(c.cast("double"), DIGITS)
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType, T.DateType)):
            c = c.cast("string")
        return c.alias(f.name)

    return df.select(*[plain(f) for f in df.schema])


# Sources and sinks


@query
def trip_csv_scan(spark, sf):
    """CSV files with their columns in two orders, and one without a time column."""
    base = shared_dir(spark, "csv")
    rows = driver.events_as_csv_rows(spark, sf)
    odd = F.col("ride_id").cast("long") % 2 == 1
    rows.where(~odd).write.option("header", True).csv(f"{base}/a")
    rows.where(odd).select(*reversed(S.TRIPS.names)).write.option("header", True).csv(f"{base}/b")
    rows.where(odd).drop("started_at").write.option("header", True).csv(f"{base}/c")
    return tables.read_trips(spark, f"{base}/*/*.csv")


@query
def skipped_csv_files(spark, sf):
    """Files without a wanted column, by reason."""
    base = shared_dir(spark, "csv")
    rows = driver.events_as_csv_rows(spark, sf)
    rows.write.option("header", True).csv(f"{base}/a")
    # One file that lacks a column; its rows are made by all tasks and only written by one.
    rows.drop("started_at").repartition(1).write.option("header", True).csv(f"{base}/b")
    skipped = files.skipped_files(spark, f"{base}/*/*.csv", S.TRIPS.names)
    return skipped.groupBy("reason").agg(F.count("*").alias("n"))


@query
def weather_csv_scan(spark, sf):
    path = shared_dir(spark, "weather")
    driver.weather(spark, sf).withColumn("datetime", F.col("datetime").cast("string")).write.option(
        "header", True
    ).csv(path)
    return tables.read_weather(spark, f"{path}/*.csv", driver.TZ)


@query
def holiday_file_missing(spark, sf):
    """Without a holiday file no hour is a holiday."""
    none = tables.read_holidays(spark, shared_dir(spark, "absent") + "/holidays.csv")
    flagged = joins.flag_dates(driver.counts(spark, sf), none)
    return flagged.groupBy("is_holiday").agg(F.count("*").alias("n"))


@query
def hourly_csv_round_trip(spark, sf):
    """Hourly demand through a CSV file whose times carry their UTC offset."""
    path = shared_dir(spark, "hourly")
    sinks.write_hourly(driver.hourly(spark, sf), path, driver.TZ)
    return tables.read_hourly(spark, f"{path}/*.csv", driver.TZ)


@query
def features_from_stored_hourly(spark, sf):
    """Features built from the stored hourly table, as the two-step job does."""
    path = shared_dir(spark, "hourly")
    sinks.write_hourly(driver.hourly(spark, sf), path, driver.TZ)
    stored = tables.read_hourly(spark, f"{path}/*.csv", driver.TZ)
    return demand.features_from_hourly(stored, driver.span(spark, sf), driver.TRAIN_END, driver.VAL_END)


@query
def feature_store_scan(spark, sf):
    """Feature table through Parquet, one split read back by partition pruning."""
    path = shared_dir(spark, "features")
    sinks.write_features(driver.features(spark, sf), path)
    return tables.read_features(spark, path, "val").select(
        "station_id", "datetime", "departures", "lag_1h", "lag_24h", "split"
    )


@query
def weather_payload(spark, sf):
    """Daily payloads of parallel arrays back to one row per hour."""
    hours = driver.weather(spark, sf)
    names = {
        "time": F.date_format("datetime", "yyyy-MM-dd'T'HH:mm"),
        "temperature_2m": F.col("temperature"),
        "precipitation": F.col("precipitation"),
        "snowfall": F.col("snowfall"),
        "snow_depth": F.col("snow_depth"),
    }
    rows = hours.select(F.to_date("datetime").alias("day"), *[c.alias(n) for n, c in names.items()])
    # At most 24 hours per payload.
    daily = rows.groupBy("day").agg(F.collect_list(F.struct(*names)).alias("h"))
    payload = F.to_json(F.struct(F.struct(*[F.col(f"h.{n}").alias(n) for n in names]).alias("hourly")))
    return tables.explode_hourly_json(daily.select(payload.alias("payload")))


def _write_zips(rows: DataFrame, base: str) -> None:
    """Each partition streams its rows into an archive of its own; odd ones into a zip in a zip."""
    names, address = rows.columns, archives.store_uri(base)

    def write(batches):
        import pandas as pd
        from pyarrow import fs
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        month = f"2024{part % 12 + 1:02d}"
        system, path = fs.FileSystem.from_uri(address)
        system.create_dir(path)
        n = 0
        with ExitStack() as stack:
            sink = stack.enter_context(system.open_output_stream(f"{path}/part-{part:05d}.zip"))
            archive = stack.enter_context(zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED))
            if part % 2:
                nested = stack.enter_context(archive.open(f"{month}-trips.zip", "w"))
                archive = stack.enter_context(zipfile.ZipFile(nested, "w", zipfile.ZIP_DEFLATED))
            member = stack.enter_context(archive.open(f"{month}-trips.csv", "w"))
            member.write((",".join(names) + "\n").encode())
            for pdf in batches:
                member.write(pdf.to_csv(index=False, header=False).encode())
                n += len(pdf)
        yield pd.DataFrame({"n": [n]})

    rows.mapInPandas(write, "n long").agg(F.sum("n")).first()


@query
def zipped_csv_scan(spark, sf):
    """Trips out of zip archives, half of them zips inside zips."""
    base = shared_dir(spark, "zips")
    _write_zips(driver.events_as_csv_rows(spark, sf).repartition("ride_id"), base)
    return archives.read_zipped_csv(spark, f"{base}/*.zip")


def _broken_copies(batches):
    """Beside each archive one cut at half its bytes, and one whose rows and header are damaged."""
    import pandas as pd
    from pyarrow import fs

    for batch in batches:
        for address in batch["address"]:
            system, path = fs.FileSystem.from_uri(address)
            with system.open_input_file(path) as f:
                data = f.read()
            stem = path.removesuffix(".zip")
            with system.open_output_stream(f"{stem}-cut.zip") as f:
                f.write(data[: len(data) // 2])
            with system.open_output_stream(f"{stem}-odd.zip") as f, zipfile.ZipFile(f, "w") as z:
                z.writestr("202401-short.csv", f"{','.join(S.TRIPS.names)}\n1,x\n2\n")
                z.writestr("202402-headless.csv", "a,b\n1,2\n")
        yield pd.DataFrame({"n": [len(batch)]})


@query
def zip_outcomes(spark, sf):
    """What a read of whole, cut and odd archives takes and leaves: members, rows and problems."""
    base = shared_dir(spark, "zips")
    _write_zips(driver.events_as_csv_rows(spark, sf).repartition(4, "ride_id"), base)
    found = [(archives.store_uri(p),) for p in files.glob(spark, f"{base}/*.zip")]
    spark.createDataFrame(found, "address string").mapInPandas(_broken_copies, "n long").count()
    members = archives.list_members(spark, f"{base}/*.zip")
    outcomes = archives.member_outcomes(members, S.TRIPS.names)
    kind = F.when(F.col("archive").endswith("-cut.zip"), "cut").when(F.col("archive").endswith("-odd.zip"), "odd").otherwise("whole")
    problem = F.coalesce(F.element_at(F.split("problem", ":"), 1), F.lit("none"))
    return outcomes.groupBy(kind.alias("kind"), problem.alias("problem")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows")
    )


@query
def pending_zip_members(spark, sf):
    """Members of the archives whose month is not among those already loaded."""
    base = shared_dir(spark, "zips")
    _write_zips(driver.events_as_csv_rows(spark, sf).repartition(4, "ride_id"), base)
    members = archives.list_members(spark, f"{base}/*.zip")
    done = spark.createDataFrame([("202401",), ("202403",)], "month_key string")
    left = archives.pending_members(members, done)
    return left.groupBy("month_key").agg(F.count("*").alias("n"))


@query
def csv_outcomes(spark, sf):
    """What a read takes from whole, compressed, cut and header-less files."""
    base = shared_dir(spark, "csv")
    rows = driver.events_as_csv_rows(spark, sf)
    rows.repartition(2).write.option("header", True).csv(f"{base}/whole")
    rows.write.option("header", True).option("compression", "gzip").csv(f"{base}/packed")
    rows.drop("started_at").write.option("header", True).csv(f"{base}/odd")
    packed = [(archives.store_uri(p),) for p in files.glob(spark, f"{base}/packed/*.gz")]
    target = archives.store_uri(f"{base}/cut")

    def cut(batches):
        import pandas as pd
        from pyarrow import fs

        for batch in batches:
            system, path = fs.FileSystem.from_uri(target)
            system.create_dir(path)
            for address in batch["address"]:
                source, inner = fs.FileSystem.from_uri(address)
                left = source.get_file_info(inner).size // 2
                name = inner.rsplit("/", 1)[1]
                with source.open_input_file(inner) as whole, system.open_output_stream(f"{path}/{name}", compression=None) as f:
                    while left and (piece := whole.read(min(left, 1 << 20))):
                        f.write(piece)
                        left -= len(piece)
            yield pd.DataFrame({"n": [len(batch)]})

    spark.createDataFrame(packed, "address string").repartition(len(packed)).mapInPandas(cut, "n long").count()
    found = files.file_outcomes(spark, f"{base}/*/*.csv*", S.TRIPS.names)
    kind = F.element_at(F.split("file", "/"), -2)
    problem = F.coalesce(F.element_at(F.split("problem", ":"), 1), F.lit("none"))
    return found.groupBy(kind.alias("kind"), problem.alias("problem")).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows")
    )


@query
def holiday_events(spark, sf):
    """Holiday calendar of the years the events cover, with the events of each day."""
    events = driver.table(spark, sf, "events")
    year = events.agg(F.min(F.year("ts")).alias("a"), F.max(F.year("ts")).alias("z"))
    dates = calendar.holiday_calendar(
        calendar.rules_table(spark), year.select("a").scalar(), year.select("z").scalar()
    )
    per_day = events.groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))
    return dates.join(per_day, "date", "left").fillna(0, ["n"])


@query
def order_year_holidays(spark, sf):
    """Holiday calendar of all order years, with the orders placed on each holiday."""
    orders = driver.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"))
    year = orders.agg(F.min(F.year("date")).alias("a"), F.max(F.year("date")).alias("z"))
    dates = calendar.holiday_calendar(
        calendar.rules_table(spark), year.select("a").scalar(), year.select("z").scalar()
    )
    per_day = orders.groupBy("date").agg(F.count("*").alias("n"))
    return dates.join(per_day, "date", "left").fillna(0, ["n"])


def _month_files(df: DataFrame, ts: str) -> DataFrame:
    name = F.concat(
        F.lit("raw/"), text.month_name_key(F.year(ts), F.month(ts)), F.lit("-orders.csv")
    )
    return df.select(name.alias("path")).distinct()


@query
def pending_archives(spark, sf):
    """Shipped months in which nothing was ordered yet, by the month in the file name."""
    key = text.month_prefix(text.base_name(F.col("path")))
    manifest = _month_files(driver.table(spark, sf, "lineitem"), "l_shipdate").withColumn("month", key)
    done = _month_files(driver.table(spark, sf, "orders"), "o_orderdate").select(key.alias("month"))
    return results.pending(manifest, done, ["month"])


@query
def appended_results(spark, sf):
    """Two batches of scores appended to one table."""
    path = shared_dir(spark, "append")
    metrics = sinks.materialize(driver.lag_metrics(spark, sf), "scores")
    sinks.append_result(metrics.where("split = 'val'"), path)
    sinks.append_result(metrics.where("split = 'test'"), path)
    return sinks.read_results(spark, path, S.METRICS)


@query
def best_params_json(spark, sf):
    """Best forecast written as a JSON object and read back."""
    path = shared_dir(spark, "best")
    val = driver.lag_metrics(spark, sf).where("split = 'val'").withColumnRenamed("rmse", "val_rmse")
    sinks.write_best(results.best_trial(val.withColumn("trial", F.col("model")), ["model", "mae"]), path)
    return spark.read.schema("best_val_rmse double, model string, mae double").json(path)


# Cleaning


def _dirty(spark, sf):
    """Trips as text with unreadable times, missing ids and times outside the range."""
    n = F.col("ride_id").cast("long")
    rows = driver.rides(spark, sf)
    stamp = F.col("started_at").cast("string")
    return rows.select(
        "ride_id",
        F.when(n % 97 == 0, "not a time").when(n % 89 == 0, None).otherwise(stamp).alias("started_at"),
        F.when(n % 83 != 0, F.col("start_station_id")).alias("start_station_id"),
    )


CUT = ("2024-01-03 00:00:00", "2024-01-28 12:59:59")


@query
def valid_trips(spark, sf):
    return clean.valid_trips(_dirty(spark, sf)).select("ride_id", "start_station_id")


@query
def trips_in_range(spark, sf):
    kept = clean.between_times(clean.valid_trips(_dirty(spark, sf)), *CUT)
    return kept.select("ride_id", "start_station_id")


@query
def quality_report(spark, sf):
    return quality.quality_report(_dirty(spark, sf), *CUT, driver.TZ)


@query
def null_report(spark, sf):
    return quality.null_report(_dirty(spark, sf), ["ride_id", "started_at", "start_station_id"])


@query
def dst_edge_report(spark, sf):
    return clean.dst_edge_report(driver.shifted_trips(spark, sf), driver.TZ)


@query
def dst_edges_dropped(spark, sf):
    """Counts per hour around the clock changes, through the looked-up change times."""
    kept = clean.drop_dst_edges(
        driver.shifted_trips(spark, sf), driver.TZ, lo="2024-01-01", hi="2024-12-31"
    )
    return kept.groupBy(clock.floor_hour("started_at").alias("datetime")).agg(F.count("*").alias("n"))


@query
def dst_edges_converted(spark, sf):
    """The same rows, found by converting every time."""
    kept = clean.drop_dst_edges(driver.shifted_trips(spark, sf), driver.TZ)
    return kept.groupBy(clock.floor_hour("started_at").alias("datetime")).agg(F.count("*").alias("n"))


@query
def utc_to_wall_clock(spark, sf):
    """Event times read as UTC text, shown on the local clock, per hour."""
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))
    local = clock.instant_to_wall(stamp, driver.TZ).alias("t")
    events = driver.table(spark, sf, "events").select(local)
    return events.groupBy(clock.floor_hour("t").alias("datetime")).agg(F.count("*").alias("n"))


# Counts and dimension


@query
def hourly_counts(spark, sf):
    return driver.counts(spark, sf)


@query
def daily_item_counts(spark, sf):
    return driver.supplier_counts(spark, sf)


@query
def station_dimension(spark, sf):
    return counts.station_dim(driver.cleaned(spark, sf, driver.trips(spark, sf)))


@query
def station_dimension_late_names(spark, sf):
    """The same dimension with names joined after the aggregation."""
    return driver.dim(spark, sf)


@query
def station_one_name(spark, sf):
    return counts.one_name_per_key(driver.dim(spark, sf))


@query
def renamed_stations(spark, sf):
    return joins.fan_out_report(driver.dim(spark, sf))


@query
def hourly_demand(spark, sf):
    return driver.hourly(spark, sf)


@query
def hourly_demand_fan_out(spark, sf):
    """Every (id, name) row joined: renamed stations appear twice."""
    return driver.hourly(spark, sf, dedupe=False)


@query
def describe_hourly(spark, sf):
    cols = ["departures", "temperature", "precipitation", "snow_depth", "start_lat", "is_holiday"]
    return quality.describe_numeric(sinks.materialize(driver.hourly(spark, sf), "hourly"), cols)


@query
def holiday_flags(spark, sf):
    flagged = joins.flag_dates(driver.counts(spark, sf), driver.holidays(spark))
    return flagged.groupBy("is_holiday").agg(
        F.count("*").alias("n"), F.sum("departures").alias("departures")
    )


@query
def holiday_rows(spark, sf):
    return joins.on_dates(driver.counts(spark, sf), driver.holidays(spark))


@query
def first_event_per_user(spark, sf):
    events = driver.table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return counts.first_per_key(events, ["user_id"], ["ts", "event_id"]).drop("ts")


@query
def distinct_hours(spark, sf):
    """One row per hour of the hourly table."""
    hourly = driver.hourly(spark, sf).select("datetime", *S.HOUR_COLS)
    return counts.distinct_on(hourly, ["datetime"], S.HOUR_COLS)


@query
def union_by_name(spark, sf):
    """Two batches of trips with their columns in different order."""
    rows = driver.rides(spark, sf).select("ride_id", "start_station_id", "start_lat")
    even = F.col("ride_id").cast("long") % 2 == 0
    return rows.where(even).unionByName(
        rows.where(~even).select("start_lat", "start_station_id", "ride_id")
    )


@query
def quiet_customers(spark, sf):
    """Set difference: customers without an event."""
    ids = driver.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return results.pending(ids, driver.table(spark, sf, "events"), ["user_id"])


# Panel and features


def _panel(spark, sf):
    n = driver.counts(spark, sf)
    return panel.fill_grid(panel.build_grid(demand.keys_of(n), driver.span(spark, sf)), n)


@query
def dense_grid(spark, sf):
    n = driver.counts(spark, sf)
    return panel.build_grid(demand.keys_of(n), driver.span(spark, sf))


@query
def zero_filled_grid(spark, sf):
    return _panel(spark, sf)


@query
def density_report(spark, sf):
    return panel.density_report(_panel(spark, sf), driver.span(spark, sf))


@query
def lagged_panel(spark, sf):
    """Lags over an existing dense panel."""
    return panel.add_lags(_panel(spark, sf), driver.span(spark, sf))


@query
def lagged_panel_small_blocks(spark, sf):
    """Grid, fill and lags in one plan, cut into blocks of three days."""
    days = driver.span(spark, sf)
    span = panel.Span(days.lo, days.hi, block_days=3)
    n = driver.counts(spark, sf)
    return panel.dense_panel(demand.keys_of(n), n, span)


@query
def daily_item_panel(spark, sf):
    """Supplier x day panel with lags of 1, 2 and 7 days."""
    n = driver.supplier_counts(spark, sf)
    keys = demand.keys_of(n, "supplier_id", "items")
    return panel.dense_panel(
        keys, n, driver.supplier_span(spark, sf), "supplier_id", "day", "items", (1, 2, 7)
    )


@query
def features_table(spark, sf):
    return driver.features(spark, sf)


@query
def model_table(spark, sf):
    return demand.cast_features(driver.model_features(spark, sf))


@query
def refilled_features(spark, sf):
    """A finished feature table with its hour attributes filled afterwards."""
    rows = demand.refill(driver.features(spark, sf), driver.span(spark, sf))
    return rows.select("station_id", "datetime", *S.HOUR_COLS)


@query
def filled_hours(spark, sf):
    n = driver.counts(spark, sf)
    hours = demand.hour_dim(demand.hours_of(n), driver.weather(spark, sf), driver.holidays(spark))
    return demand.filled_hours(hours, driver.span(spark, sf))


@query
def calendar_features(spark, sf):
    rows = driver.table(spark, sf, "events").select("event_id", F.col("ts").alias("datetime"))
    return demand.calendar_columns(rows).drop("datetime")


@query
def split_sizes(spark, sf):
    return counts.split_counts(driver.features(spark, sf))


@query
def split_selection(spark, sf):
    rows = clean.for_split(driver.features(spark, sf), "val", "test")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.sum("departures").alias("departures"))


@query
def feature_vectors(spark, sf):
    """Model inputs as one vector, taken apart again."""
    rows = demand.cast_features(driver.model_features(spark, sf))
    v = vector_to_array("features")
    return linear.assemble(rows).select(
        *ROW, *[v[i].alias(f"x{i:02d}") for i in range(len(S.FEATURES))]
    )


# Scores


@query
def naive_scores(spark, sf):
    return results.evaluate(results.naive(driver.features(spark, sf)), "naive")


@query
def daily_item_naive_scores(spark, sf):
    """Persistence forecast on the supplier x day panel, scored per year."""
    n = driver.supplier_counts(spark, sf)
    rows = panel.dense_panel(
        demand.keys_of(n, "supplier_id", "items"),
        n, driver.supplier_span(spark, sf), "supplier_id", "day", "items", (1, 2, 7),
    )
    scored = results.naive(rows.withColumn("split", F.year("day").cast("string")), "lag_7d")
    return results.evaluate(scored, "lag_7d", y="items")


@query
def lag_scores(spark, sf):
    return driver.lag_metrics(spark, sf)


@query
def leaderboard(spark, sf):
    return results.leaderboard(driver.lag_metrics(spark, sf))


@query
def improvement_over_naive(spark, sf):
    return results.improvement(sinks.materialize(driver.lag_metrics(spark, sf), "scores"), "lag_1h")


@query
def metrics_upsert(spark, sf):
    """A model's scores replaced and a new model added, twice over, in a versioned table."""
    path = shared_dir(spark, "metrics")
    all_ = sinks.materialize(driver.lag_metrics(spark, sf), "scores")
    rerun = all_.where("model = 'blend'").withColumn("model", F.lit("lag_24h"))
    new = rerun.unionByName(all_.where("model = 'blend'"))
    sinks.upsert_versioned(all_.where("model <> 'blend'"), path, ["model"])
    sinks.upsert_versioned(new, path, ["model"])
    return sinks.upsert_versioned(new, path, ["model"])


def _one_input(name):
    return lambda train, val: linear.fit_ridge(train, [name], alpha=50.0, scale=False)


# A trainer that SQL can state: the ridge on one input.
CURVE_TRAINERS = {"ridge_lag_1h": _one_input("lag_1h")}


def _curve_parts(spark, sf, name):
    """The three splits with the keys, the target and the one input that the trainer reads."""
    rows = sinks.materialize(_model_rows(spark, sf).select(*ROW, "split", "departures", name), "rows")
    return [clean.for_split(rows, s) for s in ("train", "val", "test")]


def _runs(spark, sf, fractions=S.FRACTIONS):
    """Finished runs of a learning curve over nested samples."""
    parts = _curve_parts(spark, sf, "lag_1h")
    return curve.learning_curve(
        spark, *parts, list(CURVE_TRAINERS), CURVE_TRAINERS, fractions, path=shared_dir(spark, "curve"), method="md5"
    )


@query
def pending_runs(spark, sf):
    """Runs of the curve's plan that are not among those finished so far."""
    done = _runs(spark, sf, S.FRACTIONS[:2])
    plan = [(m, float(f)) for m in CURVE_TRAINERS for f in S.FRACTIONS]
    return results.pending_runs(spark.createDataFrame(plan, "model string, fraction double"), done)


@query
def curve_table(spark, sf):
    return results.curve_table(_runs(spark, sf))


@query
def curve_endpoints(spark, sf):
    return results.curve_endpoints(_runs(spark, sf))


@query
def curve_ticks(spark, sf):
    t = results.ticks(_runs(spark, sf))
    return t.select("model", F.array_join(F.transform("ticks", lambda x: x.cast("string")), ",").alias("ticks"))


@query
def labelled_shares(spark, sf):
    """Event types as features: label lookup with fallback, share of the total, top three."""
    table = driver.table(spark, sf, "events").groupBy(F.col("event_type").alias("feature")).agg(
        F.count("*").alias("splits"), F.sum("value").alias("gain")
    )
    labels = {"click": "Click", "view": "View", "signup": "Sign up"}
    shared = results.with_share(joins.with_labels(table, labels), "gain", "gain_pct")
    return results.flag_top(shared, "gain", ["feature"])


@query
def label_table(spark, sf):
    """Customers per nation code; nations of the last region are left out and keep their code."""
    n = driver.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("feature")).agg(
        F.count("*").alias("n")
    )
    known = driver.table(spark, sf, "nation").where("n_regionkey < 4")
    labels = known.selectExpr("n_nationkey AS feature", "n_name AS label")
    return joins.with_label_table(n, labels)


@query
def report_labels(spark, sf):
    """Label and number formats on an hourly report."""
    events = driver.table(spark, sf, "events")
    n = events.groupBy(F.hour("ts").alias("hour")).agg(
        F.count("*").alias("n"), F.max("value").alias("top"), F.max("event_type").alias("kind")
    )
    dow = F.pmod(F.col("hour"), F.lit(7))
    return n.select(
        "hour",
        text.clock_label(F.col("hour")).alias("clock"),
        text.lookup(dow, S.DOW_LABELS).alias("weekday"),
        text.human(F.col("n") * 1_000).alias("thousands"),
        text.human(F.col("n") * 100_000).alias("millions"),
        text.percent(F.round(F.col("top"), 0)).alias("percent"),
        text.short(F.col("kind"), 3).alias("short"),
        F.array_join(text.name_list(F.concat(F.lit(" Ridge,RF , "), "kind")), "|").alias("names"),
        F.bround(F.col("n") / 8, 2).alias("eighths"),
    )


# Reports


# A report that reads its input once takes it straight from the log; one that reads it several times
# takes it from a written table, as a job would that has several reports to make.


def _test(spark, sf):
    return clean.for_split(driver.scored(spark, sf), "test")


def _held_out(spark, sf):
    return clean.for_split(driver.scored(spark, sf), "val", "test")


PAIR = ["departures", "pred"]


def _stored_test(spark, sf, *cols):
    return sinks.materialize(_test(spark, sf).select(*cols), "scored")


@query
def residual_summary(spark, sf):
    return diagnostics.residual_summary(_test(spark, sf))


@query
def residual_histogram(spark, sf):
    return diagnostics.residual_histogram(_stored_test(spark, sf, *PAIR))


@query
def scatter_sample(spark, sf):
    return diagnostics.scatter_sample(_stored_test(spark, sf, *ROW, *PAIR), 3_000, S.SEED, method="md5")


@query
def bucket_error(spark, sf):
    return binning.bucket_error(_test(spark, sf), S.BUCKET_EDGES, S.BUCKET_LABELS)


@query
def item_bucket_error(spark, sf):
    """Buckets of the items per supplier and day, where every bucket but the first two is rare."""
    n = driver.supplier_counts(spark, sf).select(
        F.col("items").alias("departures"), (F.col("items") * 0.5 + 1.0).alias("pred")
    )
    return binning.bucket_error(n, S.BUCKET_EDGES, S.BUCKET_LABELS)


@query
def error_by_hour(spark, sf):
    by_hour = diagnostics.error_by(_held_out(spark, sf), "hour_of_day")
    return by_hour.withColumn("label", text.clock_label(F.col("hour_of_day")))


@query
def error_by_weekday(spark, sf):
    return diagnostics.error_by(_held_out(spark, sf), "day_of_week", S.DOW_LABELS)


@query
def error_by_month(spark, sf):
    return diagnostics.error_by(_held_out(spark, sf), "month", {1: "Jan (val, test)"})


def _entities(spark, sf):
    return diagnostics.entity_error(_test(spark, sf), min_support=90)


def _stored_entities(spark, sf):
    return sinks.materialize(_entities(spark, sf), "entities")


@query
def entity_error(spark, sf):
    return _entities(spark, sf)


@query
def worst_entities(spark, sf):
    return diagnostics.top_entities(_entities(spark, sf), 10, worst=True)


@query
def best_entities(spark, sf):
    return diagnostics.top_entities(_entities(spark, sf), 10, worst=False)


@query
def error_trend(spark, sf):
    return diagnostics.error_trend(_entities(spark, sf))


@query
def error_trend_line(spark, sf):
    return diagnostics.trend(_entities(spark, sf))


@query
def geo_error(spark, sf):
    return diagnostics.geo_error(_stored_entities(spark, sf))


@query
def entity_summary(spark, sf):
    return diagnostics.entity_summary(_stored_entities(spark, sf))


@query
def value_quantiles(spark, sf):
    events = driver.table(spark, sf, "events")
    return quantile.exact_quantiles(events, "value", [0.05, 0.5, 0.9, 0.95])


@query
def price_quantiles_by_flag(spark, sf):
    """Exact quantiles of a large column in few groups."""
    items = driver.table(spark, sf, "lineitem")
    return quantile.exact_quantiles(items, "l_extendedprice", [0.05, 0.5, 0.9, 0.95], ["l_returnflag"])


@query
def price_quantiles_by_order(spark, sf):
    """Exact quantiles in as many groups as there are orders."""
    items = driver.table(spark, sf, "lineitem")
    return quantile.exact_quantiles(items, "l_extendedprice", [0.05, 0.5, 0.9], ["l_orderkey"])


@query
def hexbin_density(spark, sf):
    return binning.hexbin(_stored_test(spark, sf, *PAIR))


@query
def hexbin_items(spark, sf):
    """Hexagon counts of quantity against a tenth of the discounted price, in thousands."""
    items = driver.table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("departures"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 10_000.0).alias("pred"),
    )
    return binning.hexbin(items, gridsize=30, cap=40.0, min_count=2)


@query
def total_series(spark, sf):
    return diagnostics.total_series(_test(spark, sf))


@query
def daily_totals(spark, sf):
    return diagnostics.daily_totals(diagnostics.total_series(_stored_test(spark, sf, "datetime", *PAIR)))


@query
def daily_order_totals(spark, sf):
    """Daily totals of all orders; a day without orders comes out as 0."""
    rows = driver.table(spark, sf, "orders").select(
        F.col("o_orderdate").alias("datetime"),
        F.lit(1).alias("departures"),
        F.round(F.col("o_totalprice"), 0).alias("pred"),
    )
    return diagnostics.daily_totals(rows)


@query
def daily_error(spark, sf):
    return diagnostics.daily_error(diagnostics.total_series(_stored_test(spark, sf, "datetime", *PAIR)))


@query
def focus_entity(spark, sf):
    return diagnostics.focus_entity(_test(spark, sf), min_support=90)


@query
def focus_series(spark, sf):
    return diagnostics.focus_series(_stored_test(spark, sf, *ROW, "station_name", *PAIR), min_support=90)


@query
def focus_error(spark, sf):
    return diagnostics.focus_error(_stored_test(spark, sf, *ROW, "station_name", *PAIR), min_support=90)


# Samples


def _stored_train(spark, sf):
    rows = clean.for_split(driver.features(spark, sf), "train").select(*ROW, "departures")
    return sinks.materialize(rows, "train")


@query
def uniform_sample(spark, sf):
    rows = _stored_train(spark, sf)
    return sampling.sample_exact(rows, 5_000, S.SEED, ROW, "md5").select(*ROW, "departures")


@query
def nested_sample(spark, sf):
    rows = _stored_train(spark, sf)
    large = sampling.sample_exact(rows, 5_000, S.SEED, ROW, "md5")
    return sampling.sample_exact(large, 1_000, S.SEED, ROW, "md5").select(*ROW, "departures")


@query
def sampled_line_items(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = driver.table(spark, sf, "lineitem").select(*keys)
    return sampling.sample_exact(rows, 20_000, 7, keys, "md5")


# Models


@query
def standardized_inputs(spark, sf):
    """Scaling fitted on the training rows, applied to the test rows."""
    cols = ["temperature", "lag_1h", "lag_24h", "start_lat"]
    rows = sinks.materialize(driver.model_features(spark, sf).select(*ROW, "split", *cols), "rows")
    stats = linear.standardize(clean.for_split(rows, "train"), cols)
    return linear.apply_standard(clean.for_split(rows, "test"), stats, cols).select(*ROW, *cols)


def _ridge(spark, sf, scale: bool):
    rows = driver.model_features(spark, sf).select("split", "departures", "lag_24h")
    rows = sinks.materialize(rows, "rows")
    model = linear.fit_ridge(clean.for_split(rows, "train"), ["lag_24h"], alpha=50.0, scale=scale)
    return results.evaluate(model.transform(rows), "ridge")


@query
def ridge_one_input(spark, sf):
    return _ridge(spark, sf, scale=True)


@query
def ridge_one_input_unscaled(spark, sf):
    return _ridge(spark, sf, scale=False)


def _model_rows(spark, sf):
    return demand.cast_features(driver.model_features(spark, sf)).select(
        *ROW, "split", "departures", *S.FEATURES
    )


def _parts(spark, sf):
    """Feature table written once, then read per split: training does not rebuild it."""
    rows = sinks.materialize(_model_rows(spark, sf), "rows")
    return rows, clean.for_split(rows, "train"), clean.for_split(rows, "val")


def _report(model, rows, name):
    """Per split: rows, clipped predictions below 0, and whether the model beats the naive forecast."""
    # Rows are scored once for both tables.
    predicted = sinks.materialize(model.transform(rows).select("split", "departures", "prediction"), "predicted")
    scored = results.evaluate(predicted, name).select("split", F.col("rmse").alias("own"))
    base = results.evaluate(results.naive(rows), "naive").select("split", F.col("rmse").alias("base"))
    clipped = F.greatest(F.col("prediction"), F.lit(0.0))
    n = predicted.groupBy("split").agg(
        F.count("*").alias("n"), F.count_if(clipped < 0).alias("n_negative"),
        F.count_if(F.col("prediction").isNull()).alias("n_missing"),
    )
    return n.join(scored, "split").join(base, "split").select(
        F.lit(name).alias("model"), "split", "n", "n_negative", "n_missing", (F.col("own") < F.col("base")).alias("beats_naive")
    )


def _fit_and_report(spark, sf, name, fit):
    rows, train, val = _parts(spark, sf)
    return _report(fit(train, val), clean.for_split(rows, "val", "test"), name)


@query
def ridge_scores(spark, sf):
    """Scores of the scaled ridge over all inputs."""
    rows, train, _ = _parts(spark, sf)
    return results.evaluate(linear.fit_ridge(train).transform(clean.for_split(rows, "val", "test")), "ridge")


@query
def ridge_normal_equations(spark, sf):
    """How well the ridge over all inputs solves its normal equations, term by term.

    For standardised inputs z the residuals e satisfy sum(e) = 0 and sum(z * e) = alpha * w; each term
    is given as off or not by more than a millionth of the table's size.
    """
    rows, train, _ = _parts(spark, sf)
    alpha = 1.0
    model = linear.fit_ridge(train, alpha=alpha)
    weights, stats = model.stages[-1], linear.standardize(train, S.FEATURES)
    unclipped = model.transform(train)
    e = F.col("departures") - F.col("prediction")
    terms = [F.sum(e).alias("e"), F.count("*").alias("n")]
    terms += [F.sum(e * F.col(c).cast("double")).alias(f"e_{c}") for c in S.FEATURES]
    moments = stats.first().asDict()
    got = unclipped.agg(*terms).first()
    # A short list: one row per input.
    out = [("intercept", abs(got["e"]) > 1e-6 * got["n"])]
    for c, w in zip(S.FEATURES, weights.coefficients.toArray()):
        mean, scale = moments[f"{c}_mean"], moments[f"{c}_scale"]
        gradient = (got[f"e_{c}"] - mean * got["e"]) / scale
        out.append((c, abs(gradient - alpha * float(w) * scale) > 1e-6 * got["n"]))
    return spark.createDataFrame(out, "term string, is_off boolean")


@query
def forest_scores(spark, sf):
    """The forest at its reported setting."""
    return _fit_and_report(spark, sf, "forest", lambda train, val: trees.fit_rf(train, **trees.FOREST))


@query
def boost_scores(spark, sf):
    """Boosting at its reported setting, stopped early."""
    return _fit_and_report(spark, sf, "boost", lambda train, val: trees.fit_gbt(train, val, **trees.BOOST))


@query
def boost_leaves_scores(spark, sf):
    """Boosting with a least number of rows per leaf at its reported setting, stopped early."""
    return _fit_and_report(spark, sf, "leaves", lambda train, val: trees.fit_gbt(train, val, **trees.BOOST_LEAVES))


# Inputs of few different values: every threshold between two of them is tried.
FEW_VALUES = ["hour_of_day", "day_of_week", "is_weekend", "is_holiday", "lag_1h", "lag_2h", "lag_24h"]


@query
def tree_gains(spark, sf):
    """The first split of a boosted tree on each input alone: threshold, gain and both leaf means."""
    rows = sinks.materialize(_model_rows(spark, sf).select("split", S.TARGET, *FEW_VALUES), "rows")
    train = clean.for_split(rows, "train")
    codes = boosting.quantised(train, None, FEW_VALUES, S.TARGET, trees.BOOST["bins"])
    out = []
    for name in FEW_VALUES:
        model = trees.fit_gbt(train, None, [name], codes=codes, rounds=1, depth=1, step=1.0, rows=1.0, columns=1.0)
        start, tree = (importance.nodes(spark, model).where(F.col("treeID") == k) for k in (0, 1))
        mean = start.select(F.col("nodeData.prediction").alias("mean"))
        tree = tree.select("nodeData.*")
        top = tree.where("leftChild >= 0").select(
            F.lit(name).alias("feature"), F.col("split.leftCategoriesOrThreshold")[0].alias("threshold"),
            "gain", F.col("rawCount").alias("n"), "leftChild", "rightChild",
        )
        left = tree.select(F.col("id").alias("leftChild"), F.col("rawCount").alias("n_left"), F.col("prediction").alias("left"))
        right = tree.select(F.col("id").alias("rightChild"), F.col("prediction").alias("right"))
        out.append(top.join(left, "leftChild").join(right, "rightChild").crossJoin(F.broadcast(mean)))
    return reduce(DataFrame.unionByName, out).select(
        "feature", "threshold", (F.col("gain") * 1000).alias("gain"), "n", "n_left",
        (F.col("mean") + F.col("left")).alias("left_mean"), (F.col("mean") + F.col("right")).alias("right_mean"),
    )


# Rounds, step and penalties under which the leaves of a two-valued input have a closed form.
CLOSED_FORM = {"rounds": 7, "step": 0.3, "depth": 1, "l1": 2.0, "l2": 50.0, "rows": 1.0, "columns": 1.0}


@query
def boost_closed_form(spark, sf):
    """Predictions of a few penalised rounds on one two-valued input."""
    train = clean.for_split(sinks.materialize(_model_rows(spark, sf), "rows"), "train")
    model = trees.fit_gbt(train, None, ["is_weekend"], **CLOSED_FORM)
    return model.transform(train).groupBy(F.col("is_weekend").cast("long").alias("is_weekend")).agg(
        F.count("*").alias("n"), (F.avg("prediction") * 1000).alias("prediction")
    )


@query
def mlp_scores(spark, sf):
    """The network at its reported setting."""
    return _fit_and_report(spark, sf, "mlp", lambda train, val: mlp.fit_mlp(train))


def _boosted(spark, sf):
    rows, train, val = _parts(spark, sf)
    return rows, trees.fit_gbt(train, val, **trees.BOOST)


@query
def feature_importance(spark, sf):
    """Names and labels of all inputs, whose shares add up to 100 and whose ranks follow the gain."""
    table = importance.tree_importance(spark, _boosted(spark, sf)[1])
    total = table.agg(F.sum("gain_pct").alias("g"), F.sum("splits_pct").alias("s"), F.count_if("is_top").alias("t"))
    return table.crossJoin(F.broadcast(total)).select(
        "feature", "label", F.round("g", 3).alias("gain_total"), F.round("s", 3).alias("splits_total"),
        F.col("t").alias("n_top"), (F.col("gain") >= 0).alias("is_counted"),
    )


@query
def saved_model_scores(spark, sf):
    """Rows whose prediction differs after a boosted model was saved and loaded: none."""
    rows, model = _boosted(spark, sf)
    path = shared_dir(spark, "model")
    sinks.save_model(model, path)
    test = clean.for_split(rows, "test")
    before = model.transform(test).select(*ROW, F.col("prediction").alias("before"))
    after = sinks.load_model(path).transform(test).select(*ROW, F.col("prediction").alias("after"))
    return before.join(after, ROW).agg(
        F.count("*").alias("n"), F.count_if(F.col("before") != F.col("after")).alias("n_differing")
    )


def _search(spark, sf, n_trials=search.TRIALS):
    rows, train, val = _parts(spark, sf)
    return rows, search.search(spark, train, val, n_trials=n_trials)


def _search_report(trials):
    best = search.best_params(trials).select(F.col("best_val_rmse"))
    inside = F.lit(True)
    for name, p in search.SPACE.items():
        inside = inside & (F.col(name).isin(*p.options) if p.options else F.col(name).between(p.low, p.high))
    return trials.crossJoin(F.broadcast(best)).select(
        "trial", inside.alias("in_space"), (F.col("val_rmse") >= F.col("best_val_rmse")).alias("not_better")
    )


# The SQL of hyper_parameter_search states two trials; hyper_parameter_search_whole runs all.
SQL_TRIALS = 2


@query
def hyper_parameter_search(spark, sf):
    """Trials within the space, and whether the best one is marked by the smallest error."""
    return _search_report(sinks.materialize(_search(spark, sf, SQL_TRIALS)[1], "trials"))


@query
def hyper_parameter_search_whole(spark, sf):
    """All trials of the reported search, and whether each beats the naive forecast."""
    rows, trials = _search(spark, sf)
    trials = sinks.materialize(trials, "trials")
    val = results.evaluate(results.naive(clean.for_split(rows, "val")), "naive").select(F.col("rmse").alias("base"))
    beats = trials.crossJoin(F.broadcast(val)).select("trial", (F.col("val_rmse") < F.col("base")).alias("beats_naive"))
    return _search_report(trials).join(beats, "trial")


@query
def best_trial_refit(spark, sf):
    """Best trial's parameters, refitted on all training rows."""
    rows, trials = _search(spark, sf)
    best = search.best_params(trials).first().asDict()
    train, val = clean.for_split(rows, "train"), clean.for_split(rows, "val")
    model = search.refit_best(train, val, best)
    return _report(model, clean.for_split(rows, "val", "test"), "tuned")


@query
def learning_curve(spark, sf):
    """Learning curve of the one-input ridge over nested samples, resumed halfway."""
    parts = _curve_parts(spark, sf, "lag_24h")
    layout = curve.nested_layout(parts[0], ROW, S.SEED, "md5")
    trainers = {"ridge": lambda train, val: linear.fit_ridge(train, ["lag_24h"], alpha=50.0, scale=False)}
    path = shared_dir(spark, "curve")
    curve.learning_curve(spark, *parts, ["ridge"], trainers, S.FRACTIONS[:2], path=path, method="md5", layout=layout)
    runs = curve.learning_curve(spark, *parts, ["ridge"], trainers, path=path, method="md5", layout=layout)
    return runs.drop("elapsed_s")


@query
def learning_curve_trainers(spark, sf):
    """Learning curve of all five trainers at their reported settings over nested samples."""
    rows, train, val = _parts(spark, sf)
    held = clean.for_split(rows, "test")
    runs = curve.learning_curve(spark, train, val, held, list(curve.TRAINERS), path=shared_dir(spark, "curve"))
    return runs.drop("elapsed_s")


# Incremental ingest


@query
def streamed_hourly_counts(spark, sf):
    """Hourly counts over files that arrive in two steps; the second run reads only the new ones."""
    base = shared_dir(spark, "arrivals")
    rows = driver.events_as_csv_rows(spark, sf)
    late = F.col("ride_id").cast("long") % 2 == 1
    for step, part in {"first": rows.where(~late), "second": rows.where(late)}.items():
        part.write.option("header", True).csv(f"{base}/{step}")
        ingest.ingest_new_files(spark, f"{base}/*", f"{base}-state", f"{base}-table")
    return counts.hourly_counts(ingest.read_ingested(spark, f"{base}-table"))


@query
def refreshed_panel(spark, sf):
    """The lagged panel after two ingests; the second refresh replaces only what the late files touch."""
    base = shared_dir(spark, "refresh")
    rows = driver.events_as_csv_rows(spark, sf)
    days = driver.span(spark, sf)
    span = panel.Span(days.lo, days.hi, block_days=3)
    late = F.col("started_at") >= F.date_format(F.lit(days.hi).cast("timestamp_ntz") - F.expr("INTERVAL 4 DAYS"), "yyyy-MM-dd")
    for step, part in {"first": rows.where(~late), "second": rows.where(late)}.items():
        part.write.option("header", True).csv(f"{base}/{step}")
        ingest.ingest_new_files(spark, f"{base}/*", f"{base}-state", f"{base}-table")
        refresh.refresh(spark, f"{base}-table", f"{base}-store", span)
    return refresh.read_panel(spark, f"{base}-store")


@query
def naive_from_log(spark, sf):
    """Scores of the naive forecast by split, from the event log in one plan."""
    rows = results.naive(driver.features(spark, sf))
    y, p = "departures", "prediction"
    return rows.groupBy("split").agg(
        F.count("*").alias("n"), rmse(y, p).alias("rmse"), mae(y, p).alias("mae")
    )
