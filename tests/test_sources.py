import bz2
import gzip
import io
import time
import zipfile
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from hourloom import schema as S
from hourloom.operators import joins, results
from hourloom.plans import driver
from hourloom.sources import archives, files, sinks, tables
from hourloom.streaming import ingest

HEAD = "ride_id,rideable_type,started_at,start_station_name,start_station_id,start_lat,start_lng"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_header_drift(spark, tmp_path):
    write(tmp_path / "a.csv", f"{HEAD}\n1,bike,2024-01-01 00:10:00,Alpha,007.10,1.5,2.5\n")
    write(
        tmp_path / "b.csv",
        "start_lng,start_lat,start_station_id,start_station_name,started_at,ride_id\n"
        '4,3,B,"Beta, East",2024-01-02 10:00:00.25,2\n5,x,C,,bad,3\n',
    )
    write(tmp_path / "c.csv", "ride_id,start_station_id\n9,Z\n")
    df = tables.read_trips(spark, f"{tmp_path}/*.csv")
    assert df.schema == S.TRIPS
    got = {r.ride_id: r for r in df.collect()}
    assert set(got) == {"1", "2", "3"}
    assert got["1"].start_station_id == "007.10" and got["1"].start_lat == 1.5
    assert got["2"].start_station_name == "Beta, East" and str(got["2"].started_at).endswith(".250000")
    assert got["3"].started_at is None and got["3"].start_lat is None and got["3"].start_lng == 5.0
    skipped = files.skipped_files(spark, f"{tmp_path}/*.csv", S.TRIPS.names).collect()
    assert [r.file.rsplit("/", 1)[1] for r in skipped] == ["c.csv"] and "started_at" in skipped[0].reason
    with pytest.raises(ValueError):
        tables.read_trips(spark, f"{tmp_path}/*.csv", on_bad_file="fail")


def test_no_input_raises(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.read_trips(spark, f"{tmp_path}/*.csv")
    with pytest.raises(FileNotFoundError):
        archives.read_zipped_csv(spark, f"{tmp_path}/*.zip")


def test_bad_rows_are_counted(spark, tmp_path):
    write(tmp_path / "a.csv", f"{HEAD}\n1,b,2024-01-01 00:10:00,A,1,1,2\n2,b,2024-01-01 00:10:00,A,1,1,2,9,9\n")
    got = files.bad_rows(spark, f"{tmp_path}/*.csv", S.TRIPS.names).collect()
    assert [tuple(r) for r in got] == [("a.csv", 2, 1, 0)]


def test_weather_drops_clock_change_hours(spark, tmp_path):
    rows = "\n".join(f"2024-03-10T{h:02d}:00,{h},0,0," for h in range(5))
    write(tmp_path / "w.csv", f"datetime,temperature,precipitation,snowfall,snow_depth\n{rows}\n")
    assert tables.read_weather(spark, f"{tmp_path}/w.csv").count() == 5
    kept = tables.read_weather(spark, f"{tmp_path}/w.csv", "America/New_York")
    assert sorted(r.temperature for r in kept.collect()) == [0, 1, 3, 4]
    assert kept.first().snow_depth is None


def test_missing_holiday_file(spark, sf, tmp_path):
    none = tables.read_holidays(spark, str(tmp_path / "none.csv"))
    assert none.count() == 0
    flagged = joins.flag_dates(driver.counts(spark, sf), none)
    assert flagged.where("is_holiday <> 0").count() == 0
    write(tmp_path / "h.csv", "date,holiday_name\n2024-01-01,New Year's Day\n")
    assert tables.read_holidays(spark, str(tmp_path / "h.csv")).first().holiday_name == "New Year's Day"


def trips_csv(n, start=0):
    body = "".join(f"{i},b,2024-01-01 00:10:00,A,{i % 3},1,2\n" for i in range(start, start + n))
    return f"{HEAD}\n{body}"


def test_nested_zip(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("202301-trips.csv", trips_csv(30_000))
        z.writestr("__MACOSX/._202301-trips.csv", "junk")
    with zipfile.ZipFile(tmp_path / "2023.zip", "w") as z:
        z.writestr("2023/202301-trips.zip", inner.getvalue())
        z.writestr("2023/readme.txt", "x")
    with zipfile.ZipFile(tmp_path / "flat.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("202401-trips.csv", trips_csv(500, 30_000))
        z.writestr("202402-odd.csv", "a,b\n1,2\n")
    members = archives.list_members(spark, f"{tmp_path}/*.zip")
    assert members.count() == 3
    outcomes = {r.member: (r.rows, r.problem) for r in archives.member_outcomes(members, S.TRIPS.names).collect()}
    assert outcomes["202401-trips.csv"] == (500, None) and outcomes["202402-odd.csv"][1].startswith("missing columns")
    rows = archives.read_zipped_csv(spark, f"{tmp_path}/*.zip")
    assert rows.schema == S.TRIPS
    assert tuple(rows.agg(F.count("*"), F.countDistinct("ride_id"), F.max("start_lat")).first()) == (30_500, 30_500, 1.0)
    done = spark.createDataFrame([("202301",), ("202402",)], "month_key string")
    left = archives.pending_members(members, done).collect()
    assert [r.member for r in left] == ["202401-trips.csv"]


def test_hourly_csv_keeps_wall_clock(spark, sf, tmp_path):
    path = str(tmp_path / "hourly")
    hourly = driver.hourly(spark, sf)
    sinks.write_hourly(hourly, path, "America/New_York")
    stamp = spark.read.option("header", True).csv(path).first().datetime
    assert stamp.endswith("-05:00")
    back = tables.read_hourly(spark, f"{path}/*.csv", "America/New_York")
    assert back.schema == S.HOURLY_DEMAND and back.exceptAll(hourly).count() == 0


def test_feature_store_prunes_splits(spark, sf, tmp_path):
    path = str(tmp_path / "features")
    sinks.write_features(driver.features(spark, sf), path)
    val = tables.read_features(spark, path, "val")
    plan = val._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x)
    assert "split" in scan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert {r.split for r in val.select("split").distinct().collect()} == {"val"}


def test_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "metrics")
    old = spark.createDataFrame([("a", "val", 1.0, 1.0), ("b", "val", 2.0, 2.0)], S.METRICS)
    new = spark.createDataFrame([("b", "val", 3.0, 3.0), ("c", "val", 4.0, 4.0)], S.METRICS)
    assert sinks.read_versioned(spark, path) is None
    sinks.upsert_versioned(old, path, ["model"])
    first = {tuple(r) for r in sinks.upsert_versioned(new, path, ["model"]).collect()}
    again = {tuple(r) for r in sinks.upsert_versioned(new, path, ["model"]).collect()}
    assert first == again == {("a", "val", 1.0, 1.0), ("b", "val", 3.0, 3.0), ("c", "val", 4.0, 4.0)}


def test_best_params_are_one_json_object(spark, tmp_path):
    best = results.best_trial(
        spark.createDataFrame([(0, 2.0, 7), (1, 1.5, 9), (2, 1.5, 4)], "trial int, val_rmse double, leaves int"),
        ["leaves"],
    )
    sinks.write_best(best, str(tmp_path / "best"))
    assert [r.value for r in spark.read.text(str(tmp_path / "best")).collect()] == ['{"best_val_rmse":1.5,"leaves":9}']


def test_ingest_reads_each_file_once(spark, tmp_path):
    src, state, table = (str(tmp_path / x) for x in ("in", "state", "table"))
    head = ",".join(S.TRIPS.names)
    write(tmp_path / "in" / "a.csv", f"{head}\n1,2024-01-01 00:10:00,A,Alpha,1,2\n")
    ingest.ingest_new_files(spark, src, state, table)
    ingest.ingest_new_files(spark, src, state, table)
    assert ingest.read_ingested(spark, table).count() == 1
    write(tmp_path / "in" / "b.csv", f"{head}\n2,2024-01-01 00:20:00,A,Alpha,1,2\n3,bad,A,Alpha,1,2\n")
    ingest.ingest_new_files(spark, src, state, table)
    assert sorted(r.ride_id for r in ingest.read_ingested(spark, table).collect()) == ["1", "2"]


def test_a_short_row_costs_only_itself(spark, tmp_path):
    good = trips_csv(60_000).split("\n")
    good.insert(30_000, "short,row")
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("202401-trips.csv", "\n".join(good))
    rows = archives.read_zipped_csv(spark, f"{tmp_path}/*.zip")
    assert rows.count() == 60_001 and rows.where("ride_id = 'short' AND started_at IS NULL").count() == 1


def test_broken_archives_and_members_are_left_out_whole_and_listed(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "good.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("202401-trips.csv", trips_csv(100))
    (tmp_path / "not.zip").write_text("this is no archive")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("202402-trips.csv", trips_csv(50_000))
    data = bytearray((tmp_path / "bad.zip").read_bytes())
    data[1_000_000] ^= 0xFF
    (tmp_path / "bad.zip").write_bytes(bytes(data))
    assert archives.read_zipped_csv(spark, f"{tmp_path}/*.zip").count() == 100
    outcomes = archives.member_outcomes(archives.list_members(spark, f"{tmp_path}/*.zip"), S.TRIPS.names).collect()
    problems = {r.archive.rsplit("/", 1)[1]: r.problem for r in outcomes}
    assert problems["good.zip"] is None
    assert problems["not.zip"].startswith("cannot read") and problems["bad.zip"].startswith("cannot read")


def test_a_cut_compressed_file_is_left_out_whole(spark, tmp_path):
    import gzip

    packed = gzip.compress(trips_csv(50_000).encode())
    (tmp_path / "whole.csv.gz").write_bytes(packed)
    (tmp_path / "cut.csv.gz").write_bytes(packed[: len(packed) // 2])
    write(tmp_path / "plain.csv", trips_csv(10))
    assert tables.read_trips(spark, f"{tmp_path}/*.csv*").count() == 50_010
    skipped = files.skipped_files(spark, f"{tmp_path}/*.csv*", S.TRIPS.names).collect()
    assert [(r.file.rsplit("/", 1)[1], r.reason) for r in skipped] == [("cut.csv.gz", "cannot read: EOFError")]
    got = {r.file.rsplit("/", 1)[1]: r.rows for r in files.file_outcomes(spark, f"{tmp_path}/*.csv*", S.TRIPS.names).collect()}
    assert got == {"whole.csv.gz": 50_000, "cut.csv.gz": None, "plain.csv": 10}


def test_a_quoted_comma_in_the_header(spark, tmp_path):
    write(tmp_path / "a.csv", '"a, b",c\n1,2\n')
    groups, skipped = files.group_by_header(spark, files.glob(spark, f"{tmp_path}/*.csv"), ["a, b", "c"])
    assert list(groups) == [("a, b", "c")] and not skipped


def test_upsert_goes_on_after_a_failed_write(spark, tmp_path):
    path = str(tmp_path / "metrics")
    rows = spark.createDataFrame([("a", "val", 1.0, 1.0)], S.METRICS)
    sinks.upsert_versioned(rows, path, ["model"])
    (tmp_path / "metrics" / "version=00000001").mkdir()
    assert sinks.upsert_versioned(rows, path, ["model"]).count() == 1
    assert sinks.upsert_versioned(rows, path, ["model"]).count() == 1


def test_store_addresses():
    assert archives.store_uri("s3a://b/x.zip") == "s3://b/x.zip" and archives.store_uri("file:/a/b") == "file:///a/b"
    assert archives.store_uri("/a/b") == "/a/b"


class Counted:
    """A file that keeps count of what is read of it."""

    def __init__(self, data):
        self.data, self.at = io.BytesIO(data), 0

    def read(self, n):
        piece = self.data.read(n)
        self.at += len(piece)
        return piece


def test_only_the_first_kilobytes_of_a_plain_file_are_read():
    source = Counted(f"{HEAD}\n".encode() + b"x,y\n" * 5_000_000)
    assert files._judge("a.csv", source) == (HEAD, None) and source.at <= files._PEEK
    source = Counted(b"no line end" * 1_000_000)
    assert files._judge("a.csv", source)[1] is None and source.at <= files._LONGEST_HEADER + files._PEEK
    assert files._judge("a.csv", Counted(b"")) == ("", None)


@pytest.mark.parametrize("pack,ending", [(gzip.compress, ".gz"), (bz2.compress, ".bz2")])
def test_compressed_files_are_streamed_to_their_end(pack, ending, monkeypatch):
    monkeypatch.setattr(files, "_CHUNK", 1000)
    data = pack(f"{HEAD}\n".encode() + bytes(range(256)) * 3000) + pack(b"another member\n")
    sizes = []

    class Small(Counted):
        def read(self, n):
            sizes.append(n)
            return super().read(n)

    source = Small(data)
    assert files._judge(f"a.csv{ending}", source) == (HEAD, None)
    assert source.at == len(data) and max(sizes) == 1000
    for cut in (len(data) - 5, 700, 1):
        assert files._judge(f"a.csv{ending}", Small(data[:cut]))[1].startswith("cannot read")


def test_each_member_is_opened_once(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("good.csv", trips_csv(50_000))
        z.writestr("lacking.csv", "a,b\n1,2\n")
        z.writestr("broken.csv", trips_csv(45_000, 50_000))
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        info = z.getinfo("broken.csv")
    raw[info.header_offset + 30 + 10 + info.compress_size - 200] ^= 0xFF
    (tmp_path / "a.zip").write_bytes(raw)
    log, records = str(tmp_path / "opened"), archives._records

    def noted(path, member):
        with open(log, "a") as f:
            f.write(f"{member}\n")
        yield from records(path, member)

    monkeypatch.setattr(archives, "_records", noted)
    staged = archives.stage_members(archives.list_members(spark, f"{tmp_path}/*.zip"), S.TRIPS.names)
    rows = archives.usable_rows(staged, S.TRIPS)
    assert rows.count() == 50_000 and {r.member for r in rows.select("member").distinct().collect()} == {"good.csv"}
    found = {r.member: (r.rows, r.problem) for r in archives.outcomes(staged).collect()}
    assert found["good.csv"] == (50_000, None) and found["lacking.csv"][1].startswith("missing columns")
    assert found["broken.csv"][0] is None and found["broken.csv"][1].startswith("cannot read")
    with open(log) as f:
        assert sorted(f.read().split()) == ["broken.csv", "good.csv", "lacking.csv"]


def test_two_writers_at_once_lose_no_row(spark, tmp_path):
    path = str(tmp_path / "metrics")

    def write(k):
        row = spark.createDataFrame([(f"m{k}", "val", float(k), 0.0)], S.METRICS)
        sinks.upsert_versioned(row, path, ["model"])

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(8)))
    assert sorted(r.rmse for r in sinks.read_versioned(spark, path).collect()) == [float(k) for k in range(8)]


def test_whoever_finds_the_version_taken_merges_again(spark, tmp_path, monkeypatch):
    path, claim, beaten = str(tmp_path / "metrics"), files.write_if_absent, []
    other = spark.createDataFrame([("other", "val", 9.0, 0.0)], S.METRICS)

    def late(spark, entry, text):
        if not beaten:
            beaten.append(entry)
            sinks.upsert_versioned(other, path, ["model"])
        return claim(spark, entry, text)

    monkeypatch.setattr(files, "write_if_absent", late)
    got = sinks.upsert_versioned(spark.createDataFrame([("mine", "val", 1.0, 0.0)], S.METRICS), path, ["model"])
    assert sorted(r.model for r in got.collect()) == ["mine", "other"]


def test_appended_results_stay_few_files(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert sinks.read_results(spark, path, S.METRICS).count() == 0
    for k in range(20):
        sinks.append_result(spark.createDataFrame([("m", "val", float(k), 0.0)], S.METRICS), path)
    got = sinks.read_results(spark, path, S.METRICS)
    assert sorted(r.rmse for r in got.collect()) == [float(k) for k in range(20)] and len(got.inputFiles()) == 1
    assert len(list((tmp_path / "runs").glob("data-*"))) == sinks.KEPT_VERSIONS
    assert not files.write_if_absent(spark, f"{path}/_log/00000019", "data-late")


def test_threads_of_one_driver_create_a_file_in_turn(spark, tmp_path, monkeypatch):
    inside, most, opened = [], [], files._file_system

    def slow(spark, path):
        inside.append(1)
        most.append(len(inside))
        time.sleep(0.05)
        inside.pop()
        return opened(spark, path)

    monkeypatch.setattr(files, "_file_system", slow)
    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(lambda i: files.write_if_absent(spark, f"file://{tmp_path}/one", f"t{i}"), range(4)))
    assert sum(won) == 1 and max(most) == 1
