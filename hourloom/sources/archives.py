"""CSV members of zip archives, also of zips inside zips, read without unpacking to disk.

A member is read once, and to its end before any row of it counts: its rows are staged, a closing row says
how it ended, and only members that ended well give rows. ``member_outcomes`` lists every member and every
broken archive with its rows and, where it cannot be used, the problem; a short or long row costs nothing
but its own missing or extra fields.
"""

from __future__ import annotations

import csv
import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom import schema as S
from hourloom.functions.text import base_name, month_prefix
from hourloom.operators.results import pending
from hourloom.session import materialize
from hourloom.sources import files

SEPARATOR = "!"
BROKEN = (pa.ArrowException, zipfile.BadZipFile, zlib.error, EOFError, OSError, KeyError, UnicodeDecodeError, csv.Error, NotImplementedError)
_BATCH = 20_000


store_uri, _open = files.store_uri, files.open_stored


def _is_data(name: str) -> bool:
    base = name.rsplit("/", 1)[-1]
    return name.lower().endswith(".csv") and not base.startswith("._")


def _problem(e: Exception) -> str:
    return f"cannot read: {type(e).__name__}"


def _members(archive: zipfile.ZipFile, trail: str = "") -> Iterator[tuple[str, int | None, str | None]]:
    """(member, bytes, problem); a broken zip in the zip is a member with a problem."""
    for info in archive.infolist():
        where = f"{trail}{SEPARATOR}{info.filename}" if trail else info.filename
        if _is_data(info.filename):
            yield where, info.file_size, None
        elif info.filename.lower().endswith(".zip"):
            try:
                with archive.open(info) as raw, zipfile.ZipFile(raw) as inner:
                    yield from list(_members(inner, where))
            except BROKEN as e:
                yield where, None, _problem(e)


def list_members(spark: SparkSession, pattern: str) -> DataFrame:
    """(archive, member, bytes, problem) of every CSV; each archive's directory is read by a task.

    An archive that cannot be opened is one row with a problem and no member.
    """
    paths = files.glob(spark, pattern)
    if not paths:
        raise FileNotFoundError(f"no archives match {pattern}")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["archive"]:
                try:
                    with _open(path) as raw, zipfile.ZipFile(raw) as archive:
                        found = [(path, *m) for m in _members(archive)]
                except BROKEN as e:
                    found = [(path, None, None, _problem(e))]
                yield pd.DataFrame(found, columns=["archive", "member", "bytes", "problem"]).astype({"bytes": "Int64"})

    listed = spark.createDataFrame([(p,) for p in paths], "archive string")
    tasks = min(len(paths), 4 * spark.sparkContext.defaultParallelism)
    return listed.repartition(tasks, "archive").mapInPandas(
        walk, "archive string, member string, bytes long, problem string"
    )


def pending_members(members: DataFrame, done: DataFrame) -> DataFrame:
    """Members whose month (YYYYMM at the front of the file name) is not there yet."""
    base = base_name(F.translate("member", SEPARATOR, "/"))
    named = members.where(F.col("member").isNotNull()).withColumn("month_key", month_prefix(base))
    return pending(named, done, ["month_key"])


def _records(path: str, member: str) -> Iterator[list[str]]:
    """The lines of a member as fields, header first; a quoted field may hold commas and quotes."""
    opened = [_open(path)]
    try:
        for part in member.split(SEPARATOR):
            opened.append(zipfile.ZipFile(opened[-1]))
            opened.append(opened[-1].open(part))
        text = io.TextIOWrapper(io.BufferedReader(opened[-1], 1 << 20), "utf-8-sig", newline="")
        yield from (r for r in csv.reader(text) if r)
    finally:
        for handle in reversed(opened):
            handle.close()


def _lacking(header: list[str] | None, names: list[str]) -> str | None:
    missing = [c for c in names if c not in (header or [])]
    return f"missing columns: {', '.join(missing)}" if missing else None


def stage_members(members: DataFrame, names: list[str]) -> DataFrame:
    """Rows of all listed members in one pass, each with its member, and a closing row for every member.

    A member is opened once, by one task, and streamed in Arrow batches. Its closing row (``_closing`` is
    true) says how many rows it had, or with which problem it ended; until then its rows are only staged.
    The staged table is written, and both the outcomes and the usable rows come from there.
    """
    target = pa.schema(
        [(n, pa.string()) for n in names]
        + [("archive", pa.string()), ("member", pa.string()), ("_closing", pa.bool_()), ("_bytes", pa.int64()), ("_rows", pa.int64()), ("_problem", pa.string())]
    )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, member, size, problem in zip(*(batch[c].to_pylist() for c in ("archive", "member", "bytes", "problem")), strict=True):
                n = None if problem else 0
                if problem is None:
                    try:
                        for columns in _rows(path, member, names):
                            n += len(columns[0])
                            yield _batch(columns, len(columns[0]), target, path, member, False, None, None, None)
                    except BROKEN as e:
                        n, problem = None, _problem(e)
                    except LookupError as e:
                        n, problem = None, str(e.args[0])
                yield _batch([[None]] * len(names), 1, target, path, member, True, size, n, problem)

    n = members.sparkSession.sparkContext.defaultParallelism
    spread = members.select("archive", "member", "bytes", "problem").repartition(n, "archive", "member")
    ddl = ", ".join(f"`{c}` string" for c in names)
    return materialize(
        spread.mapInArrow(stream, f"{ddl}, archive string, member string, _closing boolean, _bytes long, _rows long, _problem string"), "members"
    )


def _batch(columns: list[list], size: int, target: pa.Schema, *same) -> pa.RecordBatch:
    kinds = [f.type for f in target][len(columns) :]
    made = [pa.array(c, pa.string()) for c in columns] + [pa.array([x] * size, k) for x, k in zip(same, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(made, schema=target)


def outcomes(staged: DataFrame) -> DataFrame:
    """Every member with its rows, or the problem for which it is left out."""
    return staged.where("_closing").select(
        "archive", "member", F.col("_bytes").alias("bytes"), F.col("_rows").alias("rows"), F.col("_problem").alias("problem")
    )


def member_outcomes(members: DataFrame, names: list[str]) -> DataFrame:
    """Every listed member, read to its end: its rows, or the problem for which it is left out."""
    return outcomes(stage_members(members, names))


def usable_rows(staged: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of the members that ended well."""
    good = staged.where("_closing AND _problem IS NULL").select("archive", "member")
    rows = staged.where("NOT _closing").join(good, ["archive", "member"], "left_semi").select(*schema.names, "member")
    return files.typed(rows, T.StructType([*schema.fields, T.StructField("member", T.StringType())]))


def read_members(members: DataFrame, schema: T.StructType = S.TRIPS, on_bad_file: str = "skip") -> DataFrame:
    """Rows of the usable members, read in one pass.

    Members with a problem are left out whole or, with ``on_bad_file="fail"``, raise.
    """
    staged = stage_members(members, schema.names)
    if on_bad_file == "fail":
        bad = outcomes(staged).where("problem IS NOT NULL").limit(20).collect()
        if bad:
            raise ValueError(f"unusable members: {[f'{r.archive}{SEPARATOR}{r.member}: {r.problem}' for r in bad]}")
    return usable_rows(staged, schema)


def _rows(path: str, member: str, names: list[str]) -> Iterator[list[list[str | None]]]:
    """Columns of a member, some thousand rows at a time; a LookupError names wanted columns that it lacks."""
    records = _records(path, member)
    header = [c.strip() for c in next(records, [])]
    if problem := _lacking(header, names):
        raise LookupError(problem)
    at = [header.index(c) for c in names]
    columns: list[list[str | None]] = [[] for _ in names]
    for record in records:
        for column, i in zip(columns, at):
            column.append((record[i] or None) if i < len(record) else None)
        if len(columns[0]) >= _BATCH:
            yield columns
            columns = [[] for _ in names]
    if columns[0]:
        yield columns


def read_zipped_csv(spark: SparkSession, pattern: str, schema: T.StructType = S.TRIPS) -> DataFrame:
    """All CSV rows of all usable members of all archives."""
    return read_members(list_members(spark, pattern), schema).select(*schema.names)
