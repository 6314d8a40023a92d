"""File listing and CSV reading by column name.

A file is read whole or not at all: files without a wanted column, and compressed files that cannot be
unpacked to their end, are left out and listed with the reason.
"""

from __future__ import annotations

import bz2
import csv
import re
import threading
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from typing import IO

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.functions import clock


def _hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _hadoop_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_file_system(spark, path).exists(_hadoop_path(spark, path)))


def glob(spark: SparkSession, pattern: str) -> list[str]:
    """Files that match a pattern, on any file system Spark can read, in name order."""
    found = _file_system(spark, pattern).globStatus(_hadoop_path(spark, pattern))
    return sorted(s.getPath().toString() for s in found or [] if s.isFile())


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that match a pattern, in name order."""
    found = _file_system(spark, pattern).globStatus(_hadoop_path(spark, pattern))
    return sorted(s.getPath().toString() for s in found or [] if s.isDirectory())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and what is in it, if it is there."""
    _file_system(spark, path).delete(_hadoop_path(spark, path), True)


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file; empty while it is being written or when it is gone."""
    try:
        source = _file_system(spark, path).open(_hadoop_path(spark, path))
    except Py4JJavaError:
        return ""
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


# Threads of one driver create one file at a time.
_CREATING = threading.Lock()


def write_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small text file; False if somebody else was first.

    The store decides who creates it. Some local file systems let two creations pass at the same moment,
    so what the file says in the end decides, and threads of one driver take turns.
    """
    with _CREATING:
        try:
            target = _file_system(spark, path).create(_hadoop_path(spark, path), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName() or "already exists" in str(e.java_exception):
                return False
            raise
        target.write(bytearray(text.encode()))
        target.close()
        return read_text(spark, path) == text


# How much of a compressed file is unpacked at a time, how much of any file is read to find its header, and
# how long a header may be.
_CHUNK, _PEEK, _LONGEST_HEADER = 1 << 20, 1 << 14, 1 << 20
# Files Python unpacks itself, to see whether they are whole; Spark reads every other kind and raises.
_PACKED = {".gz": lambda: zlib.decompressobj(31), ".bz2": bz2.BZ2Decompressor}
# Hadoop's names of stores that the Arrow file systems know under another one.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs", "wasb": "abfs"}


def store_uri(path: str) -> str:
    """The address of a file as the Arrow file systems want it."""
    uri = re.sub(r"^file:/+", "file:///", path)
    scheme, mark, rest = uri.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}{mark}{rest}" if mark else uri


def open_stored(path: str) -> pa.NativeFile:
    """A file of any store, for reading in a task by ranges."""
    uri = store_uri(path)
    system, inner = pa_fs.FileSystem.from_uri(uri) if "://" in uri else (pa_fs.LocalFileSystem(), uri)
    return system.open_input_file(inner)


def _unpacked(source: IO[bytes], start: Callable) -> Iterator[bytes]:
    """A compressed file as a stream, one chunk in memory; raises where it breaks off."""
    rest = source.read(_CHUNK)
    while rest:
        stream = start()
        while not stream.eof:
            if not rest:
                rest = source.read(_CHUNK)
                if not rest:
                    raise EOFError("truncated")
            yield stream.decompress(rest)
            rest = stream.unused_data
        rest = rest or source.read(_CHUNK)


def _judge(path: str, source: IO[bytes]) -> tuple[str | None, str | None]:
    """(header line, problem) of a file: its first kilobytes, and for a compressed one every byte, in passing."""
    head, kind = b"", next((k for k in _PACKED if path.endswith(k)), None)
    try:
        for piece in _unpacked(source, _PACKED[kind]) if kind else iter(lambda: source.read(_PEEK), b""):
            if b"\n" not in head and len(head) < _LONGEST_HEADER:
                head += piece[:_LONGEST_HEADER]
            if not kind and (b"\n" in head or len(head) >= _LONGEST_HEADER):
                break
    except (zlib.error, EOFError, OSError, ValueError) as e:
        return None, f"cannot read: {type(e).__name__}"
    return head.partition(b"\n")[0].decode("utf-8-sig", "replace").rstrip("\r"), None


def headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, head, problem) of every file: a catalogue that tasks make, each file opened by one of them.

    Of a plain file only the first kilobytes are read, whatever its length.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch["path"].to_pylist():
                try:
                    with open_stored(path) as source:
                        found.append((path, *_judge(path, source)))
                except OSError as e:
                    found.append((path, None, f"cannot read: {type(e).__name__}"))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)], ["path", "head", "problem"])

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    tasks = min(len(paths), 4 * spark.sparkContext.defaultParallelism)
    return listed.repartition(max(1, tasks), "path").mapInArrow(look, "path string, head string, problem string")


def _headers(spark: SparkSession, paths: list[str]) -> list[tuple[str, str | None, str | None]]:
    """The catalogue's rows: as many as the listing that the reader is given."""
    return [tuple(r) for r in headers(spark, paths).collect()]


def group_by_header(
    spark: SparkSession, paths: list[str], wanted: list[str]
) -> tuple[dict[tuple[str, ...], list[str]], list[tuple[str, str]]]:
    """Files by their header, and the files that lack a wanted column or cannot be read whole."""
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    skipped = []
    for path, head, problem in _headers(spark, paths):
        header = tuple(c.strip() for c in next(csv.reader([head or ""]), []))
        missing = [c for c in wanted if c not in header]
        if problem or missing:
            skipped.append((path, problem or f"missing columns: {', '.join(missing)}"))
        else:
            groups[header].append(path)
    return {h: sorted(f) for h, f in groups.items()}, sorted(skipped)


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """All-text columns to their types; text that does not fit becomes null."""
    cols = []
    for field in schema:
        c = F.col(field.name)
        if isinstance(field.dataType, T.TimestampNTZType):
            c = clock.parse_wall(c)
        elif not isinstance(field.dataType, T.StringType):
            c = c.try_cast(field.dataType)
        cols.append(c.alias(field.name))
    return df.select(*cols)


def read_csv_by_name(
    spark: SparkSession,
    pattern: str,
    schema: T.StructType,
    on_bad_file: str = "skip",
) -> DataFrame:
    """CSV files whose columns may come in any order, bound by name.

    A CSV schema binds by position, so files are read once per distinct header and then united.
    Files that lack a wanted column are left out (``skipped_files`` lists them) or, with
    ``on_bad_file="fail"``, raise.
    """
    paths = glob(spark, pattern)
    if not paths:
        raise FileNotFoundError(f"no files match {pattern}")
    groups, skipped = group_by_header(spark, paths, schema.names)
    if skipped and (on_bad_file == "fail" or not groups):
        raise ValueError(f"unusable files: {skipped}")

    def read(header: tuple[str, ...], files: list[str]) -> DataFrame:
        text = T.StructType([T.StructField(c, T.StringType()) for c in header])
        raw = (
            spark.read.schema(text)
            .option("header", True)
            .csv(files)
        )
        return raw.select(*schema.names)

    parts = [read(header, files) for header, files in sorted(groups.items())]
    return typed(reduce(DataFrame.unionByName, parts), schema)


def skipped_files(spark: SparkSession, pattern: str, wanted: list[str]) -> DataFrame:
    """Files a read would leave out, with the reason."""
    _, skipped = group_by_header(spark, glob(spark, pattern), wanted)
    return spark.createDataFrame(skipped, "file string, reason string")


def file_outcomes(spark: SparkSession, pattern: str, wanted: list[str]) -> DataFrame:
    """(file, rows, problem) of every file: what a read takes from it, or why it is left out."""
    groups, skipped = group_by_header(spark, glob(spark, pattern), wanted)
    parts = [spark.createDataFrame([(f, None, p) for f, p in skipped], "file string, rows long, problem string")]
    for _, paths in sorted(groups.items()):
        lines = spark.read.schema("first string").option("header", True).csv(paths)
        counted = lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))
        parts.append(counted.withColumn("problem", F.lit(None).cast("string")))
    return reduce(DataFrame.unionByName, parts)


def bad_rows(spark: SparkSession, pattern: str, wanted: list[str]) -> DataFrame:
    """Per file: rows, rows whose number of fields does not fit the header, rows without a value
    in one of the wanted columns."""
    groups, _ = group_by_header(spark, glob(spark, pattern), wanted)
    gap = reduce(Column.__or__, [F.col(c).isNull() for c in wanted])
    parts = []
    for header, files in sorted(groups.items()):
        text = T.StructType([T.StructField(c, T.StringType()) for c in (*header, "_corrupt_record")])
        # Whole lines must be parsed to see their length, hence no pruning of columns.
        raw = (
            spark.read.schema(text).option("header", True).option("columnPruning", False).csv(files)
        )
        parts.append(
            raw.groupBy(F.col("_metadata.file_name").alias("file")).agg(
                F.count("*").alias("n_rows"),
                F.count_if(F.col("_corrupt_record").isNotNull()).alias("n_bad"),
                F.count_if(gap).alias("n_incomplete"),
            )
        )
    return reduce(DataFrame.unionByName, parts)
