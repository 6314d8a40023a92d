"""What the operators share: folders, per-worker caches, ranges of a key."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.session import shared_dir

# What a worker handles at a time, whatever the length of the texts.
ROWS_PER_BATCH, BYTES_PER_BATCH = 2000, 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name under the folder that all executors share."""
    return shared_dir(spark, f"llm-{label}")


def bounded(df: DataFrame) -> DataFrame:
    """The table, after the session's Arrow batches were limited to fewer rows than Spark's default.

    Texts may be long, and a batch is held on both sides of every Python worker. A limit that the
    caller has set stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(name)) == 10_000:
        df.sparkSession.conf.set(name, str(ROWS_PER_BATCH // 2))
    return df


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and go on from the files: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(
    batches: Iterator[pa.RecordBatch], column: int, rows: int = ROWS_PER_BATCH, size: int = BYTES_PER_BATCH
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a column of texts stays within ``size`` bytes, or is one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = min(start + rows, int(np.searchsorted(ends, before + size, "right")))
            stop = max(start + 1, stop)
            yield batch.slice(start, stop - start)
            start = stop


def file_bytes(path: str, limit: int = 16 << 20) -> bytes:
    """A vocabulary file, which travels with the job; refused beyond ``limit`` bytes."""
    with open(path, "rb") as f:
        data = f.read(limit + 1)
    if len(data) > limit:
        raise ValueError(f"{path} has over {limit} bytes, too many to be sent to every worker")
    return data


def worker_cache(key: tuple, make: Callable[[], Any]) -> Any:
    """An object built once per Python worker; workers outlive jobs, so they hold one object at a time."""
    held = sys.__dict__.setdefault("_hourloom_llm_cache", {})
    if key not in held:
        if held:
            held.clear()
            _give_back()
        held[key] = make()
        _give_back()
    return held[key]


def forget_cached() -> None:
    """Drop what an earlier operator left in this worker, for operators that hold nothing themselves."""
    worker_cache(("nothing",), lambda: None)


def _give_back() -> None:
    """Return freed memory to the system; an idle worker would otherwise keep it beside the others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Remembered(dict):
    """Values by text that a worker has met, in two generations of bounded size.

    When the younger one is full it becomes the older one; what is asked for again moves back.
    """

    def __init__(self, limit: int, longest: int):
        super().__init__()
        self.limit, self.longest, self.older = limit, longest, {}

    def lacking(self, texts: list[list[str]]) -> list[str]:
        """The different texts without a value; the others are in the dictionary afterwards."""
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()
        new = set().union(*texts).difference(self)
        back = new.intersection(self.older)
        self.update((t, self.older[t]) for t in back)
        return list(new.difference(back))

    def forget_long(self, texts: list[str]) -> None:
        for t in texts:
            if len(t) > self.longest:
                self.pop(t, None)


def fold_of(key: str, folds: int) -> Column:
    """crc32 of the key's text, modulo the number of folds; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def cut_points(df: DataFrame, key: str, ranges: int) -> list[int]:
    """First keys of about as many ranges of equal row counts; every one occurs in the table.

    Holds one number per range, and ranges follow the number of tasks or files, not the rows.
    """
    probs = [i / ranges for i in range(1, ranges)]
    least, inner = df.agg(
        F.min(key), F.percentile_approx(key, F.array(*map(F.lit, probs or [0.5])), F.lit(max(10_000, 20 * ranges)))
    ).first()
    return [] if least is None else sorted({int(least), *(map(int, inner) if ranges > 1 else ())})


def range_of(key: str, cuts: list[int]) -> Column:
    """Index of the range that holds the key, by binary search; null keys belong to the first."""
    if len(cuts) < 2:
        return F.lit(0)
    points = F.array(*[F.lit(c).cast("long") for c in cuts])
    steps = [1 << b for b in reversed(range(len(cuts).bit_length()))]
    key_col = F.col(key).cast("long")
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when(F.get(points, at + step) <= key_col, at + step).otherwise(at),
    )


def frequent(table: DataFrame, count: str, room: int, fits: Column | None = None) -> tuple[Column, bool]:
    """A condition for the most frequent rows of a stored table of counts, at most ``room`` that fit; whether that is all rows.

    The least count is found from a histogram of logarithms, so nothing is sorted; rows of one level
    are taken together or not at all.
    """
    fits = F.lit(True) if fits is None else fits
    level = F.floor(F.log2(F.col(count).cast("double")) * 8).cast("int")
    levels = table.groupBy(level.alias("level")).agg(F.count_if(fits).alias("n"), F.count("*").alias("all")).collect()  # 504 at most
    least, left = None, room
    for r in sorted(levels, key=lambda r: -r.level):
        left -= r.n
        if left < 0:
            break
        least = r.level
    if least is None:
        return F.lit(False), not levels
    return (level >= least) & fits, left >= 0 and sum(r["all"] for r in levels) == room - left
