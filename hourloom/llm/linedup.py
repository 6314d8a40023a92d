"""Repeated lines: levelled sorted runs of line hashes, merged with each new batch.

A run is a table of (line, docs, last, fresh) sorted by ``line``, the 128-bit hash of a line's key:
how many documents of the batch hold it, the largest key among them, and whether no earlier run held
it. A new batch is anti-joined with the fresh rows of all runs (a merge join of sorted sides) and adds
a run of its own; when a level holds ``fanout`` runs they are compacted into one run of the next level.
Batches are taken in descending order of the document key, so the batch in which a line is fresh holds
the largest key of it.

Lines found in at least ``min_docs`` documents are dropped everywhere but in the document with the
largest key. Defined results: a null or empty text is one empty line and is kept as ''; every row
counts as a document, also when its key repeats, and all rows with the largest key keep the line;
null keys are smaller than all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm.base import bounded, cut_points, forget_cached, range_of, shared_folder, small_batches, stored

MIN_CHARS, MIN_DOCS = 20, 3
BATCHES, FANOUT = 3, 2
_NULL_KEY = -(1 << 63)


def line_hash(line: bytes) -> bytes | None:
    """Hash of the key of a line, None for keys that are too short. Strips ASCII white space only."""
    key = line.strip()
    if len(key) < MIN_CHARS or (len(key) < 4 * MIN_CHARS and len(key.decode()) < MIN_CHARS):
        return None
    return xxhash.xxh3_128_digest(key)


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_cached()
    for batch in small_batches(batches, 1):
        keys, lines = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = {h for x in (text or "").encode().lower().split(b"\n") if (h := line_hash(x))}
            keys += [key] * len(found)
            lines += found
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lines, pa.binary())], ["_key", "line"])


def hashed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_key, line): the different lines of every document that are long enough."""
    rows = bounded(docs).select(F.coalesce(F.col(key).cast("long"), F.lit(_NULL_KEY)).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(_hash_lines, "_key long, line binary")


class LineRuns:
    """The runs and their levels; all tables lie in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.folder = shared_folder(spark, "lineruns")
        self.levels: list[list[str]] = []
        self.written = 0

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.folder}/run={self.written:05d}"
        self.written += 1
        rows.sortWithinPartitions("line").write.parquet(path)
        return path

    def rows(self) -> DataFrame | None:
        paths = [p for level in self.levels for p in level]
        if not paths:
            return None
        return self.spark.read.schema("line binary, docs long, last long, fresh boolean").parquet(*paths)

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (_key, line), one row per document and line."""
        own = lines.groupBy("line").agg(F.count(F.lit(1)).alias("docs"), F.max("_key").alias("last"))
        held = self.rows()
        if held is None:
            run = own.withColumn("fresh", F.lit(True))
        else:
            # The left join is the merge-anti-join that keeps the other rows, for their counts.
            known = held.filter("fresh").select("line", F.lit(True).alias("known")).hint("merge")
            run = own.join(known, "line", "left").select("line", "docs", "last", F.col("known").isNull().alias("fresh"))
        self._place(self._write(run), 0)

    def _place(self, path: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            merged = self._merge(self.spark.read.parquet(*self.levels[level]))
            path = self._write(merged)
            self.levels[level] = []
            self._place(path, level + 1)

    @staticmethod
    def _merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy("line").agg(
            F.sum("docs").alias("docs"), F.max("last").alias("last"), F.max("fresh").alias("fresh")
        )

    def repeated(self, min_docs: int) -> DataFrame:
        """(line, last) of the lines that at least so many documents hold."""
        return self._merge(self.rows()).filter(F.col("docs") >= min_docs).select("line", "last")


def _drop_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_cached()
    for batch in small_batches(batches, 1):
        keys, texts, drops = (batch.column(i) for i in range(3))
        kept, n_lines, n_dropped = [], [], []
        for text, drop in zip(texts, drops, strict=True):
            lines = (text.as_py() or "").split("\n")
            gone = set(drop.as_py() or ())
            left = [x for x in lines if line_hash(x.encode().lower()) not in gone] if gone else lines
            kept.append("\n".join(left))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(left))
        out = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())]
        rest = [batch.column(i) for i in range(3, batch.num_columns)]
        yield pa.RecordBatch.from_arrays([keys, *out, *rest], ["_key", "n_lines", "n_dropped", "kept"] + [f"_c{i}" for i in range(len(rest))])


def dedupe_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (),
    batches: int = BATCHES, min_docs: int = MIN_DOCS,
) -> DataFrame:
    """(key, n_lines, n_dropped, kept) and the carried columns; ``kept`` is the text that is left."""
    spark = docs.sparkSession
    rows = bounded(docs).select(
        F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"),
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
    )
    cuts = cut_points(rows, "_key", batches)
    runs = LineRuns(spark)
    part = range_of("_key", cuts)
    for i in reversed(range(max(1, len(cuts)))):
        runs.add(hashed_lines(rows.filter(part == i), "_key", "_text"))
    # From files, so that Spark can split a line that very many documents hold.
    repeated = stored(runs.repeated(min_docs), "repeated-lines")
    doomed = hashed_lines(rows, "_key", "_text").join(repeated, "line").filter(F.col("_key") < F.col("last"))
    drops = doomed.groupBy("_key").agg(F.collect_set("line").alias("_drop"))
    joined = (
        rows.withColumn("_join", F.coalesce("_key", F.lit(_NULL_KEY)))
        .join(drops.withColumnRenamed("_key", "_join"), "_join", "left")
        .select("_key", "_text", "_drop", *[f"_c{i}" for i in range(len(carry))])
    )
    kinds = "".join(f", _c{i} {dict(rows.dtypes)[f'_c{i}']}" for i in range(len(carry)))
    out = joined.mapInArrow(_drop_lines, f"_key long, n_lines long, n_dropped long, kept string{kinds}")
    return out.select(
        F.col("_key").alias(key), "n_lines", "n_dropped", "kept",
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
    )


