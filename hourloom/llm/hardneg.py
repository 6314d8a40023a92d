"""Hard negatives by an inverted multi-index, exact.

Vectors of whole numbers are cut in two halves. A codebook for each half, fitted on a bounded sample,
gives every row a cell (one code of either half); the radius of a code is the largest distance of any
row's half from it. For an anchor the inner product with a row of cell (i, j) is at most

    q1.c_i + |q1| r_i  +  q2.d_j + |q2| s_j,

so a heap that walks both sorted lists at once meets the cells by falling bounds, and once the next
bound is below what an anchor still needs, all rows that were not visited are proven out.

Every search has two rounds: the first cells of the walk give each anchor a least score to beat, the
second visits all cells that may hold a better one. Anchors of neighbouring cells form blocks, rows of
neighbouring cells form shards (large cells are several of either), and each (block, shard) that any
of its anchors must visit meets in one task of bounded size. The best of each task are merged by rank.

Rows whose label or vector is null take no part. Rows are told apart by position: a copy of an anchor
with its id is another row, and each of two equal anchors has its own results. Ties go by id; a row
without an id comes last and is no anchor unless the condition says so. Vectors that are shorter than
others count as filled with zeros, components are held to +-sqrt(2^55 / length) so that scores are
exact. Other columns are ignored. An empty table, or one without anchors, gives an empty one.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.llm.base import bounded, stored

# Rows that the codebooks are fitted on, codes of a half at most, and rows that a cell should hold.
SAMPLE, MOST_CODES, CELL_ROWS, FIT_ROUNDS = 8192, 64, 512, 8
# Rows of a shard and anchors of a block: a 64th and an 8th of the table within these bounds.
SHARD, BLOCK = (1024, 16_384), (256, 4096)
# Rows that the first round of a search visits before it asks what is still needed.
FIRST = 2048
NO_ID = 2**63 - 1


def whole(vector: str, scale: float) -> Column:
    """floor(scale * x) of every component; null if the vector or a component is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def fit_codes(half: np.ndarray, codes: int) -> np.ndarray:
    """Lloyd's means of the sample's rows, from its first different ones."""
    first = np.sort(np.unique(half, axis=0, return_index=True)[1])[:codes]
    centres = half[first].astype(float)
    for _ in range(FIT_ROUNDS):
        near = nearest(half, centres)[0]
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = half[near == c].mean(0)
    return centres


def nearest(half: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest code of every row, and the distance."""
    far = (centres**2).sum(1) - 2 * half @ centres.T
    code = far.argmin(1)
    return code, np.sqrt(((half - centres[code]) ** 2).sum(1))


def packed(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell in order its first box and the number of its boxes; small neighbours share one."""
    first, boxes = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    box, free = -1, 0
    for c, n in enumerate(sizes.tolist()):
        if n > room:
            first[c], boxes[c] = box + 1, -(-n // room)
            box, free = box + int(boxes[c]), 0
            continue
        if n > free or box < 0:
            box, free = box + 1, room
        first[c] = box
        free -= n
    return first, boxes


@dataclass
class Cells:
    """Codebooks, radii and boxes: what a task must know of the index. Its size follows the number of cells."""

    one: np.ndarray
    two: np.ndarray
    radius: np.ndarray  # cell x 2: largest distance of its rows from either code
    rows: np.ndarray
    shards: tuple[np.ndarray, np.ndarray]
    blocks: tuple[np.ndarray, np.ndarray]

    def __post_init__(self):
        a, b = len(self.one), len(self.two)
        self.r1 = self.radius[:, 0].reshape(a, b).max(1)
        self.r2 = self.radius[:, 1].reshape(a, b).max(0)

    def walk(self, q: np.ndarray) -> Iterator[tuple[float, int, float, float]]:
        """Bound, cell, and the least and largest score that a row of the cell can have, by falling bounds."""
        h, cols = self.one.shape[1], len(self.two)
        mid1, mid2 = self.one @ q[:h], self.two @ q[h:]
        n1, n2 = math.sqrt(q[:h] @ q[:h]), math.sqrt(q[h:] @ q[h:])
        top1, top2 = mid1 + n1 * self.r1, mid2 + n2 * self.r2
        o1, o2 = np.argsort(-top1, kind="stable").tolist(), np.argsort(-top2, kind="stable").tolist()
        u1, u2 = top1[o1].tolist(), top2[o2].tolist()
        # Room for rounding: far above the error of sums of this size, far below a unit for usual vectors.
        slack = 1e-6 + 1e-12 * (n1 * (np.abs(self.one).max() * math.sqrt(h) + self.r1.max()) + n2 * (np.abs(self.two).max() * math.sqrt(len(q) - h + 1) + self.r2.max()))
        heap, done = [(-(u1[0] + u2[0]), 0, 0)], set()
        while heap:
            bound, i, j = heapq.heappop(heap)
            done.add((i, j))
            cell = o1[i] * cols + o2[j]
            mid, reach = mid1[o1[i]] + mid2[o2[j]], n1 * self.radius[cell, 0] + n2 * self.radius[cell, 1] + slack
            yield slack - bound, cell, mid - reach, mid + reach
            # A cell enters the heap once both cells before it were visited.
            if i + 1 < len(u1) and (j == 0 or (i + 1, j - 1) in done):
                heapq.heappush(heap, (-(u1[i + 1] + u2[j]), i + 1, j))
            if j + 1 < len(u2) and (i == 0 or (i - 1, j + 1) in done):
                heapq.heappush(heap, (-(u1[i] + u2[j + 1]), i, j + 1))

    def needed(self, q: np.ndarray, windows: list[tuple[float, float]], first: int | None) -> set[int]:
        """Shards that may hold a row with a score in one of the windows; ``first``: only until so many rows."""
        least = min((lo for lo, hi in windows if lo <= hi), default=math.inf)
        found, seen = set(), 0
        for bound, cell, low, high in self.walk(q):
            if bound < least:
                break  # certified: no cell that is left reaches any window
            if not self.rows[cell] or not any(low <= hi and high >= lo for lo, hi in windows if lo <= hi):
                continue
            found.update(range(int(self.shards[0][cell]), int(self.shards[0][cell] + self.shards[1][cell])))
            seen += int(self.rows[cell])
            if first is not None and seen >= first:
                break
        return found


@dataclass
class Index:
    """The rows by shard, the anchors by block, and the cells."""

    rows: DataFrame
    anchors: DataFrame
    cells: Cells


def _matrix(column: pa.ListArray, length: int, limit: int) -> np.ndarray:
    out = np.zeros((len(column), length), np.int32)
    sizes = np.asarray(column.value_lengths())
    flat = np.clip(column.flatten().to_numpy(zero_copy_only=False), -limit, limit)
    out[np.arange(length) < sizes[:, None]] = flat
    return out


def build(rows: DataFrame, anchor: Column, key: str, label: str, vector: str) -> Index:
    """Fit the codebooks on a sample, give every row its cell, and deal cells into shards and blocks."""
    taking = rows.filter(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"),
        F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.col(vector).cast("array<bigint>").alias("vec"),
    )
    taking = stored(taking, "vectors")
    n, length = taking.agg(F.count("*"), F.max(F.size("vec"))).first()
    length = max(length or 0, 2)
    limit, h = math.isqrt(2**55 // length), length // 2
    # A share of all different vectors, by hash, so that copies count once; then a bound.
    share = min(1.0, 4 * SAMPLE / max(n, 1))
    code = F.xxhash64("vec")
    drawn = taking.filter((code.cast("double") / 2.0**64 + 0.5) <= share).groupBy(code.alias("h")).agg(F.first("vec").alias("vec"))
    sample = _matrix(drawn.orderBy("h").limit(SAMPLE).toArrow()["vec"].combine_chunks(), length, limit).astype(float)
    if not len(sample):
        sample = np.zeros((1, length))
    codes = int(min(MOST_CODES, max(1, round(math.sqrt(n / CELL_ROWS)))))
    one, two = fit_codes(sample[:, :h], codes), fit_codes(sample[:, h:], codes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(4), length, limit)
            (a, x), (b, y) = nearest(m[:, :h].astype(float), one), nearest(m[:, h:].astype(float), two)
            made = [pa.array([r.tobytes() for r in m], pa.binary()), pa.array(a * len(two) + b), pa.array(x), pa.array(y)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *made], names=[*batch.schema.names[:4], "vec", "cell", "x", "y"])

    placed = stored(
        bounded(taking).mapInArrow(assign, "row long, id long, label long, anchor boolean, vec binary, cell long, x double, y double"), "cells"
    )
    rows_in, anchors_in = np.zeros(len(one) * len(two), np.int64), np.zeros(len(one) * len(two), np.int64)
    radius = np.zeros((len(rows_in), 2))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("anchor").alias("a"), F.max("x").alias("x"), F.max("y").alias("y")).collect():
        rows_in[r.cell], anchors_in[r.cell], radius[r.cell] = r.n, r.a, (r.x, r.y)
    shards = packed(rows_in, int(np.clip(n // 64, *SHARD)))
    blocks = packed(anchors_in, int(np.clip(anchors_in.sum() // 8, *BLOCK)))
    cells = Cells(one, two, radius, rows_in, shards, blocks)

    boxes = rows.sparkSession.createDataFrame(
        [(c, *map(int, x)) for c, x in enumerate(zip(*shards, *blocks, strict=True))], "cell long, s long, s_n long, b long, b_n long"
    )
    placed = placed.join(F.broadcast(boxes), "cell")  # at most MOST_CODES ^ 2 rows
    piece = F.xxhash64("row")
    columns = ("row", "id", "label", "vec")
    anchors = stored(placed.filter("anchor").select(*columns, (F.col("b") + F.pmod(piece, "b_n")).alias("block")), "anchors")
    return Index(placed.select(*columns, (F.col("s") + F.pmod(piece, "s_n")).alias("shard")), anchors, cells)


def _windows(at: list[int] | None, least: list[int | None], share: tuple[int, int]) -> list[tuple[float, float]]:
    """What each slot of an anchor accepts: from ``share`` per cent of its positive's score, or anything; never below ``least``."""
    base = [(-(-share[0] * p // 100), share[1] * p // 100) for p in at] if at is not None else [(-math.inf, math.inf)] * len(least)
    return [(lo if least_ is None else max(lo, least_), hi) for (lo, hi), least_ in zip(base, least, strict=True)]


def _plan(anchors: DataFrame, cells: Cells, share: tuple[int, int], first: int | None) -> DataFrame:
    """block, shard: which must meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = set()
            for block, vec, at, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q = np.frombuffer(vec, np.int32).astype(float)
                pairs.update((block, s) for s in cells.needed(q, _windows(at, least, share), first))
            if pairs:
                block, shard = zip(*sorted(pairs), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(shard, pa.int64())], names=["block", "shard"])

    return anchors.select("block", "vec", "at", "least").mapInArrow(run, "block long, shard long").distinct()


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    kind = np.float64 if most < 2**53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def _meet(anchors: DataFrame, rows: DataFrame, pairs: DataFrame, same: bool, want: int, share: tuple[int, int]) -> DataFrame:
    """Of every (block, shard) the best rows of each anchor's slots: row, slot, score, id, other."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [], [])
        if left.num_rows and right.num_rows:
            # Rows by id, so that a stable sort by score leaves ties in order.
            right = right.sort_by([("id", "ascending"), ("row", "ascending")])
            row, key, label = (right[c].to_numpy() for c in ("row", "id", "label"))
            vecs, seekers = (np.frombuffer(b"".join(t["vec"].to_pylist()), np.int32).reshape(t.num_rows, -1) for t in (right, left))
            own = {c: left[c].to_pylist() for c in ("row", "label", "at", "least")}
            for start in range(0, left.num_rows, 256):
                scores = products(seekers[start : start + 256], vecs)
                for k, s in enumerate(scores, start):
                    windows = _windows(own["at"][k], own["least"][k], share)
                    lo, hi = min(w[0] for w in windows), max(w[1] for w in windows)
                    fits = np.flatnonzero((s >= lo) & (s <= hi) & ((label == own["label"][k]) == same) & (row != own["row"][k]))
                    if not len(fits):
                        continue
                    fits = fits[np.argsort(-s[fits], kind="stable")]
                    falling = -s[fits]
                    for slot, (lo, hi) in enumerate(windows):
                        a, b = np.searchsorted(falling, -hi, "left"), np.searchsorted(falling, -lo, "right")
                        some = fits[a : min(a + want, b)]
                        for column, values in zip(out, ([own["row"][k]] * len(some), [slot] * len(some), s[some].tolist(), key[some].tolist(), row[some].tolist()), strict=True):
                            column.extend(values)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["row", "slot", "score", "id", "other"])

    met = anchors.join(pairs, "block").groupBy("block", "shard").cogroup(rows.join(pairs, "shard").groupBy("block", "shard"))
    return met.applyInArrow(run, "row long, slot long, score long, id long, other long")


def _best(found: DataFrame, want: int) -> DataFrame:
    order = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "id", "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= want)


def search(index: Index, anchors: DataFrame, same: bool, want: int, share: tuple[int, int]) -> DataFrame:
    """For every slot of every anchor its ``want`` best rows: row, slot, score, id, other, rank.

    ``at``: scores of the anchor's positives, one slot each, or null for one slot without a window.
    """
    start = _plan(anchors, index.cells, share, FIRST)
    start = stored(start, "first-visits")
    found = stored(_best(_meet(anchors, index.rows, start, same, want, share), want), "first-found")
    least = found.groupBy("row", "slot").agg(F.when(F.count("*") >= want, F.min("score")).alias("s"))
    least = least.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("slot", "s"))).alias("_s"))
    raised = F.transform("least", lambda x, i: F.coalesce(F.try_element_at("_s", i.cast("long")), x))
    sharper = stored(anchors.join(least, "row", "left").withColumn("least", F.when(F.col("_s").isNull(), F.col("least")).otherwise(raised)).drop("_s"), "sharper")
    rest = _plan(sharper, index.cells, share, None).join(start, ["block", "shard"], "left_anti")
    more = _meet(sharper, index.rows, stored(rest, "visits"), same, want, share)
    return _best(found.drop("rank").unionByName(more), want)


def mine(
    rows: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "vector",
    positives: int = 5, negatives: int = 10, share: tuple[int, int] = (30, 90),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its best rows of the same label; for each of them come the best rows of
    other labels whose score lies within ``share`` per cent of the positive's.
    """
    index = build(rows, anchor, key, label, vector)
    none = F.array(F.lit(None).cast("long"))
    seeking = index.anchors.withColumn("at", F.lit(None).cast("array<long>")).withColumn("least", none)
    near = stored(search(index, seeking, True, positives, share), "positives")
    at = near.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("at"))
    windows = index.anchors.join(at, "row").withColumn("least", F.transform("at", lambda x: F.lit(None).cast("long")))
    windows = stored(windows, "windows")
    far = search(index, windows, False, negatives, share)
    near = near.select("row", (F.col("rank") - 1).cast("long").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    own = index.anchors.select("row", F.col("id").alias("anchor_id"))
    out = far.join(near, ["row", "slot"]).join(own, "row")

    def named(c: str) -> Column:
        return F.nullif(F.col(c), F.lit(NO_ID)).alias(c)

    return out.withColumnRenamed("id", "negative_id").select(
        named("anchor_id"), named("positive_id"), F.col("rank").cast("int").alias("rank"), named("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
