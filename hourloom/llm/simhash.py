"""Near duplicates by SimHash: 64-bit fingerprints linked at a few differing bits, found exactly.

Fingerprints that differ in at most ``max_bits`` bits are found with vantage-point trees. A tree over
a bounded sample of fingerprints deals all of them to shards: an inner node has a vantage point p and
a radius r, and sends x left if d(x, p) <= r. By the triangle inequality a partner of x lies in both
halves only if |d(x, p) - r| is within the link distance, so x also visits the shards across such
boundaries, at each node in one direction only, which finds each pair once. A shard with over
twice the mean number of rows is dealt in blocks (rows against columns). Within a task the same pruning
continues on arrays, down to small blocks that are compared in full.

A task gives back a spanning forest of the links it finds, never the pairs, so a group of n near
copies costs n links. Equal fingerprints meet before the search. Components come from the forests.

Defined results: null and empty texts and texts without a word have fingerprint zero and are linked
like any other; a text of fewer words than a shingle is one shingle; each row keeps its own
fingerprint, and rows with the same key and the same fingerprint share one result row; the component
is the smallest key that can be reached; a null key is never a component unless all its keys are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.llm.base import bounded, forget_cached, small_batches, stored
from hourloom.llm.components import components

SHINGLE, MAX_BITS, SEED = 4, 4, 42
# The shards follow the square root of the number of fingerprints: a tree twice as deep would deal out
# more copies than it saves comparisons, since tasks prune on. The sample fits the tree.
SHARDS_PER_ROOT, SAMPLE_PER_SHARD, MAX_DEPTH = 1 / 16, 256, 14


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint_of(text: str, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text; bit i is set if over half of the shingle hashes have it."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)])
    # Bits of each of the eight (big-endian) bytes, from the counts of its values.
    columns = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    ones = np.concatenate([np.bincount(columns[:, i], minlength=256) @ _BITS for i in range(8)])
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits).view(">i8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_cached()
        for batch in small_batches(batches, 1):
            got = [fingerprint_of(t.as_py() or "", shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64())], ["_key", "_fp"])

    return run


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(_key, _fp) of every row."""
    rows = bounded(docs).select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(_fingerprints(shingle), "_key long, _fp long")


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def _radius(d: np.ndarray) -> int:
    """The cut that splits the distances most evenly."""
    counts = np.bincount(d, minlength=66).cumsum()
    return int(np.abs(2 * counts[:-1] - len(d)).argmin())


class Tree:
    """Upper levels of a vantage-point tree; shards are numbered from left to right."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 7):
        self.nodes: dict[int, tuple[int, int]] = {}  # heap position -> vantage point, radius
        self.depth = depth
        rng = np.random.default_rng(seed)
        level = {1: sample}
        for _ in range(depth):
            below = {}
            for at, points in level.items():
                if len(points) < 2:
                    continue
                tries = points[rng.integers(0, len(points), 8)]
                # Of a few candidates the one whose boundary catches the fewest points.
                best = None
                for p in tries:
                    d = _distance(points, p)
                    r = _radius(d)
                    left = int((d <= r).sum())
                    across = int(((d > r - MAX_BITS) & (d <= r + MAX_BITS)).sum())
                    cost = across + 2 * abs(2 * left - len(points))
                    if 0 < left < len(points) and (best is None or cost < best[0]):
                        best = (cost, p, r, d <= r)
                if best:
                    _, p, r, mask = best
                    self.nodes[at] = (p, r)
                    below[2 * at], below[2 * at + 1] = points[mask], points[~mask]
            level = below

    def places(self, x: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, home): the home shard of each row and those that it visits."""
        rows = np.arange(len(x))
        level = [(1, rows, np.ones(len(x), bool))]
        done: list[tuple[int, np.ndarray, np.ndarray]] = []
        for deep in range(self.depth + 1):
            below = []
            for at, who, home in level:
                if deep == self.depth or at not in self.nodes:
                    done.append((at << (self.depth - deep), who, home))
                    continue
                p, r = self.nodes[at]
                d = _distance(x[who], p)
                left = d <= r
                touches_left, touches_right = d <= r + reach, d > r - reach
                # Homes cross in one direction, which differs from node to node so that visits
                # spread evenly; a visitor goes on to every side that its reach touches.
                if bin(at).count("1") % 2:
                    goes_left, goes_right = touches_left, np.where(home, ~left, touches_right)
                else:
                    goes_left, goes_right = np.where(home, left, touches_left), touches_right
                below.append((2 * at, who[goes_left], (home & left)[goes_left]))
                below.append((2 * at + 1, who[goes_right], home[goes_right]))
            level = below
        keep = [x for x in done if len(x[1])]
        return (
            np.concatenate([w for _, w, _ in keep]),
            np.concatenate([np.full(len(w), at, np.int64) for at, w, _ in keep]),
            np.concatenate([h for _, _, h in keep]),
        )


class Forest:
    """Union-find over positions, fed with arrays of links."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def _find(self, a: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[a]
            if (up == a).all():
                return a
            self.parent[a] = self.parent[up]
            a = self.parent[up]

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self._find(a), self._find(b)
            open_ = a != b
            a, b = a[open_], b[open_]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def roots(self) -> np.ndarray:
        return self._find(np.arange(len(self.parent)))


LEAF = 96


def link_within(values: np.ndarray, a: np.ndarray, b: np.ndarray | None, reach: int, forest: Forest, rng) -> None:
    """Link all pairs of positions within reach: among a, or between a and b."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if not len(a) or (b is not None and not len(b)):
            continue
        small = min(len(a), len(b) if b is not None else len(a))
        split = None
        if small > LEAF:
            p = values[a[rng.integers(len(a))]]
            da = _distance(values[a], p)
            r = _radius(da)
            la = da <= r
            if b is None:
                across = (a[la & (da > r - reach)], a[~la & (da <= r + reach)])
                if max(la.sum(), (~la).sum()) <= 0.9 * len(a) and len(across[0]) + len(across[1]) < 0.9 * len(a):
                    split = [(a[la], None), (a[~la], None), across]
            else:
                db = _distance(values[b], p)
                lb = db <= r
                parts = [
                    (a[la], b[lb]), (a[~la], b[~lb]),
                    (a[la & (da > r - reach)], b[~lb & (db <= r + reach)]),
                    (a[~la & (da <= r + reach)], b[lb & (db > r - reach)]),
                ]
                if sum(len(x) * len(y) for x, y in parts) < 0.85 * len(a) * len(b):
                    split = parts
        if split is not None:
            todo += split
            continue
        other = a if b is None else b
        step = max(1, 2_000_000 // len(other))
        for at in range(0, len(a), step):
            mine = a[at : at + step]
            i, j = np.nonzero(np.bitwise_count(values[mine][:, None] ^ values[other][None, :]) <= reach)
            i, j = mine[i], other[j]
            if b is None:
                keep = i != j
                i, j = i[keep], j[keep]
            forest.link(i, j)


def _search(reach: int):
    """Links of one dealt block: rows meet columns; the diagonal block also meets itself."""

    def run(table: pa.Table) -> pa.Table:
        fp = table.column("_fp").to_numpy().view(np.uint64)
        side = table.column("_side").to_numpy()  # 0: row, 1: column, 2: both
        values, where = np.unique(fp, return_inverse=True)
        values = np.ascontiguousarray(values)
        forest, rng = Forest(len(values)), np.random.default_rng(len(values))
        both = where[side == 2]
        rows, columns = where[side == 0], where[side == 1]
        link_within(values, both, None, reach, forest, rng)
        link_within(values, rows, columns, reach, forest, rng)
        link_within(values, rows, both, reach, forest, rng)
        link_within(values, both, columns, reach, forest, rng)
        root = forest.roots()
        linked = root != np.arange(len(root))
        return pa.table({"u": values[linked].view(np.int64), "v": values[root[linked]].view(np.int64)})

    return run


def _deal(tree: Tree, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(x):
                continue
            row, shard, home = tree.places(x, reach)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[row].view(np.int64)), pa.array(shard), pa.array(home)], ["_fp", "_shard", "_home"]
            )

    return run


def near_links(values: DataFrame, reach: int = MAX_BITS, depth: int | None = None) -> DataFrame:
    """(u, v): a spanning forest of each block's links; ``values`` has different fingerprints in _fp."""
    n = values.count()
    if depth is None:
        depth = max(0, min(MAX_DEPTH, round(np.log2(max(1, n) ** 0.5 * SHARDS_PER_ROOT))))
    wanted = SAMPLE_PER_SHARD << depth
    # A bounded sample fits the tree; all fingerprints are dealt and searched.
    part = int(min(1.0, 1.2 * wanted / max(1, n)) * (1 << 30))
    picked = values.filter(F.xxhash64("_fp").bitwiseAND((1 << 30) - 1) < part).limit(2 * wanted)
    sample = np.sort(np.array([r[0] for r in picked.collect()], np.int64)).view(np.uint64)
    tree = Tree(sample, depth)
    dealt = stored(values.mapInArrow(_deal(tree, reach), "_fp long, _shard long, _home boolean"), "shards")
    # Shards beyond twice the mean are cut into a grid of blocks; there are at most 2^depth shards.
    share = max(1, -(-dealt.count() // (1 << depth)))
    sizes = dealt.groupBy("_shard").count().filter(F.col("count") > 2 * share)
    cuts = sizes.select("_shard", F.ceil(F.col("count") / share).cast("int").alias("_cut"))
    chunk = F.pmod(F.xxhash64("_fp", F.lit(3)), F.col("_cut")).cast("int")
    rows = dealt.join(F.broadcast(cuts), "_shard", "left").fillna(1, ["_cut"]).withColumn("_chunk", chunk)
    # Home rows meet home rows once (chunk i <= chunk j); visitors, as columns, meet every home row.
    every = F.sequence(F.lit(0), F.col("_cut") - 1)
    as_row = F.transform(
        F.sequence(F.col("_chunk"), F.col("_cut") - 1),
        lambda j: F.struct(F.col("_chunk").alias("i"), j.alias("j"), F.when(j == F.col("_chunk"), 2).otherwise(0).alias("side")),
    )
    as_column = F.transform(
        F.sequence(F.lit(0), F.col("_chunk")),
        lambda i: F.struct(i.alias("i"), F.col("_chunk").alias("j"), F.lit(1).alias("side")),
    )
    as_column = F.filter(as_column, lambda s: s["i"] < s["j"])
    visits = F.transform(every, lambda i: F.struct(i.alias("i"), (-1 - F.col("_chunk")).alias("j"), F.lit(1).alias("side")))
    # The homes that visitors of chunk c meet in block (i, -1 - c).
    hosts = F.transform(every, lambda c: F.struct(F.col("_chunk").alias("i"), (-1 - c).alias("j"), F.lit(0).alias("side")))
    split = F.when(F.col("_home"), F.concat(as_row, as_column, hosts)).otherwise(visits)
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.when(F.col("_home"), 2).otherwise(1).alias("side")))
    blocks = rows.select(
        "_fp", "_shard", F.explode(F.when(F.col("_cut") == 1, whole).otherwise(split)).alias("_b")
    ).select("_fp", "_shard", F.col("_b.i").alias("_i"), F.col("_b.j").alias("_j"), F.col("_b.side").alias("_side"))
    return blocks.groupBy("_shard", "_i", "_j").applyInArrow(_search(reach), "u long, v long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """(key, fingerprint, component_id) of every row; the fingerprint has 16 lower-case hex digits."""
    rows = stored(fingerprints(docs, key, text, shingle), "simhash")
    known = _groups(rows, max_bits)
    smallest = stored(known.groupBy("_group").agg(F.min("_least").alias("component_id")), "simhash-least")
    labels = stored(known.join(smallest, "_group").select("_fp", "component_id"), "simhash-labels")
    return rows.join(labels, "_fp").select(
        F.col("_key").alias(key), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _groups(rows: DataFrame, max_bits: int) -> DataFrame:
    """(_fp, _least, _group) of every fingerprint: its smallest key, and the fingerprint that names its linked group."""
    least = stored(rows.groupBy("_fp").agg(F.min("_key").alias("_least")), "simhash-values")
    groups = components(near_links(least.select("_fp"), max_bits))
    known = least.join(groups, least["_fp"] == groups["id"], "left").select(
        "_fp", "_least", F.coalesce("component", "_fp").alias("_group")
    )
    return stored(known, "simhash-groups")


def one_of_each_group(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """Exactly one row of ``docs`` for each linked group, with all columns, whatever the keys are.

    The row with the smallest key stays, null keys last; rows that share it go by a hash of all columns.
    Rows are numbered once, when they are stored, so that neither null nor repeated keys confuse them.
    """
    names = docs.columns
    rows = bounded(docs).select(F.col(text).alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)])
    kinds = T.StructType([T.StructField("_fp", T.LongType()), *rows.schema.fields[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_cached()
        for batch in small_batches(batches, 0):
            got = [fingerprint_of(t.as_py() or "", shingle) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), *batch.columns[1:]], kinds.names)

    numbered = rows.mapInArrow(run, kinds).withColumn("_row", F.monotonically_increasing_id())
    held = stored(numbered, "simhash-rows")
    own = F.col(f"_c{names.index(key)}")
    prints = held.select("_fp", "_row", own.alias("_key"), F.xxhash64(*kinds.names[1:]).alias("_order"))
    known = _groups(prints, max_bits).select("_fp", "_group")
    place = F.struct(F.col("_key").isNull().alias("_none"), "_key", "_order", "_row")
    first = prints.join(known, "_fp").groupBy("_group").agg(F.min(place).alias("_first")).select("_first._row")
    return held.join(first, "_row", "left_semi").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])
