"""Gradient boosting that goes on: one tree a round, from sums over blocks of binned rows.

Inputs are quantised once and written as blocks of codes. A round grows one tree on what is left of the
target: every pass over the blocks adds up, per open node, input and bin, the rows and their residuals;
only those sums leave the tasks, and the driver picks the splits. The smaller child of a split is summed,
its sibling is what remains of the parent. Inputs of few bins share one code, are summed together and told
apart afterwards; a pass follows only the branches that lead to a node it sums. The tree then moves the
predictions kept with the blocks, and the first pass of the next round also scores the validation rows, so
a stop costs one pass.

Trees grow by depth, or best leaf first up to a number of leaves. Columns are drawn per tree, rows per
round by a hash, leaf values carry L1 and L2 penalties. Every ``CUT`` rounds the blocks and trees are
written, which cuts the lineage; a run with a folder goes on from there. The result is Spark's own
boosted model, made from its table of nodes.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom import schema as S
from hourloom.models.kernel import kernel
from hourloom.session import shared_dir
from hourloom.sources.files import exists
from hourloom.sources.sinks import materialize

# Rows of a block, rounds between two written states, and partitions whose sums meet on the driver at once.
BLOCK_ROWS, CUT, FEW_PARTITIONS = 131_072, 50, 32
# A table of at most so many rows is boosted by one task: its passes are calls, not jobs, with the same result.
ONE_TASK_ROWS = 4 * BLOCK_ROWS
# A larger one is boosted by all tasks, by compiled loops where no state is to be written, and so many rows meet in a task.
COMPILED_ROWS, PART_ROWS = 4 * BLOCK_ROWS, 4_000_000
# Rows that the compiled loops work on at a time.
PIECE_ROWS = 16_384
# Rows that are given their codes at a time, and values of the code that inputs share.
CHUNK_ROWS, SHARED_CODES = 32_768, 256


@dataclass(frozen=True)
class Plan:
    """How trees grow. ``leaves``: best leaf first up to so many, else by depth."""

    rounds: int = 300
    step: float = 0.05
    depth: int | None = 7
    leaves: int | None = None
    rows: float = 0.8
    columns: float = 0.8
    min_leaf: int = 1
    l1: float = 0.0
    l2: float = 0.0
    patience: int = 20
    seed: int = S.SEED


# --- inputs as codes ----------------------------------------------------------------------------------


def cut_points(train: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Per input the values after which a bin ends, fewer than ``bins``.

    Between all different values where they are few, else approximate quantiles.
    """
    counts = train.agg(*[F.approx_count_distinct(c).alias(c) for c in features]).first()
    few = [c for c in features if counts[c] <= 0.8 * bins]
    probs = [i / bins for i in range(1, bins)]
    values = train.agg(
        *[
            (F.sort_array(F.collect_set(F.col(c).cast("double"))) if c in few
             else F.percentile_approx(F.col(c).cast("double"), probs, 20 * bins)).alias(c)
            for c in features
        ]
    ).first()
    out = []
    for c in features:
        v = np.unique(np.array(values[c] or [], dtype=float))
        out.append((v[1:] + v[:-1]) / 2 if c in few else v)
    return out


@dataclass(frozen=True)
class Packing:
    """Inputs that share a code: input ``f`` is digit ``(code // stride) % size`` of its group's code."""

    sizes: list[int]
    groups: list[list[int]]
    widths: list[int]
    at: dict[int, tuple[int, int]]

    @classmethod
    def of(cls, sizes: list[int]) -> Packing:
        groups, widths, at = [], [], {}
        for f in sorted((f for f in range(len(sizes)) if sizes[f] > 1), key=lambda f: -sizes[f]):
            g = next((i for i, w in enumerate(widths) if w * sizes[f] <= SHARED_CODES), len(groups))
            if g == len(groups):
                groups.append([])
                widths.append(1)
            at[f] = g, widths[g]
            groups[g].append(f)
            widths[g] *= sizes[f]
        return cls(sizes, groups, widths, at)

    def codes(self, x: np.ndarray) -> list[np.ndarray]:
        out = []
        for group, width in zip(self.groups, self.widths, strict=True):
            code = np.zeros(x.shape[1], np.uint8 if width <= 256 else np.uint16)
            for f in group:
                code += x[f] * code.dtype.type(self.at[f][1])
            out.append(code)
        return out

    def digit(self, f: int) -> np.ndarray:
        """The bin of input ``f`` for every code of its group."""
        g, stride = self.at[f]
        return np.arange(self.widths[g]) // stride % self.sizes[f]

    def used(self, inputs: list[int]) -> list[int]:
        return sorted({self.at[f][0] for f in inputs if f in self.at})

    def apart(self, sums: np.ndarray, inputs: list[int]) -> np.ndarray:
        """Sums per shared code (after a first column of all rows) as sums per bin of the inputs, one input after the other."""
        start, place = 1, {}
        for g in self.used(inputs):
            place[g], start = start, start + self.widths[g]
        out = []
        for f in inputs:
            if f not in self.at:
                out.append(sums[:, :1])
                continue
            g, stride = self.at[f]
            here = sums[:, place[g] : place[g] + self.widths[g]]
            out.append(here.reshape(len(sums), -1, self.sizes[f], stride).sum((1, 3)))
        return np.concatenate(out, 1)


# Rows side by side: whether they validate, shared codes, target, prediction so far, a number that draws them,
# and whether the next tree sees them (None: it sees all).
Block = tuple[bool, list[np.ndarray] | np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]


def binned(train: DataFrame, val: DataFrame | None, features: list[str], label: str, edges: list[np.ndarray], rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of codes as rows of binaries; a null or NaN input raises, as in the assembler.

    Rows get their codes where they are read; only codes are exchanged, to fill the blocks evenly.
    """
    kind = np.uint8 if all(len(e) < 256 for e in edges) else np.uint16
    names = ["val", "x", "y", "id"]
    ddl = "val boolean, x binary, y binary, id binary"

    def block(val: bool, parts: list[tuple]) -> pa.RecordBatch:
        x, y, ids = (np.concatenate(p, axis=-1) for p in zip(*parts, strict=True))
        made = [pa.array([val]), *(pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (x, y, ids))]
        return pa.RecordBatch.from_arrays(made, names=names)

    def filled(parts: Iterator[tuple[bool, tuple]], most: int) -> Iterator[pa.RecordBatch]:
        kept: dict[bool, list] = {False: [], True: []}
        for side, part in parts:
            kept[side].append(part)
            if sum(len(p[1]) for p in kept[side]) >= most:
                yield block(side, kept[side])
                kept[side] = []
        for side, left in kept.items():
            if left:
                yield block(side, left)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[bool, tuple]]:
            for batch in batches:
                cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                if any(np.isnan(c).any() for c in cols[2:]):
                    raise ValueError("an input or the target is null or NaN")
                x = np.stack([np.searchsorted(e, c, "left").astype(kind) for e, c in zip(edges, cols[3:], strict=True)])
                for side in (False, True):
                    here = cols[0] == side
                    if here.any():
                        yield side, (x[:, here], cols[2][here], cols[1][here].astype(np.uint64))

        return filled(parts(), min(rows, CHUNK_ROWS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[bool, tuple]]:
            for batch in batches:
                for row in batch.to_pylist():
                    y = np.frombuffer(row["y"], float)
                    yield row["val"], (np.frombuffer(row["x"], kind).reshape(-1, len(y)), y, np.frombuffer(row["id"], np.uint64))

        return filled(parts(), rows)

    def flat(df: DataFrame, side: bool) -> DataFrame:
        numbers = [F.col(c).cast("double").alias(c) for c in (label, *features)]
        return df.select(F.lit(side).alias("_val"), F.monotonically_increasing_id().alias("_id"), *numbers)

    both, n = flat(train, False), train.count()
    if val is not None:
        both, n = both.unionByName(flat(val, True)), n + val.count()
    return both.mapInArrow(code, ddl).repartition(max(1, -(-n // rows))).mapInArrow(pack, ddl)


@dataclass(frozen=True)
class Codes:
    """Rows quantised and written once, for models over any of these inputs."""

    blocks: DataFrame
    features: list[str]
    label: str
    bins: int
    edges: list[np.ndarray]
    has_val: bool


def quantised(train: DataFrame, val: DataFrame | None, features: list[str], label: str, bins: int) -> Codes:
    """The codes of all inputs; each input gets the bins it would get alone."""
    edges = cut_points(train, features, bins)
    blocks = materialize(binned(train, val, features, label, edges), "codes")
    return Codes(blocks, list(features), label, bins, edges, val is not None)


def rows_of(table: DataFrame) -> int:
    """Rows in written blocks."""
    return (table.agg(F.sum(F.octet_length("id"))).first()[0] or 0) // 8


def opened(row: Any, inputs: int, only: list[int] | None = None) -> Block:
    """A block as it was written: codes by input, which ``boost`` packs; ``only`` picks some inputs."""
    y = np.frombuffer(row["y"], float)
    wide = len(row["x"]) > inputs * len(y)
    x = np.frombuffer(row["x"], np.uint16 if wide else np.uint8).reshape(inputs, len(y))
    if only is not None:
        x = x[only]
    slim = y.astype(np.float32)
    return row["val"], x, slim if (slim == y).all() else y, np.zeros(len(y)), np.frombuffer(row["id"], np.uint64), None


# --- trees --------------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes in arrays; a leaf has input -1. Children of a node lie side by side."""

    input: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    total: list[float] = field(default_factory=list)
    count: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, total: float, count: int, plan: Plan) -> int:
        for column, v in ((self.input, -1), (self.cut, 0), (self.left, -1), (self.total, total), (self.count, count), (self.gain, 0.0)):
            column.append(v)
        self.value.append(math.copysign(max(abs(total) - plan.l1, 0.0), total) / (count + plan.l2) if count else 0.0)
        return len(self.input) - 1

    def steps(self, packing: Packing) -> dict[int, tuple[int, np.ndarray, int]]:
        """Per split: the group of its input, which codes go to the right, and the left child."""
        known: dict[tuple[int, int], np.ndarray] = {}
        out = {}
        for node, (f, cut) in enumerate(zip(self.input, self.cut, strict=True)):
            if f >= 0:
                if (f, cut) not in known:
                    known[f, cut] = packing.digit(f) > cut
                out[node] = packing.at[f][0], known[f, cut], self.left[node]
        return out


# Per split: the group of its input, which codes go to the right, and the left child.
Steps = dict[int, tuple[int, np.ndarray, int]]


def parted(codes: list[np.ndarray], at: np.ndarray, step: tuple[int, np.ndarray, int]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a node as those of its left and its right child."""
    right = step[1][codes[step[0]][at]]
    return at[~right], at[right]


def reached(codes: list[np.ndarray], at: np.ndarray, steps: Steps, until: set[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(node, row numbers) of the leaves, or of the nodes in ``until`` along the steps that lead there."""
    todo = [(0, at)]
    while todo:
        node, at = todo.pop()
        if until is not None and node in until or node not in steps:
            if until is None or node in until:
                yield node, at
        elif len(at):
            left, right = parted(codes, at, steps[node])
            todo += [(steps[node][2], left), (steps[node][2] + 1, right)]


def moved(block: Block, steps: Steps, value: np.ndarray) -> np.ndarray:
    """Predictions after a tree."""
    pred = block[3].copy()
    for node, at in reached(block[1], np.arange(len(pred), dtype=np.int32), steps):
        pred[at] += value[node]
    return pred


def _soft(total: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(total) * np.maximum(np.abs(total) - l1, 0)


def _score(total: np.ndarray, count: np.ndarray, plan: Plan) -> np.ndarray:
    return _soft(total, plan.l1) ** 2 / np.maximum(count + plan.l2, 1e-12)


# Per slot, and per bin of the drawn inputs one after the other: rows, and their residuals.
Sums = tuple[np.ndarray, np.ndarray]


def best_splits(sums: Sums, inputs: list[int], sizes: list[int], plan: Plan) -> list[tuple[float, int, int, float, int]]:
    """For each slot: gain, input, last bin of the left side, its residuals and rows; gain 0 without a split."""
    count, total = sums
    slots = len(count)
    best = [np.zeros(slots), np.zeros(slots, int), np.zeros(slots, int), np.zeros(slots), np.zeros(slots, int)]
    at = 0
    for f in inputs:
        n = np.cumsum(count[:, at : at + sizes[f]], axis=1)
        g = np.cumsum(total[:, at : at + sizes[f]], axis=1)
        at += sizes[f]
        if sizes[f] < 2:
            continue
        every, whole = n[:, -1:], g[:, -1:]
        left, right = n[:, :-1], every - n[:, :-1]
        gain = _score(g[:, :-1], left, plan) + _score(whole - g[:, :-1], right, plan) - _score(whole, every, plan)
        gain[(left < plan.min_leaf) | (right < plan.min_leaf)] = 0
        k = gain.argmax(1)
        rows = np.arange(slots)
        better = gain[rows, k] > best[0] * (1 + 1e-12) + 1e-12
        for column, new in zip(best, (gain[rows, k], np.full(slots, f), k, g[rows, k], n[rows, k]), strict=True):
            column[better] = new[better]
    return list(zip(*(c.tolist() for c in best), strict=True))


def drawn(ids: np.ndarray, share: float, seed: int) -> np.ndarray:
    """Rows of a round: a hash of each row's number falls below the share."""
    z = ids + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    return (z ^ (z >> np.uint64(31))) >> np.uint64(11) < np.uint64(int(share * 2**53))


def seen(block: Block) -> np.ndarray:
    """Numbers of the rows that the next tree sees."""
    return np.arange(len(block[2]), dtype=np.int32) if block[5] is None else np.flatnonzero(block[5]).astype(np.int32)


def narrowed(block: Block) -> Block:
    at = seen(block)
    return False, [c[at] for c in block[1]], (block[2] - block[3])[at], np.float64(0), at[:0], None


class Pass:
    """What a pass gives for each block, and what becomes of a partition's sum before it leaves the task."""

    def __init__(self, of: Callable[[Block], list], finish: Callable[[list], list]):
        self.of, self.finish = of, finish

    def __call__(self, block: Block) -> list:
        return self.of(block)


def summed(block: Block, nodes: Iterator[tuple[int, np.ndarray]], slots: int, packing: Packing, inputs: list[int]) -> Sums:
    """Sums of one block's rows per slot and shared code, after a column of all rows."""
    groups = packing.used(inputs)
    width = 1 + sum(packing.widths[g] for g in groups)
    count, total = np.zeros((slots, width), np.int64), np.zeros((slots, width))
    rest = block[2] - block[3]
    for slot, at in nodes:
        if not len(at):
            continue
        here = rest[at]
        count[slot, 0], total[slot, 0] = len(at), here.sum()
        done = 1
        for g in groups:
            code, size = block[1][g][at], packing.widths[g]
            count[slot, done : done + size] = np.bincount(code, minlength=size)
            total[slot, done : done + size] = np.bincount(code, here, size)
            done += size
    return count, total


class Spread:
    """Blocks as a dataset that is kept in memory and on disk; passes are jobs."""

    def __init__(self, blocks: RDD):
        self.blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        self.base = self.blocks

    def sums(self, of: Callable[[Block], list]) -> list:
        """Elementwise sums of what ``of`` gives for each block."""

        def part(blocks: Iterator[Block]) -> Iterator[list]:
            out = None
            for b in blocks:
                new = of(b)
                out = new if out is None else [p + q for p, q in zip(out, new, strict=True)]
            if out is not None:
                yield of.finish(out) if isinstance(of, Pass) else out

        def both(a: list, b: list) -> list:
            return [p + q for p, q in zip(a, b, strict=True)]

        parts = self.blocks.mapPartitions(part)
        if self.blocks.getNumPartitions() > FEW_PARTITIONS:
            return parts.treeReduce(both, depth=2)
        got = parts.collect()
        out = got[0]
        for p in got[1:]:
            out = both(out, p)
        return out

    def move(self, by: Callable[[Block], Block]) -> None:
        """Blocks with new predictions; the next pass makes and keeps them."""
        old, self.blocks = self.blocks, self.blocks.map(by).persist(StorageLevel.MEMORY_AND_DISK)
        self.older = getattr(self, "older", [])
        self.older.append(old)
        if len(self.older) > 1:  # its successor is in place by now
            self.older.pop(0).unpersist()

    def view(self) -> Spread:
        """What the next tree reads: codes and residuals of the rows it sees."""
        return Spread(self.blocks.filter(lambda b: not b[0]).map(narrowed))

    def cut(self, path: str) -> None:
        """Write the blocks to the shared folder and go on from there."""
        self.blocks.saveAsPickleFile(path)
        self.close()
        self.blocks = self.blocks.context.pickleFile(path).persist(StorageLevel.MEMORY_AND_DISK)

    def close(self) -> None:
        for r in [*getattr(self, "older", []), self.blocks]:
            r.unpersist()
        self.older = []


class Held:
    """A bounded number of blocks in one task, put together into one of training and one of validation rows."""

    def __init__(self, blocks: list[Block]):
        sides = [[b for b in blocks if b[0] == side] for side in (False, True)]
        self.blocks = [
            (side[0][0], *(np.concatenate([b[i] for b in side], axis=-1) for i in range(1, 5)), None) for side in sides if side
        ]

    def sums(self, of: Callable[[Block], list]) -> list:
        out = of(self.blocks[0])
        for b in self.blocks[1:]:
            out = [p + q for p, q in zip(out, of(b), strict=True)]
        return of.finish(out) if isinstance(of, Pass) else out

    def move(self, by: Callable[[Block], Block]) -> None:
        self.blocks = [by(b) for b in self.blocks]


def grow(data: Spread | Held, plan: Plan, inputs: list[int], packing: Packing, first: Sums) -> Tree:
    """One tree, given the sums of its root."""
    tree, sizes = Tree(), packing.sizes
    # Of blocks held in one task: where the rows stand, by block and node.
    known: dict[int, dict[int, np.ndarray]] | None = {} if isinstance(data, Held) else None
    at = sizes[inputs[0]]
    tree.add(float(first[1][0, :at].sum()), int(first[0][0, :at].sum()), plan)
    sums = {0: (first[0][0], first[1][0])}
    splits = {0: best_splits(first, inputs, sizes, plan)[0]}
    depth, open_ = {0: 0}, [0]

    def split(node: int) -> tuple[int, int]:
        gain, f, k, total, count = splits[node]
        tree.input[node], tree.cut[node], tree.gain[node] = f, k, gain
        left = tree.add(total, count, plan)
        right = tree.add(tree.total[node] - total, tree.count[node] - count, plan)
        tree.left[node] = left
        depth[left] = depth[right] = depth[node] + 1
        return left, right

    def expand(nodes: list[int]) -> list[int]:
        """Split nodes and sum their children in one pass."""
        made = [split(node) for node in nodes]
        wanted = [(n, c) for n, c in zip(nodes, made, strict=True) if plan.leaves or depth[c[0]] < (plan.depth or 10**9)]
        if wanted:
            small = {min(c, key=lambda i: tree.count[i]): k for k, (_, c) in enumerate(wanted)}
            steps = tree.steps(packing)
            # Splits on the way to the nodes that are summed; the others end the descent.
            way, parent = set(), {c: n for n, s in steps.items() for c in (s[2], s[2] + 1)}
            for node in (n for n, _ in wanted):
                while node not in way:
                    way.add(node)
                    node = parent.get(node, node)
            steps = {n: steps[n] for n in way}

            def of(b: Block) -> list:
                if b[0]:
                    return [*summed(b, iter(()), len(small), packing, inputs)]
                if known is None:
                    nodes = reached(b[1], seen(b), steps, set(small))
                else:
                    spots = known.setdefault(id(b[1]), {0: seen(b)} if 0 in steps else {})
                    for node, (left, right) in wanted:
                        spots[left], spots[right] = parted(b[1], spots.pop(node), steps[node])
                    nodes = ((i, spots[i]) for i in small)
                return [*summed(b, ((small[i], at) for i, at in nodes), len(small), packing, inputs)]

            def apart(sums: list) -> list:
                return [packing.apart(a, inputs) for a in sums]

            count, total = data.sums(Pass(of, apart))
            for k, (node, (left, right)) in enumerate(wanted):
                mine = (count[k], total[k])
                rest = (sums[node][0] - count[k], sums[node][1] - total[k])
                sums[left], sums[right] = (mine, rest) if left in small else (rest, mine)
                del sums[node]
            children = [i for _, c in wanted for i in c]
            found = best_splits(tuple(np.stack([sums[i][j] for i in children]) for j in (0, 1)), inputs, sizes, plan)
            splits.update(zip(children, found, strict=True))
            return children
        return []

    if plan.leaves is None:
        while open_:
            open_ = expand([n for n in open_ if splits[n][0] > 0])
        return tree
    expanded: set[int] = set()
    while True:
        # Best leaf first with what is known; whoever is reached without known children is summed next.
        chosen, missing, heap = [], [], [(-splits[0][0], 0)]
        while heap and len(chosen) < plan.leaves - 1:
            gain, node = heapq.heappop(heap)
            if gain >= 0:
                break
            chosen.append(node)
            if node in expanded:
                for child in (tree.left[node], tree.left[node] + 1):
                    if plan.depth is None or depth[child] < plan.depth:
                        heapq.heappush(heap, (-splits[child][0], child))
            else:
                missing.append(node)
        if not missing:
            return _pruned(tree, set(chosen), plan)
        expand(missing)
        expanded.update(missing)


def _pruned(tree: Tree, chosen: set[int], plan: Plan) -> Tree:
    """The tree with only the chosen splits, nodes numbered anew."""
    out = Tree()
    out.add(tree.total[0], tree.count[0], plan)
    todo = [(0, 0)]
    while todo:
        old, new = todo.pop(0)
        if old not in chosen:
            continue
        out.input[new], out.cut[new], out.gain[new] = tree.input[old], tree.cut[old], tree.gain[old]
        for k, child in enumerate((tree.left[old], tree.left[old] + 1)):
            at = out.add(tree.total[child], tree.count[child], plan)
            if k == 0:
                out.left[new] = at
            todo.append((child, at))
    return out


# --- rounds -------------------------------------------------------------------------------------------


def best_round(errors: list[float], patience: int) -> tuple[int, bool]:
    """Rounds to keep under a stop after ``patience`` rounds without a better score.

    The flag says whether the stop was reached within the scores at hand.
    """
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


@dataclass
class Run:
    """A start value, the trees so far and the validation error after each."""

    start: float
    trees: list[Tree] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)

    def kept(self, patience: int) -> list[Tree]:
        return self.trees[: best_round(self.errors, patience)[0]] if self.errors else self.trees


def boost(data: Spread | Held, plan: Plan, sizes: list[int], check: bool, run: Run | None = None, done: Callable[[Run], None] | None = None) -> Run:
    """Rounds until the plan's end, or until the validation error has not fallen for ``patience`` rounds.

    ``done`` is called after each round; ``run`` goes on with a run whose trees are in the predictions.
    """
    packing = Packing.of(sizes)

    def use(b: Block, k: int) -> np.ndarray | None:
        return drawn(b[4], plan.rows, plan.seed * 1_000_003 + k) if plan.rows < 1 and not b[0] else None

    if run is None:
        total, n = data.sums(lambda b: [0.0, 0] if b[0] else [float(b[2].sum(dtype=float)), len(b[2])])
        run = Run(total / n if n else 0.0)
        start = run.start
        data.move(lambda b: (b[0], packing.codes(b[1]), b[2], b[3] + start, b[4], use(b, 0)))
    every = len(sizes)
    some = max(1, round(plan.columns * every))
    while True:
        k = len(run.trees)
        if k >= plan.rounds and not check:
            return run
        inputs = sorted(np.random.default_rng([plan.seed, k]).permutation(every)[:some].tolist())

        def first(b: Block, inputs=inputs) -> list:
            off, n = (float(((b[2] - b[3]) ** 2).sum()), len(b[2])) if b[0] else (0.0, 0)
            return [*summed(b, iter(()) if b[0] else iter([(0, seen(b))]), 1, packing, inputs), off, n]

        def apart(sums: list, inputs=inputs) -> list:
            return [packing.apart(sums[0], inputs), packing.apart(sums[1], inputs), *sums[2:]]

        count, total, off, n = data.sums(Pass(first, apart))
        if check and k and n:
            run.errors.append(float(np.sqrt(off / n)))
            if best_round(run.errors, plan.patience)[1]:
                return run
        if k >= plan.rounds:
            return run
        view = data.view() if isinstance(data, Spread) else data
        try:
            tree = grow(view, plan, inputs, packing, (count, total))
        finally:
            if view is not data:
                view.close()
        run.trees.append(tree)
        steps, value = tree.steps(packing), plan.step * np.array(tree.value)
        data.move(lambda b, steps=steps, value=value, k=k: (*b[:3], moved(b, steps, value), b[4], use(b, k + 1)))
        if done:
            done(run)


# --- Spark's model ------------------------------------------------------------------------------------

_NODES = (
    "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, "
    "gain double, leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"
)


def _rows_of(number: int, tree: Tree, edges: list[np.ndarray]) -> Iterator[tuple]:
    """A tree's nodes in Spark's order: a node before its left side before its right side."""
    order, todo = [], [0]
    while todo:
        node = todo.pop()
        order.append(node)
        if tree.input[node] >= 0:
            todo += [tree.left[node] + 1, tree.left[node]]
    place = {node: i for i, node in enumerate(order)}
    for i, node in enumerate(order):
        f, n = tree.input[node], tree.count[node]
        stats = [float(n), tree.total[node], 0.0]
        if f < 0:
            yield number, (i, tree.value[node], 0.0, stats, n, -1.0, -1, -1, (-1, [], -1))
        else:
            left, cut = tree.left[node], float(edges[f][tree.cut[node]])
            yield number, (i, tree.value[node], 0.0, stats, n, tree.gain[node] / max(n, 1), place[left], place[left + 1], (f, [cut], -1))


def to_model(spark: SparkSession, run: Run, trees: list[Tree], edges: list[np.ndarray], plan: Plan, label: str) -> GBTRegressionModel:
    """Spark's boosted model over the real values of the inputs; its first tree is the start value alone."""
    path = shared_dir(spark, "ensemble")
    constant = Tree()
    constant.add(0.0, 1, plan)
    constant.value[0] = run.start
    nodes = [row for k, t in enumerate([constant, *trees]) for row in _rows_of(k, t, edges)]
    spark.createDataFrame(nodes, _NODES).write.parquet(f"{path}/data")
    uid = GBTRegressor().uid

    def named(kind: str, uid: str, params: dict, **more: int) -> str:
        about = {"class": f"org.apache.spark.ml.regression.{kind}", "timestamp": 0, "sparkVersion": spark.version, "uid": uid}
        return json.dumps({**about, "paramMap": params, "defaultParamMap": {}, **more})

    own = {"featuresCol": "features", "predictionCol": "prediction", "leafCol": "", "impurity": "variance"}
    params = {**own, "labelCol": label, "stepSize": plan.step, "seed": plan.seed}
    whole = named("GBTRegressionModel", uid, params, numFeatures=len(edges), numTrees=1 + len(trees))
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    each = [
        (k, named("DecisionTreeRegressionModel", f"{uid}_{k}", own), plan.step if k else 1.0)
        for k in range(1 + len(trees))
    ]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
    return GBTRegressionModel.load(path)


def _state(path: str, rounds: int) -> tuple[str, str]:
    return f"{path}/state-{rounds}/blocks", f"{path}/state-{rounds}/trees"


def _write_trees(spark: SparkSession, run: Run, path: str) -> None:
    rows = [(k, json.dumps(vars(t))) for k, t in enumerate(run.trees)]
    rows.append((-1, json.dumps({"start": run.start, "errors": run.errors})))
    spark.createDataFrame(rows, "place int, body string").coalesce(1).write.parquet(path)


def _read_trees(spark: SparkSession, path: str) -> Run:
    rows = {r.place: json.loads(r.body) for r in spark.read.parquet(path).collect()}
    about = rows.pop(-1)
    return Run(about["start"], [Tree(**rows[k]) for k in sorted(rows)], about["errors"])


def spread(spark: SparkSession, table: DataFrame, inputs: int, only: list[int] | None = None) -> Spread:
    """Written blocks as a dataset of at most twice as many partitions as run side by side."""
    wide = 2 * spark.sparkContext.defaultParallelism
    parts = min(wide, max(1, -(-rows_of(table) // BLOCK_ROWS)))
    return Spread(table.repartition(parts).rdd.map(lambda row: opened(row, inputs, only)))


def compiled(
    table: DataFrame, plan: Plan, sizes: list[int], check: bool, inputs: int, only: list[int] | None = None, one_task: bool = True
) -> tuple[Run, list[float]]:
    """A run over written blocks by the loops of ``Boost.java``, in one task or in all, and its clipped errors after each round."""
    spark = table.sparkSession
    parts = 1 if one_task else max(spark.sparkContext.defaultParallelism, -(-rows_of(table) // PART_ROWS))
    every = len(sizes)
    some = max(1, round(plan.columns * every))
    drawn = [sorted(np.random.default_rng([plan.seed, k]).permutation(every)[:some].tolist()) for k in range(max(1, plan.rounds))]
    depth, leaves = (-1 if v is None else v for v in (plan.depth, plan.leaves))
    words = [max(1, plan.rounds), depth, leaves, plan.min_leaf, plan.patience, inputs, CUT, PIECE_ROWS, plan.seed, int(check)]
    words += [repr(float(v)) for v in (plan.step, plan.rows, plan.l1, plan.l2)]
    for numbers in (sizes, list(range(inputs)) if only is None else only, *drawn):
        words += [len(numbers), *numbers]
    wide = max(sizes) > 256
    loops = kernel(spark, "Boost", CODE="short" if wide else "byte", MASK="65535" if wide else "255", WIDTH="wide" if wide else "slim")
    blocks = table.select("val", "x", "y", "id")
    blocks = blocks.coalesce(1) if one_task else blocks.repartition(parts)
    text = " ".join(map(str, words))
    found = json.loads((loops.inOneTask if one_task else loops.spread)(blocks._jdf.javaRDD(), text))
    return Run(found["start"], [Tree(**t) for t in found["trees"]], found["errors"]), found["clipped"]


def fit(
    train: DataFrame, val: DataFrame | None, plan: Plan, features: list[str], label: str, bins: int, path: str | None = None,
    made: Codes | None = None,
) -> tuple[GBTRegressionModel, Run]:
    """Quantise, boost, and give Spark's model with the trees up to the best round.

    With ``path`` every ``CUT``-th state stays there, and a run that was broken off goes on from the last.
    ``made``: the same rows as ``quantised`` wrote them, for models over some of their inputs.
    """
    spark = train.sparkSession
    folder = path or shared_dir(spark, "boost")
    codes, only = f"{folder}/codes", None
    if made is not None:
        if path or (made.label, made.bins, made.has_val) != (label, bins, val is not None):
            raise ValueError("codes of another label, number of bins or validation, or a path beside them")
        only = [made.features.index(f) for f in features]
        table, edges, inputs = made.blocks, [made.edges[i] for i in only], len(made.features)
    else:
        if path and exists(spark, f"{codes}/edges/_SUCCESS"):
            edges = [np.array(r.cuts) for r in spark.read.parquet(f"{codes}/edges").orderBy("place").collect()]
        else:
            edges = cut_points(train, features, bins)
            binned(train, val, features, label, edges).write.mode("overwrite").parquet(f"{codes}/blocks")
            rows = [(i, e.tolist()) for i, e in enumerate(edges)]
            spark.createDataFrame(rows, "place int, cuts array<double>").coalesce(1).write.mode("overwrite").parquet(f"{codes}/edges")
        table, inputs = spark.read.parquet(f"{codes}/blocks"), len(features)
    sizes = [len(e) + 1 for e in edges]
    if not path:
        rows = rows_of(table)
        one_task = 0 < rows <= ONE_TASK_ROWS
        if plan.rounds and (one_task or rows > COMPILED_ROWS):
            run, _ = compiled(table, plan, sizes, val is not None, inputs, only, one_task)
            return to_model(spark, run, run.kept(plan.patience), edges, plan, label), run
    done = [k for k in range(CUT, plan.rounds + 1, CUT) if path and exists(spark, f"{_state(folder, k)[1]}/_SUCCESS")]
    if done:
        run = _read_trees(spark, _state(folder, done[-1])[1])
        data = Spread(spark.sparkContext.pickleFile(_state(folder, done[-1])[0]))
    else:
        run, data = None, spread(spark, table, inputs, only)

    def store(now: Run) -> None:
        if len(now.trees) % CUT == 0:
            blocks, trees = _state(folder, len(now.trees))
            data.cut(blocks)
            _write_trees(spark, now, trees)

    try:
        run = boost(data, plan, sizes, val is not None, run, store)
    finally:
        data.close()
    return to_model(spark, run, run.kept(plan.patience), edges, plan, label), run
