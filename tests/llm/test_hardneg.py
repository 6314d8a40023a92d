"""Hard negatives next to a loop over all rows."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourloom.llm import hardneg
from hourloom.llm.queries import op13_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, x string, rank string, shard string, _s string"


def by_hand(rows, scale=256, every=100):
    """The contract, row by row; rows are (id, vector, label)."""
    taking = []
    for place, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        taking.append((place, math.inf if i is None else i, label, [math.floor(scale * float(np.float32(x))) for x in v]))
    out = []
    for a in taking:
        if a[1] == math.inf or a[1] % every:
            continue
        ranked = sorted(((-sum(p * q for p, q in zip(a[3], r[3], strict=False)), r[1], r[0], r[2]) for r in taking if r[0] != a[0]))
        for score, positive, _, _ in [r for r in ranked if r[3] == a[2]][:5]:
            p = -score
            fits = [r for r in ranked if r[3] != a[2] and 30 * p <= -100 * r[0] <= 90 * p][:10]
            out += [(a[1], positive, k, r[1], p, -r[0]) for k, r in enumerate(fits, 1)]
    return sorted((tuple(None if x == math.inf else x for x in r) for r in out), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def mined(docs, every=100):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = docs.withColumn("label", label).withColumn("embedding", hardneg.whole("embedding", 256.0))
    got = hardneg.mine(rows, F.col("vec_id") % every == 0, vector="embedding").collect()
    return sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got), key=repr)


def clustered(n, dims=6, seed=1, classes=10):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 1, (classes, dims))
    labels = rng.integers(0, classes, n)
    near = centre[labels] + rng.normal(0, 0.8, (n, dims))
    return [(i, v.astype(np.float32).tolist(), int(c)) for i, (v, c) in enumerate(zip(near, labels, strict=True))]


@pytest.mark.parametrize("first,shard,block", [(hardneg.FIRST, hardneg.SHARD, hardneg.BLOCK), (20, (16, 16), (3, 3))])
def test_all_results_by_hand(spark, monkeypatch, first, shard, block):
    monkeypatch.setattr(hardneg, "FIRST", first)
    monkeypatch.setattr(hardneg, "SHARD", shard)
    monkeypatch.setattr(hardneg, "BLOCK", block)
    monkeypatch.setattr(hardneg, "CELL_ROWS", 16)
    rows = clustered(400)
    assert mined(table(spark, rows), 20) == by_hand(rows, every=20)


def test_copies_ties_nulls_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "SHARD", (8, 8))
    one = [0.5, 0.25, 0.0, 1.0]
    rows = [(i, one, 3) for i in range(150)] + [(200 + i, [x * 0.8 for x in one], 4) for i in range(60)]
    rows += [(100, one, 3), (0, one, 3), (None, one, 4), (None, [x * 0.7 for x in one], 5), (300, None, 1), (400, one, None)]
    rows += [(500, [0.1, None, 0.2, 0.3], 1), (600, [math.inf, 0.0, 0.0, 0.0], 1), (601, [math.nan, 0.0, 0.0, 0.0], 1)]
    rows += [(700, [], 2), (701, [1.0], 2), (800, [0.0] * 4, 2), (802, [-1.0, 0.5, 0.0, 0.0], 2), (900, [0.25, 0.25, 0.25], 3)]
    assert mined(table(spark, rows)) == by_hand(rows)


def test_large_components_are_held(spark):
    rows = [(100, [3e38, 1.0], 1), (1, [3e38, -1.0], 1), (2, [1.0, 3e38], 2)]
    got = mined(table(spark, rows))
    assert got == [] or all(abs(r[4]) < 2**55 for r in got)


def test_empty_and_without_anchors(spark):
    assert mined(table(spark, [])) == []
    assert mined(table(spark, [(1, [1.0], 1), (2, [1.0], 2)])) == []
    assert mined(table(spark, [(100, [1.0, 2.0], 1)])) == []


def test_walk_meets_every_cell_by_falling_bounds_that_hold():
    rng = np.random.default_rng(4)
    m = rng.integers(-200, 200, (500, 8)).astype(float)
    one, two = hardneg.fit_codes(m[:, :4], 6), hardneg.fit_codes(m[:, 4:], 5)
    (a, x), (b, y) = hardneg.nearest(m[:, :4], one), hardneg.nearest(m[:, 4:], two)
    cell = a * 5 + b
    radius = np.zeros((30, 2))
    for c, r1, r2 in zip(cell, x, y, strict=True):
        radius[c] = np.maximum(radius[c], (r1, r2))
    count = np.bincount(cell, minlength=30)
    boxes = hardneg.packed(count, 20)
    cells = hardneg.Cells(one, two, radius, count, boxes, boxes)
    for q in m[:20]:
        met = list(cells.walk(q))
        assert sorted(c for _, c, _, _ in met) == list(range(30))
        assert all(p[0] >= n[0] - 1e-9 for p, n in itertools.pairwise(met))
        scores = m @ q
        for bound, c, low, high in met:
            here = scores[cell == c]
            assert high <= bound + 1e-6 and (not len(here) or (low <= here.min() and here.max() <= high))


def test_certified_stop_leaves_cells_out():
    one = np.array([[1000.0, 0.0], [-1000.0, 0.0]])
    count, boxes = np.full(4, 10), hardneg.packed(np.full(4, 10), 10)
    cells = hardneg.Cells(one, one, np.full((4, 2), 5.0), count, boxes, boxes)
    q = np.array([100.0, 0.0, 100.0, 0.0])
    assert cells.needed(q, [(100_000.0, math.inf)], None) == {0}
    assert cells.needed(q, [(-1000.0, 1000.0)], None) == {1, 2}
    assert cells.needed(q, [(-math.inf, math.inf)], None) == {0, 1, 2, 3}
    assert cells.needed(q, [(-math.inf, math.inf)], 11) == {0, 1}


def test_boxes_hold_no_more_than_their_room():
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 50, 300)
    first, boxes = hardneg.packed(sizes, 40)
    load = {}
    for n, f, b in zip(sizes.tolist(), first.tolist(), boxes.tolist(), strict=True):
        assert b == 1 or n > 40
        for k in range(b):
            load[f + k] = load.get(f + k, 0) + -(-n // b)
    assert max(load.values()) <= 40


def test_products_are_exact_beyond_doubles():
    a, b = np.array([[2**26, 1]], np.int32), np.array([[2**26 - 1, 1], [2**27, -1]], np.int32)
    assert hardneg.products(a, b).tolist() == [[2**26 * (2**26 - 1) + 1, 2**53 - 1]]


def test_whole_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = op13_hard_negatives(spark, sf).collect()
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert got and sorted((tuple(r[c] for c in names) for r in got), key=repr) == by_hand(rows)
