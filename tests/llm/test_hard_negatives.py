"""Hard negatives against brute force, with ties, repeated rows, many equal vectors, and trees of many pages."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int"
COLUMNS = "vec_id, embedding, label"


def plain(rows):
    kept = []
    for i, v, y in rows:
        if y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((hn.NO_ID if i is None else i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, tuple(math.floor(256 * x) for x in v)))
    kept = sorted(set(kept))
    out = []
    for a in (r for r in kept if r[0] % 100 == 0):
        order = sorted(((-sum(p * q for p, q in zip(a[2], r[2], strict=False)), r[0], r[1]) for r in kept if r != a))
        for s, i, _ in [o for o in order if o[2] == a[1]][:5]:
            found = [o for o in order if o[2] != a[1] and 80 * -s <= 100 * -o[0] <= 100 * -s][:5]
            out += [(a[0], None if i == hn.NO_ID else i, n + 1, None if o[1] == hn.NO_ID else o[1], -s, -o[0]) for n, o in enumerate(found)]
    return sorted(out, key=str)


def got(frame, **options):
    return sorted((tuple(r) for r in hn.mine(frame, **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def vectors(seed, n, dims, spread=0.15):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dims))
    x = centres[r.integers(0, 12, n)] + spread * r.normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_equals_brute_force_on_many_pages_tiles_and_parts(spark):
    x = vectors(1, 1_500, 6)
    x[200:700] = x[200]  # a third are equal
    rows = [(i, v.tolist(), i % 4) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for c in ("tile", "part", "v", "page", "block", "row", "score", "id", "window"):
        frame = frame.withColumn(c, F.lit("mine"))
    assert got(frame, tile_rows=300, page=64, leaf=8, block=4) == plain(rows)


def test_odd_rows(spark):
    r = random.Random(3)
    rows = [(i, [r.choice((-0.5, 0.0, 0.25, 0.5)) for _ in range(3)], i % 3) for i in range(250)]  # many ties
    rows += [(100, [0.5, 0.5, 0.5], 1), (100, [0.5, 0.5, 0.5], 1), (200, rows[200][1], rows[200][2]), (700, [0.5] * 3, 9), (701, [0.5] * 3, 0), (702, [0.5] * 3, 0)]
    rows += [(None, [0.5, 0.5, 0.25], 1), (None, [0.5, 0.5, 0.25], 1), (None, [0.5, 0.0, 0.25], 2), (800, None, 1), (801, [0.1, None, 0.2], 1), (802, [0.1, float("nan"), 0.2], 1), (803, [float("inf"), 0.1, 0.1], 1), (804, [0.1] * 3, None)]
    rows += [(900, [], 2), (901, [0.5], 2), (902, [0.5, 0.5], 1)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_large_components_are_summed_as_whole_numbers(spark):
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) * 3e6 for _ in range(4)], i % 3) for i in range(240)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    with pytest.raises(ValueError):
        hn.mine(spark.createDataFrame([(0, [1e300], 1), (1, [1.0], 1)], SCHEMA)).collect()


def test_no_rows(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(0, None, 1), (1, [None], 1)], SCHEMA)) == []
    assert got(spark.createDataFrame([(0, [0.5], 1)], SCHEMA)) == []


def test_boxes_are_pruned_and_bounds_hold():
    x = np.floor(256 * vectors(2, 4_000, 4, 0.05)).astype("<i2")
    order = hn.str_order(x.astype(float), 8)
    assert sorted(order.tolist()) == list(range(len(x)))
    starts = np.arange(0, len(x), 8)
    lo, hi = np.minimum.reduceat(x[order], starts).astype(float), np.maximum.reduceat(x[order], starts).astype(float)
    anchors = x[:20].astype(float)
    least, most = hn.bounds(anchors, lo, hi, True)
    scores = anchors @ x[order].T.astype(float)
    assert (np.minimum.reduceat(scores, starts, axis=1) >= least).all() and (np.maximum.reduceat(scores, starts, axis=1) <= most).all()
    fifth = np.sort(scores, axis=1)[:, -5][:, None]
    assert (most < fifth).mean() > 0.8  # what a queue never opens


def test_tiles_cover_every_row_once():
    x = np.floor(256 * vectors(4, 3_000, 5))
    tree = hn.fit_tiles(x[:500], 16)
    tiles = hn.tile_of(x, tree)
    assert len(np.unique(tiles)) >= 12 and np.bincount(tiles).max() < 900
    assert (hn.tile_of(x[::-1], tree)[::-1] == tiles).all()
