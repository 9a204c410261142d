import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.llm import negatives
from ebbtide.llm.negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, leaf int, anchor int, score int, rank int"


def plain(rows, positives=5, negatives_=10, low=30, high=90):
    """Every anchor against every row."""
    fine = [(i, [math.floor(256 * float(x)) for x in v], lab) for i, v, lab in rows
            if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for n, (i, v, lab) in enumerate(fine):
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other == lab) for m, (j, w, other) in enumerate(fine) if m != n]
        for ps, p, _ in sorted((s for s in scored if s[2]), key=key)[:positives]:
            ring = sorted((s for s in scored if not s[2] and low * ps <= 100 * s[0] <= high * ps), key=key)[:negatives_]
            out += [(i, p, k + 1, q, ps, s) for k, (s, q, _) in enumerate(ring)]
    return sorted(out, key=repr)


def vectors(seed, n, dim, spread=1.0):
    rnd = random.Random(seed)
    mids = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i * 10, [float(np.float32(m + rnd.gauss(0, spread))) for m in rnd.choice(mids)], rnd.randint(0, 3)) for i in range(n)]


def mine(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, lab, 0, 0, 0, 0) for i, v, lab in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, hard_negatives(df, F.col("vec_id") % 100 == 0, **kw).collect()), key=repr)


def test_equals_every_pair(spark):
    rows = vectors(1, 700, 8)
    got = mine(spark, rows)
    assert got and got == plain(rows)


def test_subtrees_are_left_out_and_blocks_and_batches_do_not_matter(spark, monkeypatch):
    rows = vectors(2, 900, 3, spread=0.05)
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 8 * 3 * 40)
    monkeypatch.setattr(negatives, "BATCH_ROWS", 16)
    monkeypatch.setattr(negatives, "BATCH_ANCHORS", 7)
    assert mine(spark, rows, positives=3, negatives=4) == plain(rows, 3, 4)
    x = np.floor(256 * np.array([v for _, v, _ in rows]))
    tree = negatives.Tree(x[:200], float((x * x).sum(1).max()), 3)
    leaf, seen = tree.place(x)
    tree.ranges = []
    for level, (node, child, away) in enumerate(seen):
        least, most = np.full((negatives.FAN**level, negatives.FAN, negatives.FAN), np.inf), np.full((negatives.FAN**level, negatives.FAN, negatives.FAN), -np.inf)
        for n, c, d in zip(node, child, away):
            least[n, :, c], most[n, :, c] = np.minimum(least[n, :, c], d), np.maximum(most[n, :, c], d)
        tree.ranges.append((least, most))
    scores = x[:50] @ x.T
    low, high = np.quantile(scores, 0.97, axis=1), scores.max(1)
    open_ = tree.leaves(x[:50], low, high)
    inside = (scores >= low[:, None]) & (scores <= high[:, None])
    assert all(open_[a, leaf[r]] for a, r in zip(*np.nonzero(inside)))
    assert open_.mean() < 0.6 * np.isin(np.arange(open_.shape[1]), leaf).mean()  # most leaves with rows are left out


def test_odd_rows(spark):
    rows = vectors(3, 60, 4)
    rows += [(0, rows[0][1], rows[0][2]), (100, None, 1), (200, [1.0, None, 0.0, 0.0], 1), (300, [float("nan")] * 4, 1), (400, [float("inf"), 0.0, 0.0, 0.0], 2)]
    rows += [(None, rows[5][1], 1), (None, rows[5][1], 2), (500, rows[5][1], None), (600, [], 1), (700, [0.5, 0.25], 1), (800, [0.0] * 4, 3), (900, [30000.0, -40000.0, 1.0, 2.0], 1)]
    rows += [(1100, rows[7][1], rows[7][2])] * 40  # repeated rows tie
    assert mine(spark, rows) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 1)], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 2)], [(0, [1.0], 1), (1, [1.0], 1)]])
def test_nothing_to_mine(spark, rows):
    assert mine(spark, rows) == []
