"""Hard negatives against the full table of scores."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import hard_negatives as hard

COLUMNS = "vec_id long, embedding array<double>, label int"


def brute(rows, positives=5, negatives=5):
    use = [(k, i, label, [math.floor(256 * x) for x in v]) for k, (i, v, label) in enumerate(rows) if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, i, label, v in use:
        if i is None or i % 100:
            continue
        score = lambda w: min(sum(a * b for a, b in zip(v, w)), 2**63 - 1)
        order = lambda c: (-c[0], c[1] is None, c[1] or 0, c[2])
        others = sorted([(score(w), j, n, other) for n, j, other, w in use if n != k and len(w) == len(v)], key=order)
        for p in [c for c in others if c[3] == label][:positives]:
            fit = [c for c in others if c[3] != label and 80 * p[0] <= 100 * c[0] <= 100 * p[0]][:negatives]
            out += [(i, p[1], rank, n[1], p[0], n[0]) for rank, n in enumerate(fit, 1)]
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted([tuple(r) for r in df.collect()], key=repr)


def mined(df, **options):
    return hard.hard_negatives(df, F.col("vec_id") % 100 == 0, **options)


def vectors(seed, n, dim=8):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = []
    for k in range(n):
        c = r.choice(centres)
        rows.append((k * 10, [x + r.gauss(0, 0.4) for x in c], r.choice([0, 0, 0, 1, 2, 3])))
    return rows


@pytest.mark.parametrize("block,anchor_block", [(2048, 512), (16, 4)])
def test_against_all_scores(spark, block, anchor_block):
    rows = vectors(block, 600)
    rows += [(10_000 + k, rows[7][1], k % 3) for k in range(40)]  # copies, so ties
    df = spark.createDataFrame(rows, COLUMNS).repartition(4)
    want = brute(rows)
    assert len(want) > 300 and got(mined(df, block=block, anchor_block=anchor_block)) == want


def test_odd_rows(spark):
    rows = vectors(4, 60, 3) + [(100, None, 1), (200, [1.0, None, 2.0], 1), (300, [1.0, float("nan"), 0.0], 1), (400, [float("inf"), 0.0, 0.0], 0), (500, [1.0, 1.0, 1.0], None)]
    rows += [(100, [1.0, 0.5], 1), (3, [1.0, 0.5], 1), (5, [0.9, 0.5], 2), (None, [0.9, 0.5], 2), (600, [], 1), (7, [], 2), (9, [], 1)]
    rows += [(700, [3e7, -2e9, 5e8], 4), (11, [3e7, -2e9, 5e8], 4), (12, [2.9e7, -1.9e9, 4e8], 5), (-100, [0.0, 0.0, 0.0], 4)]
    repeated = [(0, [1.0, 0.0, 0.0], 9)] * 3 + [(13, [0.9, 0.0, 0.0], 8)]
    table = [r for r in rows if r[0] not in (0,)] + repeated
    df = spark.createDataFrame(table, COLUMNS).coalesce(1)
    want = brute(table)
    assert got(mined(df)) == want
    wide = df.select("*", *[F.lit(1).alias(c) for c in ("row", "data", "norm", "dim", "anchor", "table", "near", "gap", "block", "a.b", "`q`")])
    assert got(mined(wide)) == want
    assert mined(df.filter("false")).count() == 0 and mined(df.filter("vec_id % 100 <> 0")).count() == 0


def test_brackets_hold_every_score():
    import numpy as np

    r = np.random.default_rng(1)
    v = np.floor(256 * (r.normal(size=(300, 16)) + 3 * r.normal(size=(12, 16))[np.arange(300) % 12]))
    norm = (v**2).sum(1)
    top, points = norm.max(), v[:12]
    ends = np.sqrt(np.maximum(top - norm[:12], 0))
    asked, rows = hard.pivot_distances(v[:50], np.zeros(50), points, ends), hard.pivot_distances(v, np.sqrt(top - norm), points, ends)
    low, high = hard.brackets(asked, rows, norm[:50], top)
    exact = v[:50] @ v.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high < np.sort(exact, 1)[:, -6:-5]).mean() > 0.05  # and some rows need no look
