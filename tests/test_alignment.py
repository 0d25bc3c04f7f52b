"""Alignment: corridors against whole tables, locked anchors, segments as tasks."""

import tracemalloc
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import alignment as L
from gaugeworks.operators import kernels as K
from gaugeworks.plans.catalog import QUERIES
from gaugeworks.plans.signals import samples

DIR = "/root/testdata/sf0.001"


def cost(a, b):
    return np.minimum(np.abs(a[:, None] - b[None, :]), 1.0)


def pair(seed, kind, n=520, m=500):
    r = np.random.default_rng(seed)
    x = np.cumsum(r.normal(size=n)) * 0.1 if kind.startswith("walk") else r.normal(size=n) if kind.startswith("quick") else np.sin(np.arange(n) ** 1.3 / 3)
    y = x[np.sort(r.choice(np.arange(n).repeat(2), m, replace=False))]
    return x, y + r.normal(size=m) * (0.1 if kind.endswith("noise") else 0)


@pytest.mark.parametrize("kind", ["walk", "walk noise", "quick", "quick noise", "sine", "sine noise"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_corridors_cost_what_the_whole_table_does(kind, seed):
    x, y = pair(seed, kind)
    _, exact = K.align(cost(x, y))
    path, total = K.align_coarse_to_fine(x, y, cost)
    assert total <= exact * 1.01 + 1e-9
    assert all(a < c and b < d for (a, b), (c, d) in zip(path, path[1:]))


def test_one_more_frame_changes_little():
    """No length at which the method changes."""
    r = np.random.default_rng(3)
    x = r.normal(size=530)
    y = x[np.sort(r.choice(530, 505, replace=False))]
    totals = [K.align_coarse_to_fine(x[:n], y, cost)[1] for n in range(490, 530, 4)]
    assert np.abs(np.diff(totals)).max() <= 4 * 0.45 + 1e-9


def test_averaging_keeps_every_frame():
    x = np.arange(10.0)
    assert K.coarser(x, 4).tolist() == [1.5, 5.5, 8.5]
    assert K.coarser(np.stack([x, -x], 1), 4).tolist() == [[1.5, -1.5], [5.5, -5.5], [8.5, -8.5]]


def test_only_the_corridor_is_priced_and_kept():
    n, asked = 20_000, [0]

    def counted(a, b):
        asked[0] += len(a) * len(b)
        return cost(a, b)

    r = np.random.default_rng(8)
    x = np.cumsum(r.normal(size=n)) * 0.05
    y = x[np.sort(r.choice(np.arange(n).repeat(2), n, replace=False))]
    tracemalloc.start()
    path, _ = K.align_coarse_to_fine(x, y, counted)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert asked[0] < n * n / 8 and peak < 120 << 20 and len(path) > 0.8 * n


def test_locked_matches_hold_and_cost_least():
    """Against the whole table with every cell that shuns an anchor made dear."""
    r = np.random.default_rng(4)
    for n, m, locks in ((40, 50, [(10, 30), (11, 31), (30, 33)]), (9, 5, [(0, 0), (8, 4)]), (6, 6, [(5, 0)]), (3, 30, [(1, 20)])):
        x, y = r.normal(size=n), r.normal(size=m)
        path, total = K.align_locked(x, y, cost, locks)
        assert set(locks) <= set(path) and all(a < c and b < d for (a, b), (c, d) in zip(path, path[1:]))
        parts, i, j = 0.0, 0, 0
        for a, b in [*locks, (n, m)]:
            parts += K.align(cost(x[i:a], y[j:b]))[1] + (cost(x[a : a + 1], y[b : b + 1])[0, 0] if a < n else 0)
            i, j = a + 1, b + 1
        assert total == pytest.approx(parts, abs=1e-9)
    with pytest.raises(ValueError):
        K.align_locked(np.zeros(4), np.zeros(4), cost, [(2, 1), (1, 2)])


def test_short_segments_are_aligned_together(monkeypatch):
    """As one by one, to the last bit; only longer pairs are aligned alone."""
    r = np.random.default_rng(5)
    shapes = [(n, m) for n in range(6) for m in range(6) for _ in range(4)] + [(16, 40), (40, 12), (30, 30)]
    pairs = [(r.normal(size=n).round(1), r.normal(size=m).round(1), bool(n and m and k % 2)) for k, (n, m) in enumerate(shapes)]
    alone = [K.align_locked(x, y, cost, [(len(x) - 1, len(y) - 1)] if ended else []) for x, y, ended in pairs]
    seen, whole = [], K.align_locked
    monkeypatch.setattr(K, "align_locked", lambda x, y, *a, **b: seen.append((len(x), len(y))) or whole(x, y, *a, **b))
    assert K.align_many(pairs, cost) == alone and seen == [(30, 30)]


def test_anchors_that_do_not_rise_are_left_out(spark):
    rows = [("a", 3, 5), ("a", 3, 4), ("a", 1, 1), ("a", 5, 4), ("a", 6, 9), ("a", 7, 9), ("a", None, 2), ("b", 0, 0)]
    kept = L.kept_anchors(spark.createDataFrame(rows, "k string, i long, j long"), ["k"]).collect()
    assert sorted((r["k"], r["segment"], r["i"], r["j"]) for r in kept) == [("a", 0, 1, 1), ("a", 1, 3, 4), ("a", 2, 6, 9), ("b", 0, 0, 0)]


@pytest.mark.parametrize("width", [0, 3])
def test_segments_are_the_locked_path(spark, width):
    r = np.random.default_rng(7)
    pairs = {"p": (60, 70, [(10, 30), (11, 31), (59, 69)]), "q": (5, 4, []), "r": (4, 9, [(0, 0), (2, 8)])}
    left, right, locks = [], [], []
    series = {}
    for k, (n, m, anchors) in pairs.items():
        x, y = r.normal(size=(n, width) if width else n), r.normal(size=(m, width) if width else m)
        series[k] = x, y
        left += [(k, i, x[i].tolist()) for i in range(n)]
        right += [(k, j, y[j].tolist()) for j in range(m)]
        locks += [(k, *a) for a in anchors]
    kind = "array<double>" if width else "double"
    price = (lambda a, b: np.minimum(np.abs(a[:, None] - b[None]).mean(2), 1.0)) if width else (lambda a, b: np.minimum(np.abs(a[:, None] - b[None, :]), 1.0))
    frames = [spark.createDataFrame(rows, f"k string, n long, frame {kind}").repartition(3) for rows in (left, right)]
    out = L.align_pairs(*frames, ["k"], price, spark.createDataFrame(locks, "k string, i long, j long")).collect()
    for k, (_, _, anchors) in pairs.items():
        path, total = K.align_locked(*series[k], price, anchors)
        mine = [r for r in out if r["k"] == k]
        assert sorted((r["i"], r["j"]) for r in mine) == path
        # segments without a match have no row to show their total in
        assert sum({r["segment"]: r["total"] for r in mine}.values()) <= total + 1e-9


def _brute(spark, kinds=("view", "click")):
    rows = defaultdict(lambda: ([], []))
    for r in samples(spark, DIR).filter(F.col("event_type").isin(*kinds)).orderBy("user_id", "n").collect():
        rows[r["user_id"]][kinds.index(r["event_type"])].append((r["n"], r["x"]))
    return {u: v for u, v in rows.items() if all(v)}


def test_dtw_align_against_whole_tables(spark):
    totals = {r["user_id"]: r["total"] for r in QUERIES["dtw_align"](spark, DIR).collect()}
    for user, (views, clicks) in _brute(spark).items():
        x, y = (np.array([v for _, v in s]) for s in (views, clicks))
        _, exact = K.align(cost(x, y))
        if user in totals:
            assert totals[user] <= exact * 1.01 + 1e-9


def test_dtw_anchored_keeps_its_anchors(spark):
    rows = QUERIES["dtw_anchored"](spark, DIR).collect()
    path = defaultdict(set)
    for r in rows:
        path[r["user_id"]].add((r["i"], r["j"]))
    day = defaultdict(lambda: ({}, {}))
    for r in samples(spark, DIR).filter(F.col("event_type").isin("view", "click")).orderBy("user_id", "n").collect():
        day[r["user_id"]][r["event_type"] == "click"].setdefault(r["us"] // 86_400_000_000, r["n"])
    held = 0
    for user, (views, clicks) in day.items():
        top = -1
        for i, j in sorted((views[d], clicks[d]) for d in views.keys() & clicks.keys()):
            if j > top:
                assert (i, j) in path[user]
                top, held = j, held + 1
    assert held > 10
