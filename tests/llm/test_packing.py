"""The genetic algorithm against exhaustive packing, lower bounds and best fit alone."""

import random
from collections import Counter

import pytest

from gaugeworks.llm import packing


def fewest(items, capacity):
    """The least number of bins, by trying every bin for every piece."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= items[k]:
                rest = list(rooms)
                rest.remove(r)
                place(k + 1, [*rest, r - items[k]])
        place(k + 1, [*rooms, capacity - items[k]])

    place(0, [])
    return best[0]


def valid(plan, hist, capacity):
    used = Counter()
    for bin_, n in plan.items():
        assert bin_ and sum(bin_) <= capacity and n > 0
        for s in bin_:
            used[s] += n
    return used == Counter({s: n for s, n in hist.items() if n})


@pytest.mark.parametrize("seed", range(12))
def test_small_histograms_against_exhaustive_packing(seed):
    r = random.Random(seed)
    items = [r.randint(2, 18) for _ in range(r.randint(5, 13))]
    hist = dict(Counter(items))
    plan = packing.evolve(hist, [], seed, 20)
    best = fewest(items, 20)
    assert valid(plan, hist, 20) and sum(plan.values()) == best
    assert packing.least_bins(hist, 20) <= best


@pytest.mark.parametrize("times", [1, 7])
def test_better_than_best_fit_where_that_is_known_to_fail(times):
    """Best fit, longest first, pairs 5 with 3 and leaves room that 4s and 2s can't fill."""
    hist = {5: 1 * times, 4: 3 * times, 3: 2 * times, 2: 1 * times}  # 5+3, 4+4, 4+3.. of 10: 25 in 3 bins
    hist = {s * 10: n for s, n in hist.items()}
    hist |= {51: 6 * times, 27: 6 * times, 26: 6 * times, 23: 12 * times}
    alone, plan = packing.best_fit(hist, {}, 100), packing.evolve(hist, [], 1, 100)
    assert valid(plan, hist, 100) and sum(plan.values()) < sum(alone.values())


def test_documents_take_fewer_bins_than_best_fit_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hist = {r["length"]: r["count"] for r in packing.pieces(docs).groupBy("length").count().collect()}
    alone, plan = packing.best_fit(hist, {}, 1024), packing.plan_on_islands(spark, hist)
    assert valid(plan, hist, 1024) and packing.least_bins(hist, 1024) <= sum(plan.values()) < sum(alone.values())


@pytest.mark.parametrize("seed", range(20))
def test_filling_reaches_what_any_choice_does(seed):
    r = random.Random(seed)
    left = {r.randint(1, 30): r.randint(0, 3) for _ in range(6)}
    room = r.randint(0, 60)
    pieces = [s for s, n in left.items() for _ in range(n)]
    sums = {0}
    for s in pieces:
        sums |= {a + s for a in sums if a + s <= room}
    found = packing.filling(left, room)
    assert sum(found) == max(sums) and not Counter(found) - Counter(pieces)


def test_lengths_that_nothing_goes_with():
    for hist, want in (({1024: 9}, 9), ({1023: 4}, 4), ({1: 5}, 1), ({512: 7}, 4), ({}, 0)):
        assert sum(packing.evolve(hist, [], 0).values() if hist else []) == want == packing.least_bins(hist, 1024)
