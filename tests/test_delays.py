"""Delays by chunks against whole series."""

import numpy as np
import pytest

from gaugeworks.operators import delays as D


def blocks(spark, series, size):
    rows = [(k, at, x[at : at + size].tolist()) for k, x in series.items() for at in range(0, len(x), size)]
    return spark.createDataFrame(rows, "k string, start_frame long, samples array<double>")


def plain(x, y, lags, anchors):
    count, best = min(anchors, len(x)), None
    at = np.arange(count) * len(x) // count
    for lag in range(-lags, lags + 1):
        use = at[(at + lag >= 0) & (at + lag < len(y))]
        if len(use) < 64 or x[use].std() == 0 or y[use + lag].std() == 0:
            continue
        c = float(np.corrcoef(x[use], y[use + lag])[0, 1])
        rank = (round(abs(c), 12), -abs(lag), -lag)
        if best is None or rank > best[0]:
            best = rank, lag, c, len(use)
    return best and best[1:]


@pytest.mark.parametrize("size", [97, 512, 10_000])
def test_delays_against_whole_series(spark, size):
    r = np.random.default_rng(5)
    left = {"late": r.normal(size=1500), "early": r.normal(size=900), "turned": r.normal(size=700), "short": r.normal(size=60), "flat": np.ones(400), "cut": r.normal(size=800)}
    right = {k: np.concatenate([np.zeros(7), x])[: len(x)] for k, x in left.items()}
    right["early"], right["turned"] = np.concatenate([left["early"][12:], np.zeros(12)]), -left["turned"]
    right["cut"] = np.concatenate([np.zeros(3), left["cut"]])[:500]
    got = {r["k"]: (r["lag"], r["correlation"], r["pairs"]) for r in D.delays(blocks(spark, left, 130), blocks(spark, right, 77), ["k"], 25, 400, size).collect()}
    want = {k: plain(left[k], right[k], 25, 400) for k in left}
    assert set(got) == {k for k, w in want.items() if w} and "short" not in got and "flat" not in got
    for k, (lag, c, pairs) in got.items():
        assert (lag, pairs) == (want[k][0], want[k][2]) and c == pytest.approx(want[k][1], abs=1e-9)
    assert got["late"][0] == 7 and got["early"][0] == -12 and got["turned"][0] == 0 and got["turned"][1] == pytest.approx(-1)
