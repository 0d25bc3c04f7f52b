"""Modes and their pairs against plain loops."""

import math

import numpy as np
import pytest

from gaugeworks.operators import modes as M

STEP = 25.0


def plain(power, step):
    n, out = len(power), []
    for k in range(1, n - 1):
        if not (power[k] > power[k - 1] and power[k] >= power[k + 1]) or not 40 <= k * step <= 0.49 * 2 * (n - 1) * step:
            continue
        near = [power[j] for j in range(max(k - 16, 1), min(k + 16, n - 1) + 1) if abs(j - k) > 2]
        if not near or not sum(near) > 0 or 10 * math.log10(power[k] / (sum(near) / len(near))) < 3:
            continue
        left = right = k
        while left > 1 and power[left] > power[k] / 2:
            left -= 1
        while right + 1 < n and power[right] > power[k] / 2:
            right += 1
        width = max((right - left) * step, step)
        out.append((k * step, width, k * step / width, 10 * math.log10(power[k] / (sum(near) / len(near))), math.log(1000) / (math.pi * width)))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_modes_against_loops(seed):
    r = np.random.default_rng(seed)
    power = r.random(int(r.integers(3, 300))) ** 3
    if seed == 7:
        power = np.round(power, 1)  # ties and zeros
    want = plain(power, STEP)
    got = M.modes_of(power, STEP)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose(np.array(got).reshape(-1, 5), np.array(want).reshape(-1, 5))
    by_power = sorted(got, key=lambda g: (-power[round(g[0] / STEP)], g[0]))[:4]
    assert M.modes_of(power, STEP, 4) == sorted(by_power)


def test_pairs_keep_the_order():
    modes = lambda *hz: [(h,) for h in hz]
    assert M.pair(modes(100, 500, 1000), modes(150, 480, 2000)) == [(0, 0), (1, 1)]
    assert M.pair(modes(1000, 1100), modes(1149, 1150)) == [(0, 0), (1, 1)]
    assert M.pair(modes(100, 900), modes(300, 850, 880)) == [(1, 1)]
    assert M.pair([], modes(1)) == [] == M.pair(modes(1), [])


def test_cases_without_a_side_or_a_pair(spark):
    def comb(*bins):
        power = [1e-6] * 200
        for k in bins:
            power[k] = 1.0
        return power

    rows = [("ok", "reference", comb(20, 60), STEP), ("ok", "model", comb(21, 150), STEP), ("far", "reference", comb(20), STEP), ("far", "model", comb(120), STEP), ("one", "model", comb(30), STEP), ("null", "reference", None, STEP), ("null", "model", [], STEP)]
    out = M.mode_checks(spark.createDataFrame(rows, "case string, side string, power array<double>, bin_hz double")).collect()
    value = {(r["case"], r["kind"], r["index"]): r for r in out}
    first = value["ok", "body_mode_frequency_hz", 0]
    assert (first["reference_value"], first["model_value"], first["delta"]) == (500.0, 525.0, 25.0)
    assert value["ok", "body_mode_distance_cents", 0]["delta"] == pytest.approx(1200 * math.log2(525 / 500), abs=1e-5)
    assert value["ok", "body_mode_density_per_khz", 0]["model_value"] == pytest.approx(2 / (199 * STEP / 1000), abs=1e-6)
    for case in ("far", "one", "null"):
        assert value[case, "body_mode_q", 0]["availability"] == "UNAVAILABLE" and value[case, "body_mode_distance_cents", 0]["delta"] is None
    assert value["far", "body_mode_density_per_khz", 0]["availability"] == "AVAILABLE"
    assert M.mode_checks(spark.createDataFrame([], "case string, side string, power array<double>, bin_hz double")).count() == 0
