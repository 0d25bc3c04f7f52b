"""Closed-form checks of the numeric kernels."""

import math

import numpy as np
import pytest

from gaugeworks.operators import experiments as X
from gaugeworks.operators import kernels as K


def sine(hz, rate, n, a=1.0):
    return a * np.sin(2 * np.pi * hz * np.arange(n) / rate)


def test_power_of_a_sine_is_half_its_square():
    p = K.power_spectrum(sine(10, 1024, 1024, 0.5)[None, :])[0]
    assert p.argmax() == 10
    assert p[9:12].sum() == pytest.approx(0.5**2 / 2 * 1.5, rel=1e-6)


def test_pitch_of_a_sine_and_of_silence():
    hz, confidence = K.pitch(sine(220, 8000, 2048), 8000)
    assert hz == pytest.approx(220, rel=5e-3) and confidence > 0.8
    assert math.isnan(K.pitch(np.zeros(512), 8000)[0])


def test_true_peak_finds_what_lies_between_samples():
    x = np.sin(2 * np.pi * (np.arange(400) + 0.5) / 4)
    assert np.abs(x).max() == pytest.approx(math.sqrt(0.5))
    assert K.true_peak(x) == pytest.approx(1.0, abs=0.03)
    assert K.true_peak(np.zeros(0)) == 0.0


def test_k_weighting_lifts_highs_and_drops_lows():
    rms = lambda v: np.sqrt((v[4000:] ** 2).mean())
    gain = lambda hz: 20 * math.log10(rms(K.k_weighted(sine(hz, 48000, 24000), 48000)) / rms(sine(hz, 48000, 24000)))
    assert gain(10000) == pytest.approx(4.0, abs=0.1)
    assert gain(1000) == pytest.approx(0.44, abs=0.1)
    assert gain(20) < -10


def test_vibrato_rate_and_depth():
    rate, depth, rest = K.vibrato(sine(6, 100, 200, 30.0), 0.01)
    assert rate == pytest.approx(6, rel=0.05) and depth == pytest.approx(30, rel=0.05) and rest < 0.05
    assert math.isnan(K.vibrato(np.zeros(50), 0.01)[0])


def test_decay_of_an_exponential():
    rate = 1000.0
    ir = np.exp(-np.arange(3000) / rate * math.log(1000) / 0.8)
    seconds, fit = K.decay_seconds(ir, rate)
    assert seconds == pytest.approx(0.8, rel=0.02) and fit > 0.99


def test_alignment_follows_the_diagonal_and_skips():
    a = np.array([0, 1, 2, 3, 4.0])
    path, total = K.align(np.minimum(np.abs(a[:, None] - a[None, :]), 1))
    assert path == [(k, k) for k in range(5)] and total == 0
    b = np.array([0, 1, 9, 2, 3, 4.0])
    path, _ = K.align(np.minimum(np.abs(a[:, None] - b[None, :]), 1))
    assert (2, 3) in path and (4, 5) in path
    with pytest.raises(ValueError):
        K.align(np.zeros((2, 9)), band=0)


def test_anchors_keep_ends_landmarks_and_a_second():
    path = [(k, k) for k in range(10)]
    onset = np.zeros(10)
    onset[3] = 1.0
    assert K.anchors(path, onset, 0.25) == [(0, 0), (3, 3), (7, 7), (9, 9)]


def test_resample_and_harmonics():
    assert K.resample(np.array([0.0, 1.0]), 3).tolist() == [0, 0.5, 1]
    p = np.full(200, 1e-9)
    p[[20, 40, 60]] = 1.0
    found = K.harmonics(p, 100.0, 5.0, partials=3)
    assert [round(f[1]) for f in found] == [100, 200, 300]


def test_splitmix_units_match_the_sequential_generator():
    state, want = 42, []
    for _ in range(5):
        state = (state + X.GAMMA) % 2**64
        z = state
        z = (z ^ (z >> 30)) * X.MIX_A % 2**64
        z = (z ^ (z >> 27)) * X.MIX_B % 2**64
        want.append(((z ^ (z >> 31)) >> 11) * 2.0**-53)
    assert X.splitmix_units(42, np.arange(1, 6)).tolist() == want


def test_combined_onset_is_bounded():
    assert K.combined_onset([9], [99], [1], [9]) == 1.0
    assert K.combined_onset([0], [-5], [0], [0]) == 0.0


def test_phase_onset_of_a_steady_sine_is_small():
    fr = K.frames(sine(8, 256, 2048), 256, 64)
    assert K.phase_onset(fr)[2:].max() < 0.2


def test_block_filter_equals_the_recurrence():
    rng = np.random.default_rng(4)
    for n in (0, 1, 63, 64, 65, 1000):
        x = rng.normal(size=n)
        for b, a in (K.high_shelf(48000.0), K.high_pass(48000.0), K.high_shelf(8000.0, 3000.0)):
            y, p, q, u, v = [], 0.0, 0.0, 0.0, 0.0
            for k in x:
                y.append((b[0] * k + b[1] * p + b[2] * q - a[1] * u - a[2] * v) / a[0])
                p, q, u, v = k, p, y[-1], u
            assert np.allclose(K.biquad(x, b, a)[0], y, atol=1e-9)


def test_alignment_against_every_path():
    """The cheapest of all monotone paths, found by trying each."""
    rng = np.random.default_rng(5)

    def cheapest(cost, i, j, kind, run, cheap):
        if (i, j) == cost.shape:
            return 0.0
        n, m = cost.shape
        found = []
        if i < n and j < m:
            found.append(cost[i, j] + cheapest(cost, i + 1, j + 1, 0, 0, cheap))
            if j + 1 < m:
                found.append((cost[i, j] + cost[i, j + 1]) / 2 + 0.05 + cheapest(cost, i + 1, j + 2, 0, 0, cheap))
            if i + 1 < n:
                found.append((cost[i, j] + cost[i + 1, j]) / 2 + 0.05 + cheapest(cost, i + 2, j + 1, 0, 0, cheap))
        for which, a, b, price in ((1, i + 1, j, 0.45), (2, i, j + 1, 0.45)):
            if a <= n and b <= m:
                share = 0.1 if kind == which and run < cheap else 1.0
                found.append(price * share + cheapest(cost, a, b, which, run + 1 if kind == which else 1, cheap))
        return min(found)

    for _ in range(40):
        n, m = rng.integers(1, 6, 2)
        cost = rng.random((n, m))
        path, total = K.align(cost)
        assert abs(total - cheapest(cost, 0, 0, 0, 0, 8)) < 1e-9
        assert all(a < c and b < d for (a, b), (c, d) in zip(path, path[1:]))
