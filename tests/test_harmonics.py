"""Harmonic tracking of spectra against a plain frame-by-frame reading, and of known sounds."""

import math

import numpy as np
import pytest

from gaugeworks.functions.expr import BAND_EDGES
from gaugeworks.operators import harmonics as H

STEP = 20.0


def plain(power, step, expected):
    """(pitch, harmonic, residual, fault, partials, bands, residual bands) by loops."""
    n, nyquist = len(power), (len(power) - 1) * step
    db = lambda p: 10 * math.log10(p) if p > 1e-30 else -300.0
    band = lambda hz: sum(hz >= edge for edge in BAND_EDGES)
    total, bands = float(sum(power[1:])), [0.0] * (len(BAND_EDGES) + 1)
    for k in range(1, n):
        bands[band(k * step)] += power[k]

    def peak(hz):
        at = hz / step
        wide, middle = max(2, math.ceil(at * (2 ** (35 / 1200) - 1))), math.floor(at + 0.5)
        start, end = (middle - wide if middle > wide else 1), min(middle + wide, n - 2)
        if not 1 <= at < n - 1 or start > end:
            return None
        best = max(range(start, end + 1), key=lambda k: (power[k], -k))
        l, m, r = (math.log(max(power[best + k], 1e-30)) for k in (-1, 0, 1))
        off = 0.5 * (l - r) / (l - 2 * m + r) if abs(l - 2 * m + r) > 2**-52 else 0.0
        near = [power[k] for k in range(start - 3 if start > 3 else 1, min(end + 3, n - 1) + 1) if abs(k - best) > 1]
        return (best + (off if -1 < off < 1 else 0.0)) * step, power[best], power[best] / max(sum(near) / len(near), 1e-30) if near else 0.0

    def score(hz):
        out = 0.0
        for k in range(1, 9):
            if hz * k >= nyquist * 0.98:
                break
            low = math.floor(hz * k / step)
            out += (power[low] * (1 - (hz * k / step - low)) + power[low + 1] * (hz * k / step - low)) / math.sqrt(k)
        return out

    nothing = None, None, max(total, 1e-30), False, None, bands, bands
    if not expected or not 0 < expected < nyquist * 0.95 or expected / step < 3 or db(total) < -100:
        return nothing
    found = [(k, peak(expected * k)) for k in range(1, 13) if expected * k < nyquist * 0.98]
    found = [(k, p) for k, p in found if p and p[2] >= 2.5 and db(p[1]) >= -100]
    weight = sum(p[1] / math.sqrt(k) for k, p in found)
    if not weight > 0:
        return nothing
    pitch = sum(p[1] / math.sqrt(k) * p[0] / k for k, p in found) / weight
    if abs(1200 * math.log2(pitch / expected)) > 220:
        return nothing
    partials, left = [], list(bands)
    for k in range(1, 13):
        if pitch * k >= nyquist * 0.98:
            break
        p = peak(pitch * k)
        if not p:
            continue
        middle = math.floor(p[0] / step + 0.5)
        whole = sum(power[max(1, middle - 1) : min(middle + 1, n - 1) + 1])
        if p[2] >= 2.5 and db(whole) >= -100:
            partials.append((k, p[0], 1200 * math.log2(p[0] / (pitch * k)), whole))
            left[band(p[0])] -= whole
    left = [v if v > 1e-9 * w else 0.0 for v, w in zip(left, bands)]
    harmonic = min(sum(p[3] for p in partials), total)
    if not harmonic > 0:
        return nothing
    half, double = score(expected / 2) if expected / 2 >= 20 else 0, score(expected * 2) if expected * 2 < nyquist * 0.95 else 0
    own = score(expected)
    return pitch, harmonic, max(total - harmonic, 1e-30), half > 1.35 * own or double > 1.35 * own, partials, bands, left


def tone(hz, orders, n=256, floor=1e-6, seed=0):
    r = np.random.default_rng(seed)
    power = floor * r.random(n)
    for k, a in orders.items():
        at = hz * k / STEP
        for b in range(n):
            power[b] += a * math.exp(-((b - at) ** 2) * 2)
    return power


def frames(spark, rows):
    return spark.createDataFrame([(k, [float(v) for v in p], STEP, e) for k, (p, e) in enumerate(rows)], "k int, power array<double>, bin_hz double, expected_hz double")


def test_against_loops(spark):
    r = np.random.default_rng(3)
    rows = [(tone(e * f, {k: 1 / k for k in range(1, 9)}, seed=i), e) for i, (e, f) in enumerate((e, f) for e in (61.0, 200.0, 433.3, 900.0) for f in (1.0, 1.02, 0.9, 1.2))]
    rows += [(r.random(256) ** 4, float(e)) for e in r.uniform(60, 3000, 60)]
    rows += [(np.zeros(256), 200.0), (tone(200, {1: 1}), None), (tone(200, {1: 1}), -1.0), (tone(200, {1: 1}), 30.0), (tone(200, {1: 1}), 6000.0), (np.ones(256), 300.0), (np.ones(4), 60.0)]
    got = {r["k"]: r for r in H.track(frames(spark, rows)).collect()}
    for k, (power, expected) in enumerate(rows):
        pitch, harmonic, residual, fault, partials, bands, left = plain(power, STEP, expected)
        g = got[k]
        assert (g["pitch_hz"], g["harmonic_power"]) == (None, None) if pitch is None else g["pitch_hz"] == pytest.approx(pitch) and g["harmonic_power"] == pytest.approx(harmonic), k
        assert g["residual_power"] == pytest.approx(residual, abs=1e-12) and g["octave_fault"] == fault
        assert g["band_power"] == pytest.approx(bands) and g["residual_band"] == pytest.approx(left, abs=1e-12)
        assert partials is None and g["partials"] is None or [tuple(p) for p in g["partials"]] == [pytest.approx(p, abs=1e-9) for p in partials]
        assert g["valid"] == (pitch is not None and harmonic / max(sum(power[1:]), 1e-30) >= 0.3)


def test_known_sounds(spark):
    rows = [(tone(400, {1: 1, 2: 0.5, 3: 0.3}), 400.0), (tone(200, {1: 1, 2: 0.9, 3: 0.8, 4: 0.5}), 400.0), (tone(800, {1: 1, 2: 0.5}), 400.0), (tone(400, {1: 1, 2: 0.5}, floor=0.05), 400.0)]
    pure, under, over, noisy = H.track(frames(spark, rows)).orderBy("k").collect()
    assert not pure["octave_fault"] and pure["confidence"] > 0.9 and [p["partial"] for p in pure["partials"]] == [1, 2, 3] and abs(pure["pitch_hz"] - 400) < 2
    assert under["octave_fault"] and over["octave_fault"]
    assert noisy["hnr_db"] < pure["hnr_db"] and noisy["residual_power"] > pure["residual_power"]
