"""Series over many tasks against the same work on the whole series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import analysis as A
from gaugeworks.operators import chunks as C
from gaugeworks.operators import kernels as K

RATE = 480
KEY = ["source_id", "channel"]


def signal(seed, n):
    r = np.random.default_rng(seed)
    t = np.arange(n) / RATE
    return 0.4 * np.sin(2 * np.pi * (20 + 30 * t / 8) * t) + 0.05 * r.normal(size=n) + 0.01


SERIES = {"long": signal(1, 5003), "short": signal(2, 61), "quiet": np.zeros(700), "one": np.array([0.5])}


def table(spark, cut=(37, 400, 11, 1)):
    rows = []
    for name, x in SERIES.items():
        at = k = 0
        while at < len(x):
            n = cut[k % len(cut)]
            rows.append((name, 0, RATE, k, at, x[at : at + n].tolist()))
            at, k = at + n, k + 1
        rows.append((name, 0, RATE, k, at, []))
    return spark.createDataFrame(rows, "source_id string, channel int, rate int, block_id long, start_frame long, samples array<double>").repartition(5)


def whole(df, name, column="samples", order="chunk"):
    rows = df.filter(F.col("source_id") == name).orderBy(order).collect()
    return np.concatenate([r[column] for r in rows]) if rows else np.zeros(0)


@pytest.mark.parametrize("size,before,after", [(64, 0, 0), (64, 16, 16), (50, 130, 201), (10_000, 5, 5)])
def test_chunks_hold_what_they_own_and_their_neighbours(spark, size, before, after):
    rows = C.chunks(table(spark), KEY, size, before, after, keep=["rate"]).collect()
    for name, x in SERIES.items():
        mine = sorted((r for r in rows if r["source_id"] == name), key=lambda r: r["chunk"])
        assert [r["chunk"] for r in mine] == list(range(-(-len(x) // size)))
        for r in mine:
            at = r["chunk"] * size
            assert r["first"] == max(0, at - before) and r["own"] == min(size, len(x) - at) and r["rate"] == RATE
            assert r["samples"] == x[r["first"] : at + size + after].tolist()


@pytest.mark.parametrize("size", [64, 100, 999, 10_000])
def test_filter_states_pass_from_chunk_to_chunk(spark, size):
    out = C.filtered(C.chunks(table(spark), KEY, size, keep=["rate"]), KEY, size)
    for name, x in SERIES.items():
        assert np.abs(whole(out, name, "filtered") - K.k_weighted(x, RATE)).max() < 1e-9


def test_transition_is_silence():
    cascade = C.k_weighting(RATE)
    state = np.array([0.3, -0.2, 0.1, 0.7])
    for n in (0, 1, 63, 64, 200):
        assert np.allclose(cascade.run(np.zeros(n), state)[1], cascade.transition(n) @ state, atol=1e-12)


@pytest.mark.parametrize("taps", [1, 2, 65, 300])
def test_convolution(spark, taps):
    kernel = np.random.default_rng(taps).normal(size=taps)
    out = C.convolved(table(spark), KEY, kernel, size=128, keep=["rate"])
    for name, x in SERIES.items():
        assert np.allclose(whole(out, name), np.convolve(x, kernel), atol=1e-9)


def loudness(x, rate):
    """Gated loudness of a whole series."""
    y, step = K.k_weighted(x, rate) ** 2, int(rate / 10 + 0.5)
    p = np.array([y[k * step : (k + 1) * step].mean() for k in range(len(y) // step)])
    p = np.convolve(p, np.ones(4) / 4, "valid") if len(p) >= 4 else np.zeros(0)
    level = -0.691 + A.db(p)
    loud = p[level >= -70]
    if not len(loud):
        return None
    gate = max(-70.0, -0.691 + float(A.db(loud.mean())) - 10)
    return -0.691 + float(A.db(p[level >= gate].mean()))


@pytest.mark.parametrize("size", [70, 1024, 100_000])
def test_facts_of_chunks_are_those_of_the_series(spark, size):
    rows = {r["source_id"]: r for r in A.facts(table(spark), size).collect()}
    assert set(rows) == set(SERIES)
    for name, x in SERIES.items():
        r = rows[name]
        assert r["frames"] == len(x) and r["peak"] == np.abs(x).max()
        assert r["rms"] == pytest.approx(np.sqrt((x * x).mean())) and r["dc"] == pytest.approx(x.mean())
        assert r["true_peak"] == pytest.approx(K.true_peak(x), abs=1e-12)
        want = loudness(x, RATE)
        assert r["integrated_lufs"] is None if want is None else r["integrated_lufs"] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("size", [32, 64, 500, 100_000])
def test_tracks_of_chunks_are_those_of_the_series(spark, size):
    options = A.Options(frame=96, hop=32)
    rows = A.frame_tracks(table(spark), options, size).toPandas()
    for name, x in SERIES.items():
        mine, want = rows[rows.source_id == name].sort_values("frame_index"), A.track(x, RATE, options)
        assert mine.frame_index.tolist() == want["frame_index"].tolist()
        for c in ("time_seconds", "rms_dbfs", "pitch_hz", "centroid_hz", "flatness", "flux", "onset_strength"):
            assert np.allclose(mine[c].to_numpy(float), want[c], equal_nan=True, atol=1e-9), c
        for c in ("band_db", "chroma"):
            assert np.allclose(np.array(mine[c].tolist()), np.array(want[c]).reshape(len(mine), -1)) if len(mine) else True


def test_empty(spark):
    none = table(spark).filter("false")
    assert C.chunks(none, KEY).count() == A.facts(none).count() == A.frame_tracks(none).count() == C.convolved(none, KEY, np.ones(3)).count() == 0
