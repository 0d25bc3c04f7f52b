"""The audio stages on synthetic recordings with known answers."""

import math

import numpy as np
import pytest

from gaugeworks.operators import analysis as A
from gaugeworks.sources import wave

RATE = 16000


def tone(midi, seconds, a=0.5):
    t = np.arange(int(RATE * seconds)) / RATE
    fade = np.minimum(1, np.minimum(t / 0.02, (seconds - t) / 0.05).clip(0))
    return a * fade * np.sin(2 * np.pi * 440 * 2 ** ((midi - 69) / 12) * t)


@pytest.fixture(scope="module")
def recording(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("wav")
    x = np.concatenate([np.zeros(RATE // 10), tone(60, 0.6), np.zeros(RATE // 5), tone(67, 0.6), np.zeros(RATE // 2)])
    (folder / "a.wav").write_bytes(wave.encode_pcm16(x, RATE))
    blocks = wave.read_wave(spark, str(folder), block_frames=5000)
    return x, blocks, A.frame_tracks(blocks, A.Options(frame=1024, hop=256)).cache()


def test_facts(recording):
    x, blocks, _ = recording
    row = A.facts(blocks).first()
    assert row["frames"] == len(x) and row["peak"] == pytest.approx(0.5, abs=1e-3)
    assert row["rms"] == pytest.approx(math.sqrt((x * x).mean()), abs=1e-4)
    assert row["true_peak"] >= row["peak"] and -20 < row["integrated_lufs"] < -5


def test_frame_track(recording):
    _, _, track = recording
    rows = track.orderBy("frame_index").toPandas()
    inside = rows[(rows.time_seconds > 0.2) & (rows.time_seconds < 0.6)]
    assert np.allclose(inside.pitch_hz, 261.63, rtol=0.01)
    assert np.stack(inside.chroma).argmax(1).tolist() == [0] * len(inside)
    assert inside.rms_dbfs.median() == pytest.approx(20 * math.log10(0.5 / math.sqrt(2)), abs=0.2)
    assert rows.rms_dbfs.iloc[0] == -300


def test_alignment_and_segmentation(spark, recording):
    _, blocks, track = recording
    source = blocks.first()["source_id"]
    notes = spark.createDataFrame([(source, "n1", 0.0, 0.6, 60), (source, "n2", 0.8, 1.4, 67)], "source_id string, event_id string, start double, end double, midi_note int")
    aligned = A.align_scores(notes, track)
    at = {r["event_id"]: r["target_seconds"] for r in aligned.collect()}
    assert at["n1"] == pytest.approx(0.1, abs=0.11) and at["n2"] == pytest.approx(0.9, abs=0.11)
    items = {(r["event_id"], r["kind"]): r for r in A.segment(aligned, notes, track).collect()}
    assert items["n1", "note"]["start_seconds"] == pytest.approx(0.1, abs=0.08)
    assert items["n1", "body"]["end_seconds"] == pytest.approx(0.7, abs=0.2)
    assert all(r["end_seconds"] >= r["start_seconds"] for r in items.values())
