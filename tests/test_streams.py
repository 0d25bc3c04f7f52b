"""Streams of sample blocks in several batches against the batch operators."""

import numpy as np
import pytest

from gaugeworks.operators import analysis as A
from gaugeworks.streaming import frames as S

RATE = 480
BLOCKS = "source_id string, channel int, rate int, start_frame long, samples array<double>"
OPTIONS = A.Options(frame=96, hop=32)


def series():
    r = np.random.default_rng(1)
    t = np.arange(1500) / RATE
    return {"a": 0.4 * np.sin(2 * np.pi * (20 + 30 * t / 8) * t) + 0.05 * r.normal(size=1500), "b": r.normal(size=333) * 0.1, "c": np.zeros(40)}


def rows_of(name, x, size=70):
    return [(name, 0, RATE, k, x[k : k + size].tolist()) for k in range(0, len(x), size)]


def run(stream, out, state):
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


@pytest.fixture()
def batches(spark, tmp_path):
    """Files in an order in which some blocks come before their turn, and some twice."""
    every = [b for name, x in series().items() for b in rows_of(name, x)]
    r = np.random.default_rng(2)
    order = r.permutation(len(every))
    parts = [[every[k] for k in order[i::5]] for i in range(5)]
    parts[3] += parts[0][:2]

    def write(k):
        spark.createDataFrame(parts[k], BLOCKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    return tmp_path, write, len(parts), spark.createDataFrame(every, BLOCKS)


def test_stream_in_batches_with_a_restart(spark, batches):
    folder, write, n, every = batches
    read = lambda: spark.readStream.schema(BLOCKS).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    # each round is a new query on the old checkpoint: a restart
    for upto in ((0, 1), (2,), (3, 4)):
        for k in upto:
            write(k)
        run(S.frame_stream(read(), OPTIONS), str(folder / "track"), str(folder / "s1"))
        run(S.part_stream(read()), str(folder / "parts"), str(folder / "s2"))
    got, want = spark.read.parquet(str(folder / "track")).toPandas(), A.frame_tracks(every, OPTIONS, 256).toPandas()
    key = ["source_id", "frame_index"]
    got, want = got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True)
    assert got[key].equals(want[key])
    for c in ("time_seconds", "rms_dbfs", "pitch_hz", "pitch_confidence", "centroid_hz", "spread_hz", "rolloff_hz", "flatness", "flux", "onset_strength"):
        assert np.allclose(got[c].to_numpy(float), want[c].to_numpy(float), equal_nan=True, atol=1e-9), c
    parts = spark.read.parquet(str(folder / "parts"))
    assert parts.groupBy("source_id").count().filter("source_id = 'a'").first()["count"] > 1
    facts = {r["source_id"]: r for r in S.facts_of_parts(parts).collect()}
    for r in A.facts(every, 300).collect():
        mine = facts[r["source_id"]]
        for c in ("frames", "peak", "rms", "dc", "crest_db", "integrated_lufs"):
            assert mine[c] == r[c] or mine[c] == pytest.approx(r[c], abs=1e-9), c


def test_lost_blocks_are_named(spark, tmp_path):
    spark.createDataFrame([("a", 0, RATE, 200 * k, [0.1] * 100) for k in range(4)], BLOCKS).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(BLOCKS).parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="has not come"):
        run(S.part_stream(stream, waiting=100), str(tmp_path / "out"), str(tmp_path / "state"))


def test_an_empty_stream(spark, tmp_path):
    spark.createDataFrame([], BLOCKS).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(BLOCKS).parquet(str(tmp_path / "in"))
    run(S.part_stream(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.schema(S.PARTS).parquet(str(tmp_path / "out")).count() == 0
