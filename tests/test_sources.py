"""WAVE, CSV, JSON and binary inputs; saved sets."""

import json
import struct

import numpy as np
import pytest

from gaugeworks.sources import artifacts, tables, wave
from gaugeworks.streaming import blocks


def header(tag, channels, rate, bits, data, extra=b"", riff=b"RIFF"):
    align = channels * bits // 8
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, tag, channels, rate, rate * align, align, bits)
    return riff + struct.pack("<I", 0) + b"WAVE" + extra + fmt + b"data" + struct.pack("<I", len(data)) + data


@pytest.mark.parametrize(
    ("tag", "bits", "data", "want"),
    [
        (1, 8, bytes([0, 128, 255]), [-1, 0, 127 / 128]),
        (1, 16, struct.pack("<3h", -32768, 0, 16384), [-1, 0, 0.5]),
        (1, 24, b"\x00\x00\x80\x00\x00\x00\x00\x00\x40", [-1, 0, 0.5]),
        (1, 32, struct.pack("<2i", -(2**31), 2**30), [-1, 0.5]),
        (3, 32, struct.pack("<2f", 0.25, -2.0), [0.25, -2]),
        (3, 64, struct.pack("<1d", 0.125), [0.125]),
    ],
)
def test_every_encoding(tag, bits, data, want):
    fmt, body = wave.parse(header(tag, 1, 8000, bits, data))
    assert wave.decode(body, fmt["tag"], fmt["bits"])[0].tolist() == want


def test_rf64_and_odd_chunks():
    data = struct.pack("<2h", 1, 2)
    ds64 = b"ds64" + struct.pack("<IQQQI", 28, 0, len(data), 2, 0)
    whole = bytearray(header(1, 1, 8000, 16, data, ds64, b"RF64"))
    whole[-len(data) - 4 : -len(data)] = b"\xff\xff\xff\xff"
    assert wave.parse(bytes(whole))[1] == data
    assert wave.parse(header(1, 1, 8000, 16, data, b"junk" + struct.pack("<I", 3) + b"abc\0"))[1] == data


@pytest.mark.parametrize("bad", [b"", b"RIFX" + b"\0" * 40, header(2, 1, 8000, 4, b"1234"), header(1, 1, 8000, 16, b"1234")[:-2], header(1, 1, 8000, 16, b"123")])
def test_malformed_files_are_refused(bad):
    with pytest.raises(wave.WaveError):
        wave.parse(bad)


def test_wave_blocks_through_spark(spark, tmp_path):
    x = np.stack([np.linspace(-0.5, 0.5, 100), np.zeros(100)], 1)
    (tmp_path / "a.wav").write_bytes(wave.encode_pcm16(x, 8000))
    rows = wave.read_wave(spark, str(tmp_path), block_frames=64).orderBy("channel", "block_id").collect()
    assert [(r["channel"], r["block_id"], r["start_frame"], len(r["samples"])) for r in rows] == [(0, 0, 0, 64), (0, 1, 64, 36), (1, 0, 0, 64), (1, 1, 64, 36)]
    assert np.allclose(rows[0]["samples"] + rows[1]["samples"], x[:, 0], atol=1 / 32768)
    mixed = wave.read_wave(spark, str(tmp_path), channels="mix").first()
    assert np.allclose(mixed["samples"], x.mean(1), atol=1 / 32768)


def test_matched_pair_has_equal_loudness():
    a, b = wave.matched_pair(np.full(10, 0.5), np.full(10, 0.1), 8000)
    assert a[44:] == b[44:]


SCORE_HEAD = "event_id,kind,start_beats,duration_beats,midi_note,velocity,voice,tie,dynamic,mark,score_position,tempo_bpm\n"


def test_score_is_checked(spark, tmp_path):
    def read(body):
        (tmp_path / "s.csv").write_text(SCORE_HEAD + body)
        return tables.read_score(spark, str(tmp_path / "s.csv"))

    tempo = "t,tempo,0,0,,,,,,,,90\n"
    assert read(tempo + "a,note,0,1,60,80,v,start,,,,\nb,note,1,1,60,80,v,stop,,,,\n").count() == 3
    for body in ("a,note,0,1,60,80,v,,,,,\n", tempo + tempo, tempo + "a,hum,0,1,60,80,v,,,,,\n", tempo + "a,note,0,1,60,80,v,start,,,,\n", tempo + "a,note,0,1,60,80,v,start,,,,\nb,note,2,1,60,80,v,stop,,,,\n"):
        with pytest.raises(tables.InputError):
            read(body)


def test_labels_override(spark, tmp_path):
    (tmp_path / "l.csv").write_text("event_id,pitch,register,dynamic,articulation,part,physical_element,controller,technique,score_section,transition,gesture\na,,,f,,,reed,,,,,\n")
    events = spark.createDataFrame([("a", "p", 1.0), ("b", "mf", 2.0)], "event_id string, dynamic string, start double")
    rows = {r["event_id"]: r for r in tables.with_labels(events, tables.read_labels(spark, str(tmp_path / "l.csv"))).collect()}
    assert rows["a"]["dynamic"] == "f" and rows["a"]["physical_element"] == "reed" and rows["b"]["dynamic"] == "mf"


def test_probes(spark, tmp_path):
    (tmp_path / "p.csv").write_text("index,value\n0,1.5\n1,2.5\n")
    assert tables.read_probe(spark, str(tmp_path / "p.csv")).count() == 2
    (tmp_path / "q.csv").write_text("index,value\n0,1.5\n2,2.5\n")
    with pytest.raises(tables.InputError):
        tables.read_probe(spark, str(tmp_path / "q.csv"))
    (tmp_path / "b.bin").write_bytes(struct.pack("<2d", 1.0, -2.0))
    assert [r["value"] for r in tables.read_binary_probe(spark, str(tmp_path / "b.bin")).orderBy("index").collect()] == [1.0, -2.0]


def test_manifest_entries(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"schema": "x", "plan": {"kind": "grid", "seed": 7}, "parameters": [{"id": "a", "levels": [1, 2]}, {"id": "b", "levels": []}]}')
    rows = tables.entries(tables.read_manifest(spark, str(tmp_path / "m.json"), tables.EXPERIMENT_MANIFEST), "parameters").collect()
    assert [(r["id"], r["levels"]) for r in rows] == [("a", [1.0, 2.0]), ("b", [])]


def test_saved_sets_round_trip(spark, tmp_path):
    gaps = spark.createDataFrame([(1, 0.5)], "id long, gap_score double")
    artifacts.save("comparison", {"gap": gaps}, str(tmp_path))
    with pytest.raises(Exception, match="exists"):
        artifacts.save("comparison", {"gap": gaps}, str(tmp_path))
    artifacts.save("comparison", {"gap": gaps}, str(tmp_path), replace=True)
    assert artifacts.load(spark, "comparison", str(tmp_path), ("gap",))["gap"].collect() == gaps.collect()
    with pytest.raises(ValueError):
        artifacts.save("comparison", {"nothing": gaps}, str(tmp_path))


def test_exports_and_provenance(spark, tmp_path):
    artifacts.export_spectrogram(spark.createDataFrame([(0.0, [1.0, 2.0])], "time_seconds double, power array<double>"), str(tmp_path / "g"), 8000.0, 4)
    assert "0.0,2000.0,2.0" in "".join(p.read_text() for p in (tmp_path / "g").glob("part*"))
    (tmp_path / "x").mkdir()
    (tmp_path / "x/f").write_bytes(b"abc")
    before = artifacts.provenance(spark, str(tmp_path / "x"))
    assert before.first()["sha256"].startswith("ba7816bf")
    assert artifacts.changed(before, before).count() == 0
    page = artifacts.report_html("<t>", {"gaps": spark.createDataFrame([("a&b", None)], "k string, v double")})
    assert "a&amp;b" in page and "&lt;t&gt;" in page


def test_reports_say_how_many_rows_there_are(spark):
    rows = spark.createDataFrame([("b", 2), ("a", 1), ("c", 3)], "k string, rank long")
    said = json.loads(artifacts.report_json("t", {"gaps": rows}, most=2))
    assert said["total_rows"] == {"gaps": 3} and [r["k"] for r in said["gaps"]] == ["a", "b"]
    assert "2 of 3 rows" in artifacts.report_html("t", {"gaps": rows}, most=2)


STEM = {"id": "a", "side": "model", "role": "final", "rate_hz": 48000, "channels": 1}
SIZE = {"id": "p", "minimum": 0, "maximum": 1, "baseline": 0, "levels": [0, 1]}
PLAN = {"plan": {"kind": "grid", "replicates": 1}}


@pytest.mark.parametrize(
    ("kind", "schema", "manifest", "rule"),
    [
        ("run", tables.RUN_MANIFEST, {"clock_rate_hz": 48000, "stems": [STEM], "probes": [{"id": "p"}], "links": [{"stem": "a", "probe": "p", "feature": "rms"}]}, None),
        ("run", tables.RUN_MANIFEST, {"clock_rate_hz": 0}, "clock rate"),
        ("run", tables.RUN_MANIFEST, {"clock_rate_hz": 1, "stems": [STEM], "probes": [{"id": "a"}]}, "ids must be unique"),
        ("run", tables.RUN_MANIFEST, {"clock_rate_hz": 1, "stems": [STEM, STEM | {"id": "b"}]}, "one model stem"),
        ("run", tables.RUN_MANIFEST, {"clock_rate_hz": 1, "stems": [STEM | {"side": None}]}, "a side"),
        ("run", tables.RUN_MANIFEST, {"clock_rate_hz": 1, "stems": [STEM], "links": [{"stem": "a", "probe": "p"}]}, "a link"),
        ("experiment", tables.EXPERIMENT_MANIFEST, PLAN | {"parameters": [SIZE], "cases": [{"id": "c", "split": "fit", "weight": 1}]}, None),
        ("experiment", tables.EXPERIMENT_MANIFEST, PLAN | {"parameters": [SIZE, SIZE]}, "parameter ids"),
        ("experiment", tables.EXPERIMENT_MANIFEST, PLAN | {"parameters": [SIZE | {"baseline": 2}]}, "a baseline"),
        ("experiment", tables.EXPERIMENT_MANIFEST, PLAN | {"parameters": [SIZE | {"levels": [0.5]}]}, "levels hold"),
        ("experiment", tables.EXPERIMENT_MANIFEST, PLAN | {"cases": [{"id": "c", "split": "fit", "weight": 0}]}, "weights"),
        ("experiment", tables.EXPERIMENT_MANIFEST, {"plan": {"kind": "grid"}}, "replicates"),
        ("experiment", tables.EXPERIMENT_MANIFEST, {"plan": {"kind": "sweep", "replicates": 1}}, "a plan"),
        ("gap_report", tables.GAP_MANIFEST, {"sources": [{"id": "s"}], "case_labels": [{"source": "s", "case": "c"}], "excerpts": [{"start_sample": 0, "end_sample": 1}]}, None),
        ("gap_report", tables.GAP_MANIFEST, {"sources": [{"id": "s"}, {"id": "s"}]}, "source ids"),
        ("gap_report", tables.GAP_MANIFEST, {"case_labels": [{"source": "s", "case": "c"}]}, "names a source"),
        ("gap_report", tables.GAP_MANIFEST, {"excerpts": [{"start_sample": 5, "end_sample": 5}]}, "an excerpt"),
    ],
)
def test_manifest_rules(spark, tmp_path, kind, schema, manifest, rule):
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    read = tables.read_manifest(spark, str(tmp_path / "m.json"), schema)
    if rule is None:
        assert tables.check_manifest(read, kind).count() == 1
    else:
        with pytest.raises(tables.InputError, match=rule):
            tables.check_manifest(read, kind)


def test_a_stream_in_several_batches_equals_the_table(spark, tmp_path):
    rows = spark.createDataFrame([(k, k % 3, "ab"[k % 2], float(k)) for k in range(40)], "event_id long, d int, event_type string, value double")
    rows = rows.selectExpr("event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, d, event_id) AS ts", "1L AS user_id", "event_type", "value", "'' AS props")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = blocks.block_facts(blocks.read_events(spark, str(tmp_path / "in"), files_per_batch=1), late="31 days")
    got = blocks.run_to_end(stream, ["window_start", "event_type"])
    want = blocks.block_facts(spark.read.parquet(str(tmp_path / "in")))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    (tmp_path / "none").mkdir()
    assert blocks.run_to_end(blocks.block_facts(blocks.read_events(spark, str(tmp_path / "none"))), ["window_start", "event_type"]).count() == 0


@pytest.mark.parametrize("block,size", [(64, 100), (100, 64), (7, 7), (1000, 1 << 20), (33, 4000)])
def test_ranges_give_the_blocks_of_the_whole(spark, tmp_path, block, size):
    """Any cut into ranges gives each block once, equal to a decode of the whole file."""
    r = np.random.default_rng(size)
    files = {}
    for name, (tag, bits), channels in (("a.wav", (1, 16), 1), ("b.wav", (1, 24), 3), ("c.wav", (3, 64), 2), ("d.wav", (1, 8), 2)):
        n = 517
        data = r.bytes(n * channels * bits // 8) if tag == 1 else r.normal(size=n * channels).astype("<f8").tobytes()
        (tmp_path / name).write_bytes(header(tag, channels, 8000, bits, data, b"junk" + struct.pack("<I", 3) + b"abc\0"))
        files[str(tmp_path / name)] = wave.decode(data, tag, bits)[0].reshape(-1, channels), wave.decode(data, tag, bits)[1].reshape(-1, channels)
    (tmp_path / "_hidden").write_bytes(b"no wave")
    rows = wave.read_wave(spark, str(tmp_path), block_frames=block, range_bytes=size).collect()
    for name, (x, clipped) in files.items():
        for c in range(x.shape[1]):
            mine = sorted((r for r in rows if (r["source_id"], r["channel"]) == (name, c)), key=lambda r: r["block_id"])
            assert [(r["block_id"], r["start_frame"]) for r in mine] == [(k, k * block) for k in range(-(-len(x) // block))]
            assert np.array_equal(np.concatenate([r["samples"] for r in mine]), x[:, c]) and sum(r["clipped"] for r in mine) == clipped[:, c].sum()
    assert len(rows) == sum(-(-len(x) // block) * x.shape[1] for x, _ in files.values())
    assert wave.read_wave(spark, str(tmp_path / "a.*"), block_frames=1000).count() == 1


@pytest.mark.parametrize("wide", [False, True])
def test_a_file_of_gigabytes_is_many_tasks(tmp_path, wide):
    """A sparse file: only the ranges that are read are looked at, a block at a time."""
    frames, align = (1_700_000_000 if wide else 1_000_000_000), 4
    ds64 = b"ds64" + struct.pack("<IQQQI", 28, 0, frames * align, frames, 0)
    head = header(1, 2, 48000, 16, b"", ds64 if wide else b"", b"RF64" if wide else b"RIFF")
    head = head[:-4] + (b"\xff\xff\xff\xff" if wide else struct.pack("<I", frames * align))
    path = tmp_path / "long.wav"
    with open(path, "wb") as f:
        f.write(head)
        f.seek(len(head) + (frames - 1) * align)
        f.write(struct.pack("<2h", 16384, -16384))
    reader = wave.WaveReader({"path": str(path), "blockframes": "65536", "channels": "keep", "rangebytes": str(64 << 20)})
    parts = reader.partitions()
    assert len(parts) == -(-path.stat().st_size // (64 << 20)) and path.stat().st_size > 2**31
    starts = [reader.read(p) for p in (parts[0], parts[-2], parts[-1])]
    first = next(starts[0]).to_pylist()
    assert [(r["channel"], r["block_id"]) for r in first] == [(0, 0), (1, 0)] and len(first[0]["samples"]) == 65536
    blocks = [b for it in starts[1:] for b in (x.column("block_id")[0].as_py() for x in it)]
    assert blocks == list(range(blocks[0], -(-frames // 65536)))
    last = list(reader.read(parts[-1])) or list(reader.read(parts[-2]))
    assert [r["samples"][-1] for r in last[-1].to_pylist()] == [0.5, -0.5] and last[-1].to_pylist()[0]["start_frame"] + len(last[-1].to_pylist()[0]["samples"]) == frames


def test_malformed_files_are_refused_by_tasks(spark, tmp_path):
    good = header(1, 1, 8000, 16, b"1234")
    for k, bad in enumerate((b"", b"RIFX" + good[4:], good[:-2], header(1, 1, 8000, 16, b"123"), good[:20], header(7, 1, 8000, 8, b"1"))):
        path = tmp_path / f"{k}.wav"
        path.write_bytes(bad)
        with pytest.raises(Exception, match="WaveError"):
            wave.read_wave(spark, str(path)).collect()
    nan = header(3, 1, 8000, 32, struct.pack("<2f", float("nan"), 2.0))
    (tmp_path / "n.wav").write_bytes(nan)
    row = wave.read_wave(spark, str(tmp_path / "n.wav")).first()
    assert np.isnan(row["samples"][0]) and row["samples"][1] == 2.0 and row["clipped"] == 1


def test_digests_of_files(spark, tmp_path):
    import hashlib

    for k, data in enumerate((b"", b"abc", b"x" * (3 << 20))):
        (tmp_path / f"{k}.wav").write_bytes(data)
    rows = wave.digests(spark, str(tmp_path)).orderBy("source_id").collect()
    assert [(r["bytes"], r["sha256"]) for r in rows] == [(len(d), hashlib.sha256(d).hexdigest()) for d in (b"", b"abc", b"x" * (3 << 20))]
