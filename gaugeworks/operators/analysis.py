"""From sample blocks to facts, frame tracks, alignments and items: the audio stages.

Each function takes and gives DataFrames. Facts and tracks are made a chunk of a series at a
time, so a recording of any length spans many tasks: frames that overlap a chunk's end read
its neighbours' samples, and the filters' states pass from chunk to chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions.expr import BAND_EDGES
from gaugeworks.operators import chunks as C
from gaugeworks.operators import kernels as K

FACTS = "source_id string, channel int, frames long, peak double, rms double, dc double, crest_db double, true_peak double, integrated_lufs double"
TRACK = (
    "source_id string, channel int, frame_index long, time_seconds double, rms_dbfs double, pitch_hz double, pitch_confidence double, centroid_hz double, "
    "spread_hz double, rolloff_hz double, flatness double, flux double, onset_strength double, band_db array<double>, chroma array<double>"
)
ITEMS = "source_id string, event_id string, kind string, start_seconds double, end_seconds double, confidence double"


@dataclass(frozen=True)
class Options:
    """Defaults of analysis, alignment and segmentation."""

    frame: int = 2048
    hop: int = 512
    search: float = 0.15
    tail_limit: float = 1.5
    release_fallback: float = 0.25
    after_attack: float = 0.02
    onset_floor: float = 0.08
    step: float = 0.05
    silence: float = -60.0
    refine: float = 0.25
    skip: float = 0.45
    repeat: float = 0.45


def db(p) -> np.ndarray:
    return np.where(np.asarray(p) > 1e-30, 10 * np.log10(np.maximum(p, 1e-30)), -300.0)


SERIES = ["source_id", "channel"]
_PARTS = "source_id string, channel int, rate int, n long, peak double, total double, energy double, true_peak double, steps array<struct<step: long, n: int, power: double>>"


def chunk_facts(blocks: DataFrame, size: int = C.SIZE) -> DataFrame:
    """What each chunk adds to the facts of its series: extremes, sums, and the K-weighted
    energy of each tenth of a second that it touches."""
    pieces = C.chunks(blocks, SERIES, size, before=K.PEAK_REACH, after=K.PEAK_REACH, keep=["rate"])

    def run(batches):
        for batch in batches:
            rows = []
            weighted = C.arrays(batch.column("filtered"))
            for r, x, y in zip(batch.drop_columns(["samples", "filtered"]).to_pylist(), C.arrays(batch.column("samples")), weighted):
                part = C.own_part(x, r["first"], r["chunk"], size, r["own"])
                own = x[part]
                ahead, behind = part.start, len(x) - part.stop
                top = K.true_peak(own, padded=np.pad(x, (K.PEAK_REACH - ahead, K.PEAK_REACH - behind)))
                start, tenth = r["chunk"] * size, int(r["rate"] / 10 + 0.5)
                step = np.arange(start, start + len(own)) // max(tenth, 1)
                edge = np.flatnonzero(np.diff(step, prepend=step[0] - 1))
                power, count = np.add.reduceat(y * y, edge), np.diff(edge, append=len(own))
                steps = [{"step": int(k), "n": int(n), "power": float(p)} for k, n, p in zip(step[edge], count, power)]
                rows.append((r["source_id"], r["channel"], r["rate"], len(own), float(np.abs(own).max()), float(own.sum()), float((own * own).sum()), top, steps))
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows), _PART_TYPES)], names=_PART_NAMES)

    return C.filtered(pieces, SERIES, size).mapInArrow(run, _PARTS)


_PART_NAMES = ["source_id", "channel", "rate", "n", "peak", "total", "energy", "true_peak", "steps"]
_PART_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * 4, pa.list_(pa.struct([("step", pa.int64()), ("n", pa.int32()), ("power", pa.float64())]))]


def gated_loudness(steps: DataFrame, key: list[str]) -> DataFrame:
    """(key, integrated_lufs) of whole tenths of a second (key, step, power, the mean square):
    400 ms every 100 ms, first those of -70 or more, then those within 10 of their mean."""
    four = W.partitionBy(*key).orderBy("step").rowsBetween(-3, 0)
    blocks = steps.select(*key, F.avg("power").over(four).alias("p"), F.count(F.lit(1)).over(four).alias("held")).filter("held = 4")
    loud = blocks.select(*key, "p", level_db("p").alias("level")).filter("level >= -70")
    gates = loud.groupBy(*key).agg(F.greatest(F.lit(-70.0), level_db(F.avg("p")) - 10).alias("gate"))
    # a row of a tenth of a second each: of one series they may meet in a join that can be split
    kept = loud.join(gates, key).filter(F.col("level") >= F.col("gate"))
    return kept.groupBy(*key).agg(level_db(F.avg("p")).alias("integrated_lufs"))


def level_db(p) -> F.Column:
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p > 1e-30, 10 * F.log10(p)).otherwise(F.lit(-300.0)) - 0.691


def facts(blocks: DataFrame, size: int = C.SIZE) -> DataFrame:
    """Length, peak, level, offset, crest, true peak and gated loudness of each series of
    blocks (source_id, channel, rate, start_frame, samples), a chunk to a task."""
    parts = chunk_facts(blocks, size)
    plain = lambda p: F.when(p > 1e-30, 10 * F.log10(p)).otherwise(F.lit(-300.0))
    sums = parts.groupBy(*SERIES).agg(
        F.sum("n").alias("frames"), F.max("peak").alias("peak"), F.sum("energy").alias("energy"), F.sum("total").alias("total"), F.max("true_peak").alias("true_peak")
    )
    mean = F.col("energy") / F.col("frames")
    level = sums.select(*SERIES, "frames", "peak", F.sqrt(mean).alias("rms"), (F.col("total") / F.col("frames")).alias("dc"), (plain(F.col("peak") * F.col("peak")) - plain(mean)).alias("crest_db"), "true_peak")
    tenth = F.floor(F.col("rate") / 10 + 0.5)
    steps = parts.select(*SERIES, "rate", F.inline("steps")).groupBy(*SERIES, "step").agg(F.sum("n").alias("n"), F.sum("power").alias("power"), F.first("rate").alias("rate"))
    whole = steps.filter(F.col("n") == tenth).select(*SERIES, "step", (F.col("power") / F.col("n")).alias("power"))
    return level.join(gated_loudness(whole, SERIES), SERIES, "left").select(*[c.split()[0] for c in FACTS.split(", ")])


def track(x: np.ndarray, rate: float, options: Options = Options()) -> dict[str, np.ndarray]:
    """The frame track of one series."""
    fr = K.frames(x, options.frame, options.hop)
    p = K.power_spectrum(fr)
    hz = np.arange(p.shape[1]) * rate / options.frame
    q, f = p[:, 1:], hz[1:]
    total = np.maximum(q.sum(1), 1e-30)
    centroid = (q * f).sum(1) / total
    mag = np.sqrt(p)
    rise = np.zeros(len(fr))
    if len(fr) > 1:
        rise[1:] = np.maximum(mag[1:] - mag[:-1], 0).sum(1) / np.maximum(mag[1:].sum(1), 1e-30)
    level = db((fr * fr).mean(1))
    pitch = np.array([K.pitch(v, rate) for v in fr]).reshape(-1, 2)
    semitones = np.abs(np.diff(12 * np.log2(np.where(pitch[:, 0] > 0, pitch[:, 0], np.nan)), prepend=np.nan))
    onset = K.combined_onset(rise, np.diff(level, prepend=level[:1]), K.phase_onset(fr), np.nan_to_num(semitones))
    band = np.searchsorted(BAND_EDGES, f, "right")
    bands = np.stack([q[:, band == b].sum(1) for b in range(10)], 1)
    use = (f >= 55) & (f <= 5000)
    midi = 69 + 12 * np.log2(f[use] / 440)
    low = np.floor(midi).astype(int)
    weight = mag[:, 1:][:, use] * np.sqrt(440 / f[use])
    chroma = np.zeros((len(fr), 12))
    for shift, share in ((0, 1 - (midi - low)), (1, midi - low)):
        for pc in range(12):
            chroma[:, pc] += (weight * share)[:, (low + shift) % 12 == pc].sum(1)
    chroma /= np.maximum(np.linalg.norm(chroma, axis=1, keepdims=True), 1e-30)
    return {
        "frame_index": np.arange(len(fr)),
        "time_seconds": (np.arange(len(fr)) * options.hop + options.frame / 2) / rate,
        "rms_dbfs": level,
        "pitch_hz": pitch[:, 0],
        "pitch_confidence": pitch[:, 1],
        "centroid_hz": centroid,
        "spread_hz": np.sqrt((q * (f - centroid[:, None]) ** 2).sum(1) / total),
        "rolloff_hz": f[np.minimum((np.cumsum(q, 1) < 0.85 * total[:, None]).sum(1), len(f) - 1)],
        "flatness": np.exp(np.log(np.maximum(q, 1e-30)).mean(1)) / np.maximum(q.mean(1), 1e-30),
        "flux": rise,
        "onset_strength": onset,
        "band_db": list(db(bands)),
        "chroma": list(chroma),
    }


def frame_tracks(blocks: DataFrame, options: Options = Options(), size: int = C.SIZE) -> DataFrame:
    """The frame track of each series, a chunk to a task. A frame belongs to the chunk in
    which it begins; the two before a chunk's first are analysed once more, as rises and
    phases compare with them."""
    hop, size = options.hop, max(1, size // options.hop) * options.hop
    pieces = C.chunks(blocks, SERIES, size, before=2 * hop, after=options.frame, keep=["rate"])
    types = [pa.string(), pa.int32(), pa.int64(), *[pa.float64()] * 10, *[pa.list_(pa.float64())] * 2]
    names = [c.split()[0] for c in TRACK.split(", ")]

    def run(batches):
        for batch in batches:
            for r, x in zip(batch.drop_columns(["samples"]).to_pylist(), C.arrays(batch.column("samples"))):
                lead = (r["chunk"] * size - r["first"]) // hop
                last = lead + -(-r["own"] // hop)
                out = track(x[: (last - 1) * hop + options.frame], float(r["rate"]), options)
                n = len(out["frame_index"]) - lead
                if n <= 0:
                    continue
                ahead = r["first"] // hop
                out["frame_index"] = out["frame_index"] + ahead
                out["time_seconds"] = out["time_seconds"] + ahead * hop / r["rate"]
                columns = [[r["source_id"]] * n, [r["channel"]] * n, *[list(out[c][lead:]) for c in names[2:]]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t, from_pandas=True) for c, t in zip(columns, types)], names=names)

    return pieces.mapInArrow(run, TRACK)


def score_track(score: pd.DataFrame, step: float) -> tuple[np.ndarray, np.ndarray]:
    """(chroma, onset) frames that a score's notes (start, end, midi_note) would give."""
    n = int(np.ceil(score["end"].max() / step)) if len(score) else 0
    chroma, onset = np.zeros((n, 12)), np.zeros(n)
    for start, end, midi in score[["start", "end", "midi_note"]].itertuples(index=False):
        a, b = int(start / step), max(int(start / step) + 1, int(np.ceil(end / step)))
        chroma[a:b, int(midi) % 12] = 1
        onset[min(a, n - 1)] = 1
    return chroma / np.maximum(np.linalg.norm(chroma, axis=1, keepdims=True), 1e-30), onset


def frame_cost(want: np.ndarray, starts: np.ndarray, chroma: np.ndarray, onset: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Weighted mean of the evidence at hand: chroma counts where both sides sound."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
    sounds = want.any(1)
    both = 0.5 * (sounds[:, None] & active[None, :])
    total = both * (1 - unit(want) @ unit(chroma).T) + 0.2 * np.abs(starts[:, None] - onset[None, :]) + 0.1 * (sounds[:, None] != active[None, :])
    return np.clip(total / (both + 0.3), 0, 1)


def align_scores(notes: DataFrame, tracks: DataFrame, options: Options = Options()) -> DataFrame:
    """(source_id, event_id, score_seconds, target_seconds): where each note (source_id,
    event_id, start, end, midi_note) begins in the recording, along the cheapest path."""

    def run(key, score, heard):
        columns = ["source_id", "event_id", "score_seconds", "target_seconds"]
        if not len(score) or not len(heard):
            return pd.DataFrame(columns=columns)
        heard = heard[heard["channel"] == 0].sort_values("frame_index")
        bucket = np.floor(heard["time_seconds"].to_numpy() / options.step).astype(int)
        n = bucket.max() + 1
        chroma, onset = np.zeros((n, 12)), np.zeros(n)
        np.add.at(chroma, bucket, np.stack(heard["chroma"].tolist()))
        np.maximum.at(onset, bucket, heard["onset_strength"].to_numpy())
        loud = np.full(n, -300.0)
        np.maximum.at(loud, bucket, heard["rms_dbfs"].to_numpy())
        want, starts = score_track(score, options.step)
        cost = frame_cost(want, starts, chroma, onset, loud > options.silence)
        path, _ = K.align(cost, options.skip, options.repeat, step=options.step)
        steps = np.array(path).reshape(-1, 2)
        t, strength = heard["time_seconds"].to_numpy(), heard["onset_strength"].to_numpy()

        def refined(at):
            """The strongest onset around, or the place itself."""
            look = np.flatnonzero(np.abs(t - at) <= options.refine)
            return float(t[look[np.argmax(strength[look])]]) if len(look) and strength[look].max() >= options.onset_floor else at

        rows = []
        for event, start in score[["event_id", "start"]].itertuples(index=False):
            i = min(int(start / options.step), len(want) - 1)
            # the nearest matched step within three stands for a skipped one
            k = int(np.argmin(np.abs(steps[:, 0] - i))) if len(steps) else -1
            there = k >= 0 and abs(steps[k, 0] - i) <= 3
            rows.append((key[0], event, float(start), refined(float(steps[k, 1] + i - steps[k, 0]) * options.step) if there else None))
        return pd.DataFrame(rows, columns=columns)

    schema = "source_id string, event_id string, score_seconds double, target_seconds double"
    return notes.groupBy("source_id").cogroup(tracks.groupBy("source_id")).applyInPandas(run, schema)


def phases(t: np.ndarray, level: np.ndarray, onset: np.ndarray, near: float, until: float, options: Options = Options()) -> dict[str, tuple[float, float]] | None:
    """Attack, body, release and tail of a note that begins near ``near`` and is written to
    end at ``until``; None where no onset is found."""
    look = np.flatnonzero(np.abs(t - near) <= options.search)
    if not len(look):
        return None
    score = 0.82 * onset[look] + 0.18 * (1 - np.abs(t[look] - near) / options.search)
    if score.max() < options.onset_floor:
        return None
    k = int(look[np.argmax(score)])
    end = max(int(np.searchsorted(t, until, "right")), k + 2)
    span = level[k:end]
    attack = k + int(np.argmax((span >= span.min() + 0.15 * np.ptp(span)) | (onset[k:end] > 0.05)))
    calm = [j for j in range(attack, min(end, len(t)) - 1) if t[j] - t[attack] >= options.after_attack and onset[j] <= 0.20 and onset[j + 1] <= 0.20]
    body = calm[0] if calm else min(attack + 1, len(t) - 1)
    behind = np.flatnonzero((t > t[body]) & (np.abs(t - until) <= max(options.search, (until - t[body]) / 2)))
    drop = np.maximum(0, level[np.maximum(behind - 1, 0)] - level[behind])
    release = int(behind[np.argmax(0.5 * np.minimum(drop / 12, 1) + 0.2 * (1 - np.abs(t[behind] - until) / max(until - t[body], 1e-9)))]) if len(behind) else len(t) - 1
    middle = float(np.median(level[body : max(release, body + 1)]))

    def falls(start, by, frames, limit):
        for j in range(start, len(t) - frames + 1):
            if t[j] - t[start] > limit:
                break
            if (level[j : j + frames] <= middle - by).all():
                return j
        return int(min(np.searchsorted(t, t[start] + limit), len(t) - 1))

    over = falls(release, 12, 2, options.release_fallback)
    gone = falls(over, 30, 3, options.tail_limit)
    at = [float(t[j]) for j in (attack, body, release, over, gone)]
    return {"attack": (at[0], at[1]), "body": (at[1], at[2]), "release": (at[2], at[3]), "tail": (at[3], at[4]), "note": (at[0], at[3])}


def segment(aligned: DataFrame, notes: DataFrame, tracks: DataFrame, options: Options = Options()) -> DataFrame:
    """Items of every aligned note: the note and its phases, by the frame track."""
    spans = aligned.join(notes.select("source_id", "event_id", (F.col("end") - F.col("start")).alias("lasts")), ["source_id", "event_id"])

    def run(key, events, heard):
        rows = []
        heard = heard[heard["channel"] == 0].sort_values("frame_index")
        t, level, onset = (heard[c].to_numpy() for c in ("time_seconds", "rms_dbfs", "onset_strength"))
        for event, at, lasts in events.sort_values("event_id")[["event_id", "target_seconds", "lasts"]].itertuples(index=False):
            if at is None or np.isnan(at) or not len(t):
                continue
            found = phases(t, level, onset, at, at + lasts, options)
            for kind, (a, b) in (found or {}).items():
                rows.append((key[0], event, kind, a, b, 1.0 if b > a else 0.0))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in ITEMS.split(", ")])

    return spans.groupBy("source_id").cogroup(tracks.groupBy("source_id")).applyInPandas(run, ITEMS)
