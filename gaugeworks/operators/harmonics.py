"""Harmonic tracking of spectra: partials by prominence, residual power, octave hypotheses.

A frame is a row and none meets another, so there is no shuffle; the frames of an Arrow
batch are worked on together in numpy. Around each multiple of the expected pitch the
strongest bin is looked up; peaks that stand out give the pitch, and a second look around
its own multiples gives the partials. Their power is taken from the frame's and from its
bands'; what is left is the residual.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.expr import BAND_EDGES

#: Partials, cents around a partial, least prominence, octave factor and orders,
#: cents that the pitch may be off, least confidence, floor of a spectrum in dB, lowest pitch.
PARTIALS, REACH, PROMINENT, OCTAVE, ORDERS, OFF, SURE, FLOOR, LOWEST = 12, 35.0, 2.5, 1.35, 8, 220.0, 0.30, -100.0, 20.0
TINY = 1e-30
#: What is left of a power under this share of it is rounding, and so nothing.
NOTHING = 1e-9
#: Spectra that are tracked together.
TOGETHER = 2048


def level(power: Column) -> Column:
    return F.when(power > TINY, 10 * F.log10(power)).otherwise(F.lit(-300.0))


def _db(power: np.ndarray) -> np.ndarray:
    return np.where(power > TINY, 10 * np.log10(np.maximum(power, TINY)), -300.0)


def _between(cum: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums of bins first to last of each row, both included; none where last < first."""
    row = np.arange(len(cum))
    return np.where(last >= first, cum[row, np.maximum(last, first - 1) + 1] - cum[row, first], 0.0)


def peaks(power: np.ndarray, cum: np.ndarray, step: np.ndarray, hz: np.ndarray) -> tuple[np.ndarray, ...]:
    """(there, Hz, power, prominence) of the strongest bin near ``hz`` of each row. ``cum`` has
    the sums of the bins before each."""
    bins, row = power.shape[1], np.arange(len(power))
    spot = np.where(np.isfinite(hz), hz, 0.0) / step
    wide = np.maximum(2, np.ceil(spot * (2 ** (REACH / 1200) - 1))).astype(int)
    middle = np.floor(spot + 0.5).astype(int)
    start, end = np.where(middle > wide, middle - wide, 1), np.minimum(middle + wide, bins - 2)
    there = (spot >= 1) & (spot < bins - 1) & (start <= end)
    start, end = np.where(there, start, 0), np.where(there, end, 0)
    k = np.arange(bins)
    best = np.where((k >= start[:, None]) & (k <= end[:, None]), power, -1.0).argmax(1)
    l, m, r = (np.log(np.maximum(power[row, np.clip(best + d, 0, bins - 1)], TINY)) for d in (-1, 0, 1))
    bend = l - 2 * m + r
    off = np.divide(0.5 * (l - r), bend, out=np.zeros(len(bend)), where=np.abs(bend) > 2.0**-52)
    off = np.where(np.abs(off) < 1, off, 0.0)
    first, last = np.where(start > 3, start - 3, 1), np.minimum(end + 3, bins - 1)
    low, high = np.maximum(first, best - 1), np.minimum(last, best + 1)
    others = (last - first + 1) - np.maximum(high - low + 1, 0)
    mean = np.maximum(_between(cum, first, last) - _between(cum, low, high), 0.0) / np.maximum(others, 1)
    top = power[row, best]
    return there, (best + off) * step, top, np.where(others > 0, top / np.maximum(mean, TINY), 0.0)


def harmonic_score(power: np.ndarray, step: np.ndarray, hz: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Power at the first multiples of ``hz``, between bins, higher ones counting less."""
    out, row, bins = np.zeros(len(power)), np.arange(len(power)), power.shape[1]
    for order in range(1, ORDERS + 1):
        spot = hz * order / step
        low = np.clip(np.floor(spot).astype(int), 0, max(bins - 2, 0))
        share = spot - low
        value = power[row, low] * (1 - share) + power[row, np.minimum(low + 1, bins - 1)] * share
        out += np.where((hz * order < limit) & (spot < bins - 1), value, 0.0) / np.sqrt(order)
    return out


def track_spectra(power: np.ndarray, step: np.ndarray, expected: np.ndarray) -> dict[str, np.ndarray]:
    """The facts of ``track`` for spectra of one length; partials as (spectra, PARTIALS)."""
    n, bins = power.shape
    cum = np.concatenate([np.zeros((n, 1)), np.cumsum(power, 1)], 1)
    nyquist, total = (bins - 1) * step, power[:, 1:].sum(1)
    asked = np.where(np.isfinite(expected), expected, 0.0)
    fits = (asked > 0) & (asked < nyquist * 0.95) & (asked / step >= 3) & (_db(total) >= FLOOR)
    above, weight = np.zeros(n), np.zeros(n)
    for order in range(1, PARTIALS + 1):
        there, hz, top, stands = peaks(power, cum, step, asked * order)
        use = fits & there & (asked * order < nyquist * 0.98) & (stands >= PROMINENT) & (_db(top) >= FLOOR)
        share = np.where(use, top / np.sqrt(order), 0.0)
        above, weight = above + share * hz / order, weight + share
    pitch = np.divide(above, weight, out=np.zeros(n), where=weight > 0)
    close = np.abs(1200 * np.log2(np.maximum(pitch, TINY) / np.maximum(asked, TINY))) <= OFF
    pitch = np.where((weight > 0) & (pitch > 0) & close, pitch, np.nan)
    band = lambda hz: np.searchsorted(BAND_EDGES, hz, "right")
    bands = np.zeros((n, len(BAND_EDGES) + 1))
    of = band(np.arange(bins)[None, :] * step[:, None])
    np.add.at(bands, (np.arange(n)[:, None], of[:, 1:]), power[:, 1:])
    left, found = bands.copy(), {c: np.full((n, PARTIALS), np.nan) for c in ("hz", "cents", "power")}
    for order in range(1, PARTIALS + 1):
        predicted = pitch * order
        there, hz, _, stands = peaks(power, cum, step, predicted)
        middle = np.floor(hz / step + 0.5).astype(int)
        whole = _between(cum, np.where(middle > 1, middle - 1, 1), np.minimum(middle + 1, bins - 1))
        use = there & (predicted < nyquist * 0.98) & (stands >= PROMINENT) & (_db(whole) >= FLOOR)
        at = np.flatnonzero(use)
        found["hz"][at, order - 1], found["power"][at, order - 1] = hz[at], whole[at]
        found["cents"][at, order - 1] = 1200 * np.log2(hz[at] / predicted[at])
        np.subtract.at(left, (at, band(hz[at])), whole[at])
    harmonic = np.minimum(np.nansum(found["power"], 1), total)
    there = harmonic > 0
    score, half, double = (harmonic_score(power, step, asked * f, nyquist * 0.98) for f in (1.0, 0.5, 2.0))
    half, double = np.where(asked * 0.5 >= LOWEST, half, 0.0), np.where(asked * 2 < nyquist * 0.95, double, 0.0)
    rest = total - np.where(there, harmonic, 0.0)
    residual = np.maximum(np.where(rest > NOTHING * total, rest, 0.0), TINY)
    sure = np.where(there, harmonic / np.maximum(total, TINY), 0.0)
    return {
        "pitch_hz": np.where(there, pitch, np.nan),
        "confidence": sure,
        "harmonic_power": np.where(there, harmonic, np.nan),
        "residual_power": residual,
        "hnr_db": np.where(there, 10 * np.log10(np.maximum(harmonic, TINY) / residual), np.nan),
        "octave_fault": there & ((half > score * OCTAVE) | (double > score * OCTAVE)),
        "valid": there & (sure >= SURE),
        "partials": found,
        "band_power": bands,
        "residual_band": np.where(there[:, None], np.where(left > NOTHING * bands, left, 0.0), bands),
    }


_FACTS = (
    "pitch_hz double, confidence double, harmonic_power double, residual_power double, hnr_db double, octave_fault boolean, valid boolean, "
    "partials array<struct<partial: int, hz: double, cents: double, power: double>>, band_power array<double>, residual_band array<double>"
)
_PARTIAL = pa.struct([("partial", pa.int32()), ("hz", pa.float64()), ("cents", pa.float64()), ("power", pa.float64())])


def track(frames: DataFrame, power: str = "power", step: str = "bin_hz", expected: str = "expected_hz") -> DataFrame:
    """``frames`` with pitch_hz, confidence, harmonic_power, residual_power, hnr_db,
    octave_fault, valid, partials (partial, hz, cents, power), band_power and residual_band.

    ``power`` is a spectrum from 0 Hz in bins of ``step``; a null one, or one of no bins, has
    silence in it. Where the expected pitch is null, not positive, too low for the bins or
    too high for the rate, where the frame is under the floor, or where no partial stands
    out, there is no pitch and nothing is valid: harmonic power and partials are null, the
    residual is the whole. A pitch more than 220 cents off is none. An octave fault is a half
    or a double whose harmonic score is 1.35 of its own.
    """
    schema = T.StructType([*frames.schema.fields, *T.StructType.fromDDL(_FACTS).fields])
    names = [f.name for f in T.StructType.fromDDL(_FACTS).fields]

    def run(batches):
        for batch in (b.slice(k, TOGETHER) for b in batches for k in range(0, b.num_rows, TOGETHER)):
            n = batch.num_rows
            spectra = [np.nan_to_num(v.values.to_numpy(zero_copy_only=False)) if v.values is not None and len(v.values) else np.zeros(1) for v in batch.column(power)]
            steps, asked = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (step, expected))
            out: dict = {c: [None] * n for c in names}
            for size in {len(s) for s in spectra}:
                at = [k for k, s in enumerate(spectra) if len(s) == size]
                got = track_spectra(np.stack([spectra[k] for k in at]), steps[at], asked[at])
                partials = got.pop("partials")
                for j, k in enumerate(at):
                    for c, v in got.items():
                        out[c][k] = v[j]
                    if not np.isnan(got["harmonic_power"][j]):
                        some = np.flatnonzero(~np.isnan(partials["power"][j]))
                        out["partials"][k] = [{"partial": int(o) + 1, **{c: float(v[j, o]) for c, v in partials.items()}} for o in some]
            types = {"partials": pa.list_(_PARTIAL), "octave_fault": pa.bool_(), "valid": pa.bool_(), "band_power": pa.list_(pa.float64()), "residual_band": pa.list_(pa.float64())}
            found = [pa.array([bool(v) for v in out[c]] if types.get(c) == pa.bool_() else out[c], types.get(c, pa.float64()), from_pandas=True) for c in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=schema.names)

    return frames.mapInArrow(run, schema)
