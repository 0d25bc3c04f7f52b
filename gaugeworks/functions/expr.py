"""Column expressions for levels, pitch, bands, time and quality flags."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The level of no power, in dB, and the power below which it holds.
FLOOR_DB, FLOOR_POWER = -300.0, 1e-30
#: Upper edges of bands 0 to 8 in Hz; band 9 has the rest.
BAND_EDGES = (60.0, 120.0, 250.0, 500.0, 1000.0, 2000.0, 4000.0, 8000.0, 16000.0)
#: BS.1770 channel weights by position.
CHANNEL_WEIGHTS = {"lfe": 0.0, "left_surround": 1.41, "right_surround": 1.41}


def rounded(x: Column, digits: int) -> Column:
    """Rounded by the number as it is stored, half away from zero, as SQL does: ``F.round`` goes
    by its shortest decimal text, and takes 0.285, stored a little below, for a half."""
    return F.round(x * 10.0**digits) / 10.0**digits


def tidy(x: Column, digits: int = 6) -> Column:
    """Rounded, with negative zero made positive: what results show."""
    return F.round(x, digits) + F.lit(0.0)


def power_db(p: Column) -> Column:
    return F.when(p > FLOOR_POWER, 10 * F.log10(p)).otherwise(F.lit(FLOOR_DB))


def amplitude_db(a: Column) -> Column:
    return power_db(a * a)


def loudness(p: Column) -> Column:
    """LUFS of a weighted mean power."""
    return F.lit(-0.691) + power_db(p)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def midi_to_hz(m: Column) -> Column:
    return F.lit(440.0) * F.pow(F.lit(2.0), (m - 69) / 12)


def hz_to_midi(f: Column) -> Column:
    return F.when(f > 0, F.lit(69.0) + 12 * F.log2(f / 440))


def cents(f: Column, target: Column) -> Column:
    return F.when((f > 0) & (target > 0), 1200 * F.log2(f / target))


def band(f: Column) -> Column:
    """Number of the band that a frequency falls into."""
    out = F.lit(len(BAND_EDGES))
    for k in range(len(BAND_EDGES) - 1, -1, -1):
        out = F.when(f < BAND_EDGES[k], k).otherwise(out)
    return F.when(f.isNotNull(), out)


def seconds_to_sample(s: Column, rate: float) -> Column:
    return F.floor(s * rate + 0.5).cast("long")


def beats_to_seconds(beat: Column, at_beat: Column, at_seconds: Column, bpm: Column) -> Column:
    return at_seconds + (beat - at_beat) * 60 / bpm


def seconds_to_beats(s: Column, at_beat: Column, at_seconds: Column, bpm: Column) -> Column:
    return at_beat + (s - at_seconds) * bpm / 60


def channel_weight(position: Column) -> Column:
    out = F.lit(1.0)
    for name, weight in CHANNEL_WEIGHTS.items():
        out = F.when(position == name, weight).otherwise(out)
    return out


def flagged(confidence: Column, flags: Column) -> Column:
    """Confidence lowered by the number of quality flags."""
    return confidence / (1 + F.bit_count(flags))


def sha_mod5(text: Column) -> Column:
    """The SHA-256 digest modulo 5. As 16 mod 5 is 1, that is the sum of its pieces' values."""
    digest = F.sha2(text, 256)
    pieces = [F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("long") % 5 for k in range(5)]
    return sum(pieces[1:], pieces[0]) % 5


def part_after_colon(text: Column) -> Column:
    """The text behind the first colon; the whole where there is none."""
    at = F.instr(text, ":")
    return F.when(at > 0, F.substring(text, at + 1, 1 << 30)).otherwise(text)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return dot(a, b) / F.when(size > 0, size)


#: Natural logarithm of 1000, for 60 dB decay from a bandwidth.
LN_1000 = math.log(1000.0)
