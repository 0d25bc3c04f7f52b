"""Modes of spectra above a local baseline, and their pairing between two sides of a case."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.expr import tidy

#: Bins to either side of the baseline and those left out, least prominence in
#: dB, lowest frequency and highest share of the rate, modes a spectrum, pairing tolerance.
AROUND, APART, PROMINENT, LOWEST, HIGHEST, MOST, NEAR_HZ, NEAR_SHARE = 16, 2, 3.0, 40.0, 0.49, 512, 100.0, 0.15
LN_1000 = math.log(1000.0)
MODE = "array<struct<hz: double, bandwidth: double, q: double, prominence: double, decay: double>>"
FACTS = ("frequency_hz", "bandwidth_hz", "q", "prominence_db", "decay_seconds")


def baseline(power: np.ndarray) -> np.ndarray:
    """Mean of the bins within ``AROUND`` of each, without bin 0 and those within ``APART``."""
    n = len(power)
    cum, k = np.concatenate([[0.0], np.cumsum(power)]), np.arange(n)
    low, high = np.maximum(k - AROUND, 1), np.minimum(k + AROUND, n - 1)
    inner_low, inner_high = np.maximum(k - APART, 1), np.minimum(k + APART, n - 1)
    count = (high - low + 1) - np.maximum(inner_high - inner_low + 1, 0)
    rest = (cum[high + 1] - cum[np.minimum(low, high + 1)]) - np.where(inner_high >= inner_low, cum[inner_high + 1] - cum[inner_low], 0.0)
    return np.where(count > 0, np.maximum(rest, 0.0) / np.maximum(count, 1), 0.0)


def modes_of(power: np.ndarray, step: float, most: int = MOST) -> list[tuple[float, ...]]:
    """(Hz, bandwidth, Q, prominence, decay) of a spectrum's modes by frequency: local tops
    that stand out of their baseline; of more than ``most`` the strongest, the lower of two
    that are as strong. The bandwidth reaches to the first bins at half the power or less."""
    n = len(power)
    if n < 3:
        return []
    hz, base = np.arange(n) * step, baseline(power)
    top = np.zeros(n, bool)
    top[1:-1] = (power[1:-1] > power[:-2]) & (power[1:-1] >= power[2:])
    stands = 10 * np.log10(np.maximum(power, 1e-300) / np.maximum(base, 1e-300))
    rate = 2 * (n - 1) * step
    at = np.flatnonzero(top & (power > 0) & (base > 0) & (stands >= PROMINENT) & (hz >= LOWEST) & (hz <= HIGHEST * rate))
    at = np.sort(at[np.argsort(-power[at], kind="stable")[:most]])
    out = []
    for k in at.tolist():
        below, above = np.flatnonzero(power[1 : k + 1] <= power[k] / 2), np.flatnonzero(power[k:] <= power[k] / 2)
        left, right = (int(below[-1]) + 1 if len(below) else 1), (k + int(above[0]) if len(above) else n - 1)
        width = max((right - left) * step, step)
        out.append((float(hz[k]), width, float(hz[k]) / width, float(stands[k]), LN_1000 / (math.pi * width)))
    return out


def pair(reference: list, model: list) -> list[tuple[int, int]]:
    """Matches of two lists of modes in rising frequency, order kept: the lowest two that are
    left match where they are near enough, else the lower one is passed over."""
    out, i, j = [], 0, 0
    while i < len(reference) and j < len(model):
        apart = model[j][0] - reference[i][0]
        if abs(apart) <= max(NEAR_HZ, NEAR_SHARE * reference[i][0]):
            out.append((i, j))
            i, j = i + 1, j + 1
        elif apart < 0:
            j += 1
        else:
            i += 1
    return out


def mode_checks(spectra: DataFrame, most: int = MOST) -> DataFrame:
    """(scope, case, kind, index, reference_value, model_value, delta, availability) of spectra
    (case, side, power, bin_hz), one a side.

    Five facts of each pair of modes, numbered from 0 by frequency; the density of each side
    in modes per kHz; the mean distance of the pairs in cents, as a delta. A case without a
    side, or without a pair, has its facts once, UNAVAILABLE. No spectrum meets more than its
    other side's modes, at most ``most``.
    """

    def find(batches):
        for batch in batches:
            found = []
            for v, step in zip(batch.column(2), batch.column(3).to_pylist()):
                power = np.nan_to_num(v.values.to_numpy(zero_copy_only=False)) if v.values is not None else np.zeros(0)
                found.append([dict(zip(("hz", "bandwidth", "q", "prominence", "decay"), m)) for m in modes_of(power, step, most)])
            limit = [step * (len(v) - 1) / 1000 if len(v) > 1 else None for v, step in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            kind = pa.list_(pa.struct([(c, pa.float64()) for c in ("hz", "bandwidth", "q", "prominence", "decay")]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind), pa.array(limit, pa.float64())], names=["case", "side", "modes", "khz"])

    rows = spectra.select("case", "side", F.coalesce("power", F.array().cast("array<double>")).alias("power"), "bin_hz")
    modes = rows.mapInArrow(find, T.StructType([spectra.schema["case"], *T.StructType.fromDDL(f"side string, modes {MODE}, khz double").fields]))
    side = lambda c, s: F.first(F.when(F.col("side") == s, F.col(c)), True)
    both = modes.groupBy("case").agg(*[side(c, s).alias(f"{c}_{s}") for s in ("reference", "model") for c in ("modes", "khz")])
    schema = T.StructType([spectra.schema["case"], *T.StructType.fromDDL("density_reference double, density_model double, pairs array<struct<index: int, facts: array<array<double>>, cents: double>>").fields])

    def match(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                a, b = ([tuple(m.values()) for m in r[f"modes_{s}"] or []] for s in ("reference", "model"))
                pairs = [{"index": n, "facts": [list(a[i]), list(b[j])], "cents": abs(1200 * math.log2(b[j][0] / a[i][0]))} for n, (i, j) in enumerate(pair(a, b))]
                density = [len(m) / r[f"khz_{s}"] if r[f"modes_{s}"] is not None and r[f"khz_{s}"] else None for m, s in ((a, "reference"), (b, "model"))]
                out.append((r["case"], *density, pairs))
            kind = pa.list_(pa.struct([("index", pa.int32()), ("facts", pa.list_(pa.list_(pa.float64()))), ("cents", pa.float64())]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [batch.schema.field("case").type, pa.float64(), pa.float64(), kind])], names=schema.names)

    paired = both.mapInArrow(match, schema)
    none = F.lit(None).cast("double")
    some = F.when(F.size("pairs") > 0, F.col("pairs")).otherwise(F.array(F.lit(None).cast("struct<index: int, facts: array<array<double>>, cents: double>")))
    each = paired.select("case", F.explode(some).alias("p"))
    fact = lambda k, s: tidy(F.col("p.facts")[s][k])
    kinds = F.array(*[F.struct(F.lit(f"body_mode_{name}").alias("kind"), fact(k, 0).alias("reference_value"), fact(k, 1).alias("model_value")) for k, name in enumerate(FACTS)])
    facts = each.select("case", F.coalesce("p.index", F.lit(0)).alias("index"), F.inline(kinds)).select("case", "kind", "index", "reference_value", "model_value", tidy(F.col("model_value") - F.col("reference_value")).alias("delta"))
    density = paired.select("case", F.lit("body_mode_density_per_khz").alias("kind"), F.lit(0).alias("index"), tidy(F.col("density_reference")).alias("reference_value"), tidy(F.col("density_model")).alias("model_value"))
    density = density.withColumn("delta", tidy(F.col("model_value") - F.col("reference_value")))
    mean: Column = F.aggregate("pairs", F.lit(0.0), lambda a, p: a + p["cents"]) / F.when(F.size("pairs") > 0, F.size("pairs"))
    distance = paired.select("case", F.lit("body_mode_distance_cents").alias("kind"), F.lit(0).alias("index"), none.alias("reference_value"), none.alias("model_value"), tidy(mean).alias("delta"))
    every = facts.unionByName(density).unionByName(distance)
    return every.select(F.lit("body").alias("scope"), "case", "kind", F.col("index").cast("long").alias("index"), "reference_value", "model_value", "delta", F.when(F.col("delta").isNull(), "UNAVAILABLE").otherwise("AVAILABLE").alias("availability"))
