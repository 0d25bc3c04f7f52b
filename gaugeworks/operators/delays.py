"""Delay between two channels, seen at evenly spread anchors, by chunks with overlap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.operators import chunks as C

#: Anchors of a span, at most; lags to either side; least pairs of a lag that counts.
ANCHORS, LAGS, LEAST = 4096, 2048, 64
_SUMS = ["n", "a", "b", "aa", "bb", "ab"]


def anchor_places(start: int, own: int, length: int, anchors: int) -> np.ndarray:
    """The anchors floor(k * length / anchors) that lie in a chunk; every sample of a span that
    is no longer than that."""
    count = min(anchors, length)
    k = np.arange(-(-start * count // length), -(-(start + own) * count // length))
    return k * length // count


def lag_sums(left: DataFrame, right: DataFrame, key: list[str], lags: int = LAGS, anchors: int = ANCHORS, size: int = C.SIZE) -> DataFrame:
    """(key, lag, n and sums) of left samples at anchors and right samples ``lag`` behind them,
    of blocks (key, start_frame, samples). A chunk gives a row a lag, summed before it moves."""
    ends = left.filter(F.size("samples") > 0).groupBy(*key).agg(F.max(F.col("start_frame") + F.size("samples")).alias("length"))
    a = C.chunks(left, key, size).select(*key, "chunk", "own", "samples")
    b = C.chunks(right, key, size, before=lags, after=lags).select(*key, "chunk", F.col("first").alias("other_first"), F.col("samples").alias("other"))
    # a chunk of the left may need the right's last samples, where the right is the shorter
    both = a.join(b.hint("merge"), [*key, "chunk"]).join(ends.hint("merge"), key)
    schema = T.StructType([*[left.schema[c] for c in key], *T.StructType.fromDDL("lag int, " + ", ".join(f"{c} double" for c in _SUMS)).fields])
    lag = np.arange(-lags, lags + 1)

    def run(batches):
        for batch in batches:
            chunk, own, first, length = (batch.column(c).to_pylist() for c in ("chunk", "own", "other_first", "length"))
            for k, (x, y) in enumerate(zip(C.arrays(batch.column("samples")), C.arrays(batch.column("other")))):
                at = anchor_places(chunk[k] * size, own[k], length[k], anchors)
                sums = np.zeros((len(_SUMS), len(lag)))
                for part in np.array_split(at, max(1, len(at) * len(lag) >> 20)):
                    place = part[:, None] + lag[None] - first[k]
                    there = (place >= 0) & (place < len(y))
                    l = np.where(there, x[part - chunk[k] * size][:, None], 0.0)
                    r = np.where(there, y[np.clip(place, 0, len(y) - 1)], 0.0)
                    sums += np.stack([there.sum(0), l.sum(0), r.sum(0), (l * l).sum(0), (r * r).sum(0), (l * r).sum(0)])
                keys = [pa.array([batch.column(c)[k].as_py()] * len(lag), batch.schema.field(c).type) for c in key]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(lag, pa.int32()), *[pa.array(s) for s in sums]], names=schema.names)

    return both.mapInArrow(run, schema).groupBy(*key, "lag").agg(*[F.sum(c).alias(c) for c in _SUMS])


def delays(left: DataFrame, right: DataFrame, key: list[str], lags: int = LAGS, anchors: int = ANCHORS, size: int = C.SIZE) -> DataFrame:
    """(key, lag, correlation, pairs): the lag whose correlation over the anchors is greatest in
    size, of two alike the shorter, then the earlier. A span with fewer than ``LEAST`` pairs
    at every lag, or without variance, has no row."""
    sums = lag_sums(left, right, key, lags, anchors, size)
    n = F.col("n")
    cov, va, vb = (F.col(p) - F.col(x) * F.col(y) / n for p, x, y in (("ab", "a", "b"), ("aa", "a", "a"), ("bb", "b", "b")))
    good = sums.filter(n >= LEAST).withColumn("va", va).withColumn("vb", vb).filter("va > 1e-30 and vb > 1e-30")
    seen = good.withColumn("correlation", cov / F.sqrt("va") / F.sqrt("vb")).filter("correlation <> 0")
    best = F.max_by(F.struct("lag", "correlation", n.cast("long").alias("pairs")), F.struct(F.round(F.abs("correlation"), 12), -F.abs("lag"), -F.col("lag")))
    return seen.groupBy(*key).agg(best.alias("best")).select(*key, "best.*")
