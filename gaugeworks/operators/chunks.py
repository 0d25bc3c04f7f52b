"""Long series over many tasks: chunks with overlap, and states carried from chunk to chunk.

A recording comes as blocks of samples of any length. ``chunks`` cuts it anew, each chunk
with what it needs of its neighbours, so that anything that looks a bounded way back and
ahead (frames, interpolation, convolution) is one task a chunk. What depends on all that
went before, a filter's state, is linear in the state at a chunk's start: ``filtered`` runs
every chunk from rest, passes the few numbers that are left of it from chunk to chunk, and
runs the chunks again from the states they really start in. No task holds a series.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gaugeworks.operators import kernels as K

#: Samples that a chunk owns, unless asked otherwise.
SIZE = 1 << 16


def chunks(blocks: DataFrame, key: list[str], size: int = SIZE, before: int = 0, after: int = 0, keep: list[str] = ()) -> DataFrame:
    """(key, keep, chunk, first, own, samples) of blocks (key, start_frame, samples).

    Chunk c owns the samples c * size up to (c + 1) * size and also holds ``before`` and
    ``after`` samples of its neighbours, where there are any. ``first`` is the place in the
    series of the first sample held, ``own`` how many it owns. Blocks of a series lie next to
    each other from 0; empty ones count for nothing. ``keep`` names columns with one value a
    series. A block is sliced where it lies, so only samples and their overlaps move.
    """
    end = F.col("start_frame") + F.size("samples")
    low = F.greatest(F.lit(0), F.floor((F.col("start_frame") - after) / size)).cast("long")
    high = F.floor((end - 1 + before) / size).cast("long")

    def part(c):
        at = F.greatest(F.col("start_frame"), c * size - before)
        return F.struct(c.alias("chunk"), at.alias("at"), F.slice("samples", (at - F.col("start_frame") + 1).cast("int"), (F.least(end, (c + 1) * size + after) - at).cast("int")).alias("part"))

    some = blocks.filter(F.size("samples") > 0)
    parts = some.select(*key, *keep, F.explode(F.transform(F.sequence(low, high), part)).alias("p")).select(*key, *keep, "p.*")
    held = parts.groupBy(*key, "chunk").agg(*[F.first(c).alias(c) for c in keep], F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))
    first, samples = F.col("parts")[0]["at"], F.flatten("parts.part")
    whole = held.select(*key, *keep, "chunk", first.alias("first"), samples.alias("samples"))
    own = F.least(F.col("first") + F.size("samples"), (F.col("chunk") + 1) * size) - F.col("chunk") * size
    return whole.withColumn("own", own.cast("int")).filter("own > 0").select(*key, *keep, "chunk", "first", "own", "samples")


def own_part(samples: np.ndarray, first: int, chunk: int, size: int, own: int) -> slice:
    """Where the samples that a chunk owns lie among those that it holds."""
    at = chunk * size - first
    return slice(at, at + own)


def arrays(column: pa.Array) -> list[np.ndarray]:
    """The lists of an Arrow column as numpy views."""
    return [v.values.to_numpy(zero_copy_only=False) if v.values is not None else np.zeros(0) for v in column]


def running(parts: DataFrame, key: list[str], order: str, state: str, start, step) -> DataFrame:
    """The state before each part: (key, order, state), state an array of doubles.

    ``start(row)`` is the state before a series' first part, ``step(state, row)`` that behind
    a part. Parts are small rows, read one after the other; only the state is held.
    """
    schema = T.StructType([*[parts.schema[c] for c in (*key, order)], T.StructField(state, T.ArrayType(T.DoubleType()))])
    types = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches):
        rows = (r for batch in batches for r in batch.to_pylist())
        done: list = []

        def flush():
            columns = [pa.array(c, t) for c, t in zip(zip(*done), types)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for _, series in groupby(rows, lambda r: [r[c] for c in key]):
            now = None
            for r in series:
                now = start(r) if now is None else now
                done.append((*[r[c] for c in (*key, order)], [float(v) for v in now]))
                now = step(now, r)
                if len(done) == 4096:
                    yield flush()
        if done:
            yield flush()

    return parts.repartition(*key).sortWithinPartitions(*key, order).mapInArrow(run, schema)


class Cascade:
    """Second-order sections one after the other; the state is two numbers a section."""

    def __init__(self, sections: list[tuple[np.ndarray, np.ndarray]]):
        self.sections = [(np.asarray(b, float) / a[0], np.asarray(a, float) / a[0]) for b, a in sections]

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(output, state at the end) from ``state`` on."""
        out = np.zeros(2 * len(self.sections))
        for k, (b, a) in enumerate(self.sections):
            x, out[2 * k : 2 * k + 2] = K.biquad(x, b, a, state[2 * k : 2 * k + 2])
        return x, out

    def transition(self, n: int) -> np.ndarray:
        """What ``n`` samples of silence make of a state, as a matrix."""
        size = 2 * len(self.sections)
        step = np.zeros((size, size))
        feed = np.zeros(size)  # the section's input, as a row over states
        for k, (b, a) in enumerate(self.sections):
            at = 2 * k
            step[at : at + 2] += np.outer([b[1] - a[1] * b[0], b[2] - a[2] * b[0]], feed)
            step[at : at + 2, at : at + 2] += [[-a[1], 1.0], [-a[2], 0.0]]
            feed = b[0] * feed
            feed[at] += 1.0
        return np.linalg.matrix_power(step, n)


def k_weighting(rate: float) -> Cascade:
    return Cascade(K.k_sections(rate))


def states(pieces: DataFrame, key: list[str], size: int, system) -> DataFrame:
    """(key, chunk, state): the state of ``system(rate)`` where each chunk of ``pieces``
    begins. Needs the columns rate, chunk, first, own and samples."""
    rested = T.StructType([*[pieces.schema[c] for c in (*key, "rate", "chunk", "own")], T.StructField("pushed", T.ArrayType(T.DoubleType()))])

    def push(batches):
        for batch in batches:
            rate, chunk, first, own = (batch.column(c).to_pylist() for c in ("rate", "chunk", "first", "own"))
            out = []
            for k, x in enumerate(arrays(batch.column("samples"))):
                cascade = system(float(rate[k]))
                out.append(cascade.run(x[own_part(x, first[k], chunk[k], size, own[k])], np.zeros(2 * len(cascade.sections)))[1].tolist())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*key, "rate", "chunk", "own")], pa.array(out, pa.list_(pa.float64()))], names=rested.names)

    def start(row):
        return np.zeros(len(row["pushed"]))

    def step(state, row):
        return system(float(row["rate"])).transition(row["own"]) @ state + np.array(row["pushed"])

    pushed = pieces.select(*key, "rate", "chunk", "first", "own", "samples").mapInArrow(push, rested)
    return running(pushed, key, "chunk", "state", start, step)


def filtered(pieces: DataFrame, key: list[str], size: int = SIZE, system=k_weighting) -> DataFrame:
    """``pieces`` (of ``chunks``, with the column rate) with ``filtered``, the samples that each
    owns after the filter, as if the series had been filtered whole. Chunks are moved once:
    both passes read one exchange."""
    schema = T.StructType([*pieces.schema.fields, T.StructField("filtered", T.ArrayType(T.DoubleType()))])
    names = pieces.columns

    def run(batches):
        for batch in batches:
            rate, chunk, first, own, state = (batch.column(c).to_pylist() for c in ("rate", "chunk", "first", "own", "state"))
            out = [
                system(float(rate[k])).run(x[own_part(x, first[k], chunk[k], size, own[k])], np.array(state[k]))[0]
                for k, x in enumerate(arrays(batch.column("samples")))
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(out, pa.list_(pa.float64()))], names=schema.names)

    begun = states(pieces, key, size, system)
    return pieces.join(begun.hint("merge"), [*key, "chunk"]).select(*names, "state").mapInArrow(run, schema)


def convolved(blocks: DataFrame, key: list[str], taps: np.ndarray, size: int = SIZE, keep: list[str] = ()) -> DataFrame:
    """(key, keep, chunk, start_frame, samples): each series convolved with ``taps``, its tail
    included, by overlap-save: a chunk looks back as far as the taps reach, and its product
    of transforms is cut to what it owns."""
    taps = np.asarray(taps, float)
    reach = len(taps) - 1
    ends = blocks.filter(F.size("samples") > 0).groupBy(*key).agg(*[F.first(c).alias(c) for c in keep], F.max(F.col("start_frame") + F.size("samples")).alias("end"))
    # silence behind the end, so that the tail has a place
    hush = ends.select(*key, *keep, F.col("end").alias("start_frame"), F.array_repeat(F.lit(0.0), reach).alias("samples"))
    padded = blocks.select(*key, *keep, "start_frame", "samples").unionByName(hush)
    pieces = chunks(padded, key, size, before=reach, keep=keep)
    schema = T.StructType([*[pieces.schema[c] for c in (*key, *keep, "chunk")], T.StructField("start_frame", T.LongType()), T.StructField("samples", T.ArrayType(T.DoubleType()))])
    room = 1 << (size + 2 * reach).bit_length()

    def run(batches):
        gain = np.fft.rfft(taps, room)
        for batch in batches:
            chunk, first, own = (batch.column(c).to_pylist() for c in ("chunk", "first", "own"))
            out = []
            for k, x in enumerate(arrays(batch.column("samples"))):
                y = np.fft.irfft(np.fft.rfft(x, room) * gain, room)
                out.append(y[own_part(x, first[k], chunk[k], size, own[k])])
            starts = pa.array([c * size for c in chunk], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*key, *keep, "chunk")], starts, pa.array(out, pa.list_(pa.float64()))], names=schema.names)

    return pieces.mapInArrow(run, schema)
