"""Alignment of pairs of series with locked anchors: the stretches between are rows of their own."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.operators import kernels as K


def kept_anchors(anchors: DataFrame, key: list[str]) -> DataFrame:
    """(key, segment, i, j), numbered from 0: the anchors (key, i, j) that rise in both series.
    Of one i the least j counts; an anchor at or before an earlier one's j is left out."""
    one = anchors.filter("i is not null and j is not null").groupBy(*key, "i").agg(F.min("j").alias("j"))
    before = F.max("j").over(W.partitionBy(*key).orderBy("i").rowsBetween(W.unboundedPreceding, -1))
    rising = one.withColumn("top", before).filter("top is null or j > top")
    return rising.select(*key, (F.row_number().over(W.partitionBy(*key).orderBy("i")) - 1).alias("segment"), "i", "j")


def _stretches(rows: DataFrame, anchors: DataFrame, key: list[str], at: str) -> DataFrame:
    """``rows`` (key, n, ...) with ``segment``: how many anchors lie before n, and ``locked``:
    whether one lies on n. An anchored frame is the last of its segment."""
    rest = [c for c in rows.columns if c not in (*key, "n")]
    marks = anchors.select(*key, F.col(at).alias("n"), F.lit(1).alias("mark"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rest])
    both = rows.withColumn("mark", F.lit(0)).select(*key, "n", "mark", *rest).unionByName(marks.select(*key, "n", "mark", *rest))
    # a mark sorts behind the frame it is on
    w = W.partitionBy(*key).orderBy("n", "mark")
    passed = F.coalesce(F.sum("mark").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    locked = F.coalesce((F.lead("mark").over(w) == 1) & (F.lead("n").over(w) == F.col("n")), F.lit(False))
    return both.withColumns({"segment": passed.cast("int"), "locked": locked}).filter("mark = 0").drop("mark")


def align_pairs(left: DataFrame, right: DataFrame, key: list[str], cost, anchors: DataFrame | None = None, **options) -> DataFrame:
    """(key, segment, i, j, total): the cheapest path through each pair of series of frames
    (key, n, frame), frame a number or an array, from the first frames to the last.

    ``cost(x, y)`` prices all pairs of frames of two arrays. ``anchors`` (key, i, j) must
    match: they cut a pair into segments, each a row that any task aligns, within the
    corridors of ``kernels.align_coarse_to_fine``. ``total`` is the segment's, the match at
    its end included; a pair's is their sum. A segment without frames on one side has no
    matches and no rows but for its anchor's. Nulls in n or frame are refused by the kernel.
    """
    if anchors is not None:
        locked = kept_anchors(anchors, key)
        sides = [_stretches(s, locked, key, at) for s, at in ((left, "i"), (right, "j"))]
    else:
        sides = [s.withColumns({"segment": F.lit(0), "locked": F.lit(False)}) for s in (left, right)]
    by = [*key, "segment"]
    schema = T.StructType([*[left.schema[c] for c in key], *T.StructType.fromDDL("segment int, i long, j long, total double").fields])
    deep = isinstance(left.schema["frame"].dataType, T.ArrayType)
    frame = F.col("frame").cast("array<double>" if deep else "double").alias("frame")
    # a segment is a row: many short ones meet in a batch, where a group each would cost more than its path
    one, two = (s.select(*by, F.struct("n", frame, "locked").alias("at"), F.lit(k).alias("side")) for k, s in enumerate(sides))
    of = lambda k, name: F.sort_array(F.collect_list(F.when(F.col("side") == k, F.col("at")))).alias(name)
    held = one.unionByName(two).groupBy(*by).agg(of(0, "left"), of(1, "right")).filter("size(left) > 0 and size(right) > 0")

    def series(column):
        """(numbers, frames, whether the last is locked) of each row."""
        numbers, frames, locked = (pc.struct_field(column.values, c) for c in ("n", "frame", "locked"))
        if numbers.null_count:
            raise ValueError("a frame without its number")
        numbers, locked = numbers.to_numpy(zero_copy_only=False), locked.to_numpy(zero_copy_only=False)
        frames = frames if deep else frames.to_numpy(zero_copy_only=False)
        for a, b in pairwise(column.offsets.to_pylist()):
            yield numbers[a:b], np.array(frames[a:b].to_pylist(), float) if deep else frames[a:b], bool(locked[b - 1])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (list(series(batch.column(c))) for c in ("left", "right"))
            found = K.align_many([(x, y, p and q) for (_, x, p), (_, y, q) in zip(a, b)], cost, **options)
            paths = [np.array(path, int).reshape(-1, 2) for path, _ in found]
            of = pa.array(np.repeat(np.arange(len(found)), [len(p) for p in paths]))
            i, j = (np.concatenate([s[0][p[:, k]] for s, p in zip(sides, paths)]) for k, sides in ((0, a), (1, b)))
            total = pa.array([total for _, total in found], pa.float64()).take(of)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(of) for c in by], pa.array(i, pa.int64()), pa.array(j, pa.int64()), total], names=schema.names)

    return held.mapInArrow(run, schema)
