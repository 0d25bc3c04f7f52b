"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors of cosine t or more lie within eps = sqrt(2 - 2t). Projected on the leading
principal axes distances only shrink, so vectors further apart there cannot link. Each
label's distinct vectors are sorted by their eps-wide grid cells on those axes and cut into
blocks. Sequence intervals are joined recursively, from a label's whole sequence down to
pairs of blocks and, inside a task, of shorter runs; pairs whose boxes lie further apart
than eps are skipped. What is left is compared in double precision.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.common import column, discard, settle
from gaugeworks.llm.groups import blocks_of, components, with_group

THRESHOLD = 0.98
#: Leading axes, vectors in a block, vectors in the shortest run that is compared whole.
AXES, BLOCK, RUN = 8, 1024, 128
#: Vectors on which the axes are fitted, at most. Links don't depend on the axes.
SAMPLE = 2048
#: What rounding may add to a distance.
SLACK = 1e-6


def _vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, fp, grp, data): fp names label and vector and is null for what links with
    nothing; grp is label and dimension; data has the components in their own precision."""
    wide = "<f4" if isinstance(rows.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"
    schema = T.StructType(
        [T.StructField("vec_id", rows.schema[id_col].dataType), T.StructField("fp", T.BinaryType()), T.StructField("grp", T.StringType()), T.StructField("data", T.BinaryType())]
    )

    def read(batches):
        for batch in batches:
            fps, groups, data = [], [], []
            for vector, label in zip(batch.column(1), batch.column(2).to_pylist()):
                fp = grp = kept = None
                values = vector.values
                if label is not None and values is not None and len(values) and values.null_count == 0:
                    v = values.to_numpy(zero_copy_only=False).astype(wide) + 0.0
                    if np.isfinite(v).all() and v.any():
                        kept, grp = v.astype(wide).tobytes(), f"{label}:{len(v)}"
                        fp = hashlib.blake2b(grp.encode() + b"|" + kept, digest_size=16).digest()
                fps.append(fp)
                groups.append(grp)
                data.append(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fps, pa.binary()), pa.array(groups, pa.string()), pa.array(data, pa.binary())], names=schema.names
            )

    return rows.select(column(id_col), column(vector_col), column(label_col).cast("string")).mapInArrow(read, schema), wide


def unit(data: list, wide: str) -> np.ndarray:
    """Unit vectors, scaled by their largest component first, so that no square over- or underflows."""
    v = np.frombuffer(b"".join(data), wide).reshape(len(data), -1).astype(np.float64)
    # by a power of two, which rounds nothing; in two halves, as the whole may not be a number
    power = -np.frexp(np.abs(v).max(1, keepdims=True))[1]
    v = np.ldexp(np.ldexp(v, power // 2), power - power // 2)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def leading_axes(classes: DataFrame, wide: str, axes: int) -> np.ndarray:
    """(dimension, axes) orthonormal axes of a bounded sample; the commonest dimension's."""
    rows = classes.select("data", F.length("data").alias("n")).orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()
    if not rows:
        return np.zeros((0, axes))
    sizes = [r["n"] for r in rows]
    most = max(sorted(set(sizes)), key=sizes.count)
    v = unit([r["data"] for r in rows if r["n"] == most], wide)
    _, _, axis = np.linalg.svd(v - v.mean(0), full_matrices=False)
    found = axis[:axes].T
    return np.pad(found, ((0, 0), (0, axes - found.shape[1])))


def project(v: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return v @ axes if v.shape[1] == axes.shape[0] else np.zeros((len(v), axes.shape[1]))


def _box_gap(lo, hi, lo2, hi2) -> float:
    return float(np.sqrt((np.maximum(0, np.maximum(lo2 - hi, lo - hi2)) ** 2).sum()))


def run_pairs(p: np.ndarray, q: np.ndarray, eps: float, same: bool):
    """Pairs of runs of two blocks (slices), by recursive halving, that may hold links."""
    todo = [(0, len(p), 0, len(q))]
    while todo:
        a, b, c, d = todo.pop()
        if same and c < a:
            continue
        x, y = p[a:b], q[c:d]
        if _box_gap(x.min(0), x.max(0), y.min(0), y.max(0)) > eps:
            continue
        if max(b - a, d - c) <= RUN:
            yield a, b, c, d
            continue
        # halves at multiples of RUN, so that two runs are the same or apart
        cut = lambda s, e: [(s, e)] if e - s <= RUN else [(s, m := s + RUN * max(1, (e - s) // RUN // 2)), (m, e)]
        todo += [(*i, *j) for i in cut(a, b) for j in cut(c, d)]


def join_blocks(x, y, p, q, weight_x, weight_y, same: bool, threshold: float, eps: float):
    """Linked weight of each row of x and of y, and (x row, y row) of every link."""
    count_x, count_y, links = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), []
    for a, b, c, d in run_pairs(p, q, eps, same):
        near = x[a:b] @ y[c:d].T >= threshold
        if same and a == c:
            near &= ~np.tri(b - a, d - c, dtype=bool)
        i, j = np.nonzero(near)
        if len(i):
            i, j = i + a, j + c
            np.add.at(count_x, i, weight_y[j])
            np.add.at(count_y, j, weight_x[i])
            links.append((i, j))
    if not links:
        return count_x, count_y, (np.zeros(0, np.int64),) * 2
    return count_x, count_y, tuple(np.concatenate(s) for s in zip(*links))


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for nodes other than their root, from links among n nodes."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            node = np.flatnonzero(label != np.arange(n))
            return node, label[node]
        label = new


def _interval_pairs(boxes: DataFrame, eps: float, axes: int) -> DataFrame:
    """(grp, i, j), i <= j: the pairs of blocks, by sequence number, that may hold links."""
    top = boxes.agg(F.max("seq").alias("n")).first()["n"]
    if top is None:
        return boxes.select("grp", F.col("seq").alias("i"), F.col("seq").alias("j"))
    levels = int(top).bit_length()
    lo, hi = (F.array(*[agg(F.col(c)[k]) for k in range(axes)]).alias(c) for agg, c in ((F.min, "lo"), (F.max, "hi")))
    tree = settle(
        boxes.select("grp", "lo", "hi", "seq", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
        .withColumn("idx", F.expr("shiftright(seq, level)"))
        .groupBy("grp", "level", "idx")
        .agg(lo, hi)
    )
    side = lambda level, k: tree.filter(F.col("level") == level).select("grp", F.col("idx").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("lo", "hi")])
    gap = sum(
        (F.pow(F.greatest(F.lit(0.0), F.col("lo_j")[k] - F.col("hi_i")[k], F.col("lo_i")[k] - F.col("hi_j")[k]), F.lit(2.0)) for k in range(axes)),
        F.lit(0.0),
    )
    pairs = boxes.select("grp", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")).distinct()
    for level in range(levels - 1, -1, -1):
        halves = F.array(*[F.struct((F.col("i") * 2 + a).alias("i"), (F.col("j") * 2 + b).alias("j")) for a in (0, 1) for b in (0, 1)])
        split = pairs.select("grp", F.inline(halves)).filter("i <= j")
        fewer = settle(split.join(side(level, "i"), ["grp", "i"]).join(side(level, "j"), ["grp", "j"]).filter(gap <= eps * eps).select("grp", "i", "j"))
        discard(pairs)
        pairs = fewer
    discard(tree)
    return pairs


def near_vectors(
    rows: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label", threshold=THRESHOLD, axes=AXES, block=BLOCK
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Only vectors of one label and dimension link, at a cosine of ``threshold`` or more in
    double precision. A null label, and a vector that is null, empty, zero or holds a null
    or non-finite component, links with nothing. Rows that repeat are vectors of their own,
    linked with each other where the vector can link. Equal vectors of one label are joined
    once, with their number as weight, so groups of copies are never expanded. An empty
    table gives an empty result; further columns are ignored.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    read, wide = _vectors(rows, id_col, vector_col, label_col)
    read = settle(read)
    some = read.filter(F.col("fp").isNotNull())
    classes = settle(some.groupBy("fp").agg(F.first("grp").alias("grp"), F.first("data").alias("data"), F.count(F.lit(1)).alias("weight")))
    main = leading_axes(classes, wide, axes)
    cells = [f"c{k}" for k in range(axes)]

    def grid(batches):
        for batch in batches:
            data = batch.column(2).to_pylist()
            cell = np.zeros((len(data), axes), np.int32)
            for n in {len(d) for d in data}:
                at = [k for k, d in enumerate(data) if len(d) == n]
                cell[at] = np.floor(project(unit([data[k] for k in at], wide), main) / eps)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c) for c in cell.T.copy()]], names=[*batch.schema.names, *cells])

    gridded = classes.select("grp", "fp", "data", "weight").mapInArrow(grid, "grp string, fp binary, data binary, weight long, " + ", ".join(f"{c} int" for c in cells))
    cut = settle(blocks_of(gridded, ["grp"], [*cells, "fp"], block).drop(*cells))

    def box(batches):
        for batch in batches:
            ends = [(p.min(0).tolist(), p.max(0).tolist()) for p in (project(unit(d.as_py(), wide), main) for d in batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *[pa.array([e[k] for e in ends], pa.list_(pa.float64())) for k in (0, 1)]], names=["grp", "block", "lo", "hi"]
            )

    boxes = cut.select("grp", "block", "data").mapInArrow(box, "grp string, block long, lo array<double>, hi array<double>")
    number = F.row_number().over(W.partitionBy("grp").orderBy("block")) - 1
    boxes = settle(boxes.withColumn("seq", number.cast("long")))
    pairs = _interval_pairs(boxes, eps, axes)
    full = cut.join(boxes.select("grp", "block", "seq"), ["grp", "block"])
    left, right = (full.select("grp", F.col("seq").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("fp", "data", "weight")]) for k in ("i", "j"))
    joined = pairs.join(left, ["grp", "i"]).join(right, ["grp", "j"])

    def compare(batches):
        for batch in batches:
            for r in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                same = r["i"] == r["j"]
                x, y = (unit(r[f"data_{k}"], wide) for k in ("i", "j"))
                wx, wy = (np.array(r[f"weight_{k}"]) for k in ("i", "j"))
                cx, cy, (i, j) = join_blocks(x, y, project(x, main), project(y, main), wx, wy, same, threshold, eps)
                names = r["fp_i"] if same else r["fp_i"] + r["fp_j"]
                count = cx + cy if same else np.concatenate([cx, cy])
                node, root = forest(i, j if same else j + len(x), len(names))
                to = dict(zip(node.tolist(), root.tolist()))
                hit = np.flatnonzero(count).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[k] for k in hit], pa.binary()),
                        pa.array([names[to[k]] if k in to else None for k in hit], pa.binary()),
                        pa.array(count[hit], pa.int64()),
                    ],
                    names=["a", "b", "n"],
                )

    found = settle(joined.mapInArrow(compare, "a binary, b binary, n long"))
    counts = found.groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("far"))
    nodes = components(found.filter("b is not null").select("a", "b"))
    linked = counts.join(nodes.withColumnRenamed("node", "fp"), "fp", "full")
    linked = settle(classes.select("fp", "weight").join(linked, "fp", "left").select("fp", (F.col("weight") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), F.coalesce("root", "fp").alias("root")))
    discard(cut, boxes, pairs, found, nodes, classes)
    placed = settle(some.select("vec_id", "fp").join(linked, "fp").select("vec_id", "n_links", "root"))
    placed = with_group(placed, ["root"], component_id=(F.min, F.min, "vec_id"))
    alone = read.filter(F.col("fp").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = placed.select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


