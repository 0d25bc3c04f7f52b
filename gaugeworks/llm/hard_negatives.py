"""Hard negatives by inner product over a pivot table.

Vectors are whole numbers. With M the greatest norm, a row x becomes (x, sqrt(M² - |x|²))
and an anchor q becomes (q, 0), so that their squared distance is |q|² + M² - 2 q·x: the
nearest row has the greatest inner product. A table holds each row's distances to a few
pivots. By the triangle inequality they bracket an anchor's distance to a row, and so its
score, without a look at the vectors; what the brackets leave is checked exactly.

Rows are cut into blocks of one label, near each other by their distances, and anchors into
blocks of their own. Pairs of blocks whose brackets can't hold a wanted score are never
joined. Within a task, the row blocks of one anchor block come in order of their best
possible score, so bounds tighten as it goes. Positives are found first; their scores are
the windows in which negatives are searched.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.common import column, discard, map_arrow, partitions, settle
from gaugeworks.llm.groups import blocks_of

POSITIVES, NEGATIVES = 5, 5
#: A negative's score, in hundredths of the positive's.
LOW, HIGH = 80, 100
#: Pivots, and rows among which they are drawn, at most. Results depend on neither.
PIVOTS, SAMPLE = 12, 1024
#: Rows in a block, anchors in a block, and row blocks that a task takes for an anchor block.
BLOCK, ANCHORS, SPAN = 2048, 512, 64
#: What rounding may add to a bracket, of the greatest squared norm.
SLACK = 1e-9
#: Below this, sums of products are whole in double precision.
WHOLE = 2.0**52
TOP = 2**63 - 1


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str, anchors: F.Column, scale: float = 256.0) -> DataFrame:
    """(row, vec_id, label, anchor, dim, norm, data) of the rows that take part: those with a
    label and a vector whose components are all finite numbers. data holds floor(scale * x)
    as doubles; norm is its squared length."""
    schema = "vec_id long, label string, anchor boolean, dim int, norm double, data binary"

    def read(batches):
        for batch in batches:
            keep, data, dims, norms = [], [], [], []
            for vector, label in zip(batch.column(1), batch.column(2).to_pylist()):
                values = vector.values
                v = None
                if label is not None and values is not None and values.null_count == 0:
                    v = values.to_numpy(zero_copy_only=False).astype(np.float64)
                    v = np.floor(v * scale) if np.isfinite(v).all() else None
                keep.append(v is not None)
                if v is not None:
                    data.append(v.tobytes())
                    dims.append(len(v))
                    norms.append(float(v @ v))
            some = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3)], names=["vec_id", "label", "anchor"]).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(dims, pa.int32()), pa.array(norms, pa.float64()), pa.array(data, pa.binary())], names=["vec_id", "label", "anchor", "dim", "norm", "data"])

    picked = rows.select(column(id_col).cast("long"), column(vector_col), column(label_col).cast("string"), F.coalesce(anchors, F.lit(False)))
    return settle(map_arrow(picked, read, schema).withColumn("row", F.monotonically_increasing_id()))


def pivots_of(vectors: DataFrame, dim: int, count: int) -> np.ndarray:
    """(pivots, dim) rows of a bounded sample, each the furthest from those before it."""
    rows = vectors.filter(F.col("dim") == dim).select("data").orderBy(F.xxhash64("row")).limit(SAMPLE).collect()
    v = matrix([r["data"] for r in rows])
    picked = [0]
    gap = ((v - v[0]) ** 2).sum(1)
    while len(picked) < min(count, len(v)) and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, ((v - v[picked[-1]]) ** 2).sum(1))
    return v[picked]


def pivot_distances(v: np.ndarray, last: np.ndarray, pivots: np.ndarray, pivot_last: np.ndarray) -> np.ndarray:
    """Distances of augmented vectors to augmented pivots."""
    return np.sqrt(((v[:, None, :] - pivots[None]) ** 2).sum(2) + (last[:, None] - pivot_last) ** 2)


def exact_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers; those beyond 64 bits stand at the last one."""
    if not x.size or not y.size:
        return np.zeros((len(x), len(y)), np.int64)
    if np.sqrt((x**2).sum(1).max() * (y**2).sum(1).max()) < WHOLE:
        return np.rint(x @ y.T).astype(np.int64)
    big = np.array([[int(c) for c in r] for r in x], object) @ np.array([[int(c) for c in r] for r in y], object).T
    return np.clip(big, -TOP, TOP).astype(np.int64)


def brackets(dq: np.ndarray, dx: np.ndarray, norm: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score of each anchor with each row, from pivot distances alone."""
    near = np.zeros((len(dq), len(dx)))
    far = np.full((len(dq), len(dx)), np.inf)
    for p in range(dq.shape[1]):
        a, b = dq[:, p : p + 1], dx[None, :, p]
        np.maximum(near, np.abs(a - b), out=near)
        np.minimum(far, a + b, out=far)
    half, slack = (norm[:, None] + top) / 2, SLACK * top + 1
    # scores stand at the last whole number, and so do their brackets
    return np.minimum(half - far**2 / 2 - slack, TOP), np.minimum(half - near**2 / 2 + slack, TOP)


class Best:
    """The best ``size`` rows of each of ``n`` lists: greatest score first, ties by the
    smaller id (none last), then by row number."""

    def __init__(self, n: int, size: int):
        self.lists: list[list[tuple]] = [[] for _ in range(n)]
        self.floor = np.full(n, -np.inf)
        self.size = size

    def add(self, k: int, scores: np.ndarray, at: np.ndarray, ids: list, rows: list) -> None:
        """Offers the rows at the places ``at``, with their scores, to list ``k``."""
        if len(scores) > self.size:
            some = scores >= np.partition(scores, len(scores) - self.size)[len(scores) - self.size]
            scores, at = scores[some], at[some]
        new = [(-v, ids[j] is None, ids[j] or 0, rows[j]) for v, j in zip(scores.tolist(), at.tolist())]
        self.lists[k] = sorted(self.lists[k] + new)[: self.size]
        if len(self.lists[k]) == self.size:
            self.floor[k] = -self.lists[k][-1][0]

    def found(self):
        """(list, score, id, row) of all that is held."""
        for k, best in enumerate(self.lists):
            for score, none, id_, row in best:
                yield k, -score, None if none else id_, row


def matrix(data: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(data), np.float64).reshape(len(data), len(data[0]) // 8)


def _survivors(possible: np.ndarray, x: np.ndarray, y: np.ndarray):
    """(anchor, places of its rows, their exact scores) of what the brackets leave."""
    q, r = np.flatnonzero(possible.any(1)), np.flatnonzero(possible.any(0))
    if len(q):
        scores = exact_scores(x[q], y[r])
        for k, a in enumerate(q.tolist()):
            at = possible[a, r]
            yield a, r[at], scores[k, at]


def _tasks(batches):
    """(anchor block, the row blocks that it meets) of a sorted stream, a block at a time."""
    rows = (batch.slice(k, 1).to_pylist()[0] for batch in batches for k in range(batch.num_rows))
    for _, stream in groupby(rows, lambda r: (r["q_block"], r["span"])):
        yield next(stream), stream


def _positives(batches, size: int):
    for q, blocks in _tasks(batches):
        x, dq, norm = matrix(q["data"]), matrix(q["table"]), np.array(q["norm"])
        label, own = np.array(q["label"], object), np.array(q["row"])
        best = Best(len(x), size)
        for r in blocks:
            if r["bound"] < best.floor.min():
                break  # the following blocks' bounds are lower still
            low, high = brackets(dq, matrix(r["table"]), norm, q["top"])
            possible = (high >= best.floor[:, None]) & (label == r["label"][0])[:, None] & (own[:, None] != np.array(r["row"])[None])
            for a, at, scores in _survivors(possible, x, matrix(r["data"])):
                best.add(a, scores, at, r["vec_id"], r["row"])
        found = list(best.found())
        yield pa.RecordBatch.from_arrays(
            [pa.array([c[k] for c in found] if k else [q["row"][c[0]] for c in found], pa.int64()) for k in range(4)], names=["q_row", "score", "vec_id", "row"]
        )


def _negatives(batches, size: int, low_share: int, high_share: int):
    for q, blocks in _tasks(batches):
        x, dq, norm = matrix(q["data"]), matrix(q["table"]), np.array(q["norm"])
        label = np.array(q["label"], object)
        lists = [(a, k, -(-low_share * v // 100), high_share * v // 100) for a, scores in enumerate(q["scores"]) for k, v in enumerate(scores)]
        of = [[n for n, c in enumerate(lists) if c[0] == a] for a in range(len(x))]
        floor, ceiling = np.array([c[2] for c in lists], np.float64), np.array([c[3] for c in lists], np.float64)
        first = np.array([c[0] for c in of])
        best = Best(len(lists), size)
        for r in blocks:
            least = np.minimum.reduceat(np.maximum(floor, best.floor), first)
            if r["bound"] < least.min():
                break
            low, high = brackets(dq, matrix(r["table"]), norm, q["top"])
            possible = (high >= least[:, None]) & (low <= np.maximum.reduceat(ceiling, first)[:, None]) & (label != r["label"][0])[:, None]
            for a, at, scores in _survivors(possible, x, matrix(r["data"])):
                for n in of[a]:
                    some = (scores >= max(lists[n][2], best.floor[n])) & (scores <= lists[n][3])
                    if some.any():
                        best.add(n, scores[some], at[some], r["vec_id"], r["row"])
        found = [(q["row"][lists[n][0]], lists[n][1], *rest) for n, *rest in best.found()]
        yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in found], pa.int64()) for k in range(5)], names=["q_row", "place", "score", "vec_id", "row"])


def _boxes(blocks: DataFrame, pivots: int) -> DataFrame:
    """(dim, block, labels, low_norm, high_norm, lo, hi): each block's range of distances."""

    def box(batches):
        for batch in batches:
            tables = [matrix(t) for t in batch.column(2).to_pylist()]
            ends = [pa.array([f(t, 0).tolist() for t in tables], pa.list_(pa.float64())) for f in (np.min, np.max)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *batch.columns[3:], *ends], names=["dim", "block", "labels", "low_norm", "high_norm", "lo", "hi"])

    facts = blocks.select("dim", "block", "table", F.array_distinct("label").alias("labels"), F.array_min("norm"), F.array_max("norm"))
    return facts.mapInArrow(box, "dim int, block long, labels array<string>, low_norm double, high_norm double, lo array<double>, hi array<double>")


def _block_pairs(q: DataFrame, rows: DataFrame, wanted: F.Column, top: float, spans: int) -> DataFrame:
    """(q_block, block, span, bound) of the pairs of blocks for which ``wanted`` holds, a
    condition on their boxes and on ``low`` and ``bound``, their least and greatest score."""
    salts = partitions(rows.sparkSession)
    left = q.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    right = rows.withColumn("salt", F.pmod("block", F.lit(salts)).cast("int"))
    right = right.select("dim", "salt", "block", "labels", "lo", "hi")
    pairs = left.join(right, ["dim", "salt"])
    near = F.array_max(F.zip_with(F.zip_with("lo", "q_hi", lambda a, b: a - b), F.zip_with("q_lo", "hi", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0))))
    far = F.array_min(F.zip_with("hi", "q_hi", lambda a, b: a + b))
    slack = SLACK * top + 1
    bound = (F.col("q_high") + top) / 2 - F.pow(F.coalesce(near, F.lit(0.0)), F.lit(2.0)) / 2 + slack
    least = F.coalesce((F.col("q_low") + top) / 2 - F.pow(far, F.lit(2.0)) / 2 - slack, F.lit(float("-inf")))
    pairs = pairs.withColumns({"bound": F.least(bound, F.lit(float(TOP))), "low": F.least(least, F.lit(float(TOP)))})
    return pairs.filter(wanted).select("q_block", "block", F.pmod(F.xxhash64("block"), F.lit(spans)).cast("int").alias("span"), "bound")


def _meet(pairs: DataFrame, anchors: DataFrame, rows: DataFrame, top: float) -> DataFrame:
    """Each anchor block, followed by its row blocks, the best bound first; a span's in one task."""
    blank = lambda kind: F.lit(None).cast(kind)
    names = ["row", "vec_id", "label", "norm", "data", "table"]
    met = pairs.hint("merge").join(rows, "block").select("q_block", "span", F.lit(1).alias("kind"), "bound", *names, blank("array<array<bigint>>").alias("scores"), blank("double").alias("top"))
    asked = pairs.select("q_block", "span").distinct().hint("merge").join(anchors.withColumnRenamed("block", "q_block"), "q_block")
    scores = F.col("scores") if "scores" in anchors.columns else blank("array<array<bigint>>")
    asked = asked.select("q_block", "span", F.lit(0).alias("kind"), blank("double").alias("bound"), *names, scores.alias("scores"), F.lit(top).alias("top"))
    return asked.unionByName(met).repartition(partitions(rows.sparkSession), "q_block", "span").sortWithinPartitions("q_block", "span", "kind", F.col("bound").desc())


def hard_negatives(
    rows: DataFrame, anchors: F.Column, id_col="vec_id", vector_col="embedding", label_col="label", positives=POSITIVES, negatives=NEGATIVES, low=LOW, high=HIGH, pivots=PIVOTS, block=BLOCK, anchor_block=ANCHORS
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each row for which ``anchors`` holds, its first ``positives`` other rows of the same
    label by whole-number inner product; for each of them the first ``negatives`` rows of
    other labels whose score lies within ``low`` and ``high`` hundredths of the positive's.
    Greater scores come first, ties by the smaller id, null ids last. Rows with a null label,
    a null vector or a null or non-finite component take no part; only vectors of one length
    are compared. Rows that repeat are other rows, as positives too, and an anchor that
    repeats is asked for as often. Scores beyond 64 bits stand at the last whole number. An
    empty table, or one without anchors, gives an empty result; further columns are ignored.
    """
    vectors = whole_vectors(rows, id_col, vector_col, label_col, anchors)
    common = vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    top = vectors.agg(F.max("norm")).first()[0] or 0.0
    dim = common["dim"] if common else 0
    points = pivots_of(vectors, dim, pivots) if common else np.zeros((0, 0))
    ends = np.sqrt(np.maximum(top - (points**2).sum(1), 0))

    def tabled(df: DataFrame, ask: bool) -> DataFrame:
        """With the pivot distances, the nearest pivot and the distance to it. Vectors of
        another length than the commonest have none, and are always checked."""

        def grid(batches):
            for batch in batches:
                table, near, gap = [], [], []
                for d, norm in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                    v = np.frombuffer(d, np.float64) if d else np.zeros(0)
                    last = np.array([0.0 if ask else np.sqrt(max(top - norm, 0))])
                    t = pivot_distances(v[None], last, points, ends)[0] if len(v) == dim and dim else np.zeros(0)
                    table.append(t.tobytes())
                    near.append(int(t.argmin()) if len(t) else 0)
                    gap.append(float(t.min()) if len(t) else 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(table, pa.binary()), pa.array(near, pa.int32()), pa.array(gap, pa.float64())], names=[*batch.schema.names, "table", "near", "gap"]
                )

        base = df.select("row", "vec_id", "label", "dim", "data", "norm")
        return base.mapInArrow(grid, "row long, vec_id long, label string, dim int, data binary, norm double, table binary, near int, gap double")

    cut = settle(blocks_of(tabled(vectors, False), ["dim", "label"], ["near", "gap", "row"], block).withColumn("label", F.array_repeat("label", F.size("row"))))
    asked = tabled(vectors.filter("anchor"), True)
    boxes = settle(_boxes(cut, pivots))
    spans = -(-boxes.count() // SPAN) or 1
    q_names = {"block": "q_block", "labels": "q_labels", "low_norm": "q_low", "high_norm": "q_high", "lo": "q_lo", "hi": "q_hi"}

    anchor_blocks = settle(blocks_of(asked, ["dim"], ["label", "near", "gap", "row"], anchor_block))
    q_boxes = settle(_boxes(anchor_blocks, pivots).withColumnsRenamed(q_names))
    pairs = settle(_block_pairs(q_boxes, boxes, F.array_contains("q_labels", F.col("labels")[0]), top, spans))
    found = _meet(pairs, anchor_blocks, cut, top).mapInArrow(lambda b: _positives(b, positives), "q_row long, score long, vec_id long, row long")
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("row")]
    ranked = found.withColumn("place", F.row_number().over(W.partitionBy("q_row").orderBy(*order)) - 1).filter(F.col("place") < positives)
    best = settle(ranked.select("q_row", "place", F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")))
    discard(pairs, q_boxes, anchor_blocks)

    windows = best.groupBy("q_row").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("found"))
    windows = windows.select("q_row", F.col("found.positive_score").alias("scores"), F.array_min("found.positive_score").alias("least"), F.array_max("found.positive_score").alias("most"))
    again = asked.join(windows, F.col("row") == F.col("q_row")).drop("q_row")
    anchor_blocks = settle(blocks_of(again, ["dim"], ["label", "near", "gap", "row"], anchor_block))
    reach = anchor_blocks.select(F.col("block").alias("q_block"), F.array_min("least").alias("least"), F.array_max("most").alias("most"))
    q_boxes = settle(_boxes(anchor_blocks, pivots).withColumnsRenamed(q_names).join(reach, "q_block"))
    apart = (F.size("q_labels") > 1) | (F.col("q_labels")[0] != F.col("labels")[0])
    # a window is empty below zero, so its ends may be taken of the least and the greatest score
    window = (F.col("bound") >= F.col("least") * (low / 100.0) - 1) & (F.col("low") <= F.col("most") * (high / 100.0) + 1)
    pairs = settle(_block_pairs(q_boxes, boxes, apart & window, top, spans))
    found = _meet(pairs, anchor_blocks, cut, top).mapInArrow(lambda b: _negatives(b, negatives, low, high), "q_row long, place long, score long, vec_id long, row long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("q_row", "place").orderBy(*order))).filter(F.col("rank") <= negatives)
    ranked = settle(ranked.select("q_row", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")))
    discard(pairs, q_boxes, anchor_blocks, boxes, cut)
    ids = vectors.filter("anchor").select(F.col("row").alias("q_row"), F.col("vec_id").alias("anchor_id"))
    out = ranked.join(best, ["q_row", "place"]).join(ids, "q_row")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
