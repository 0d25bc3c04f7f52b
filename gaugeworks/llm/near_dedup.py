"""Near-duplicate documents by BagMinHash bands, verified on the shingle multisets.

1. Every text's bag of five-word shingles gives a fingerprint, band keys and a sketch.
   Texts with equal bags are one class; classes are the nodes from here on.
2. In each band bucket a hub, drawn by a hash, is paired with each other member; the pairs
   are verified on the bags, and components of the links found.
3. Buckets that still hold several components are cut into blocks by component, and a
   block compared with itself and the bucket's other blocks in numpy: pairs across
   components that a bound on their overlap doesn't rule out are verified too, the likeliest
   by their sketches first, unless links found in the task have joined them already. So
   every pair that a bucket brings together is linked, joined by other links, or found too
   far apart, and what leaves a task is a forest of links, never pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm import bagminhash as bag
from gaugeworks.llm.common import column, discard, keep_rows, pieces, row_keys, settle
from gaugeworks.llm.groups import blocks_of, components, with_group

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 26, 5
BLOCK = 64
#: Orders in which hubs are drawn: of one cluster's buckets about so many draw another hub.
DRAWS = 4
#: Texts, and characters, that are hashed at a time.
BATCH, CHARACTERS = 64, 1 << 20
#: Bins of the histograms that bound an overlap.
BINS = 1024


def sketches(docs: DataFrame, key: str, id_col: str, text_col: str, width: int) -> DataFrame:
    """(key, doc_id, fp, bands, sketch); the last three are null for texts without words."""
    schema = T.StructType(
        [
            T.StructField("key", docs.schema[key].dataType),
            T.StructField("doc_id", docs.schema[id_col].dataType),
            T.StructField("fp", T.BinaryType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
            T.StructField("sketch", T.BinaryType()),
        ]
    )

    def hash_(batches):
        for batch in batches:
            for at, texts in pieces([t or "" for t in batch.column(2).to_pylist()], BATCH, CHARACTERS):
                found = bag.bags(texts, width)
                sig = bag.signatures(found, BANDS * ROWS)
                keys, small = bag.bands(sig, ROWS), (sig & np.uint64(255)).astype(np.uint8)
                some = [len(x) > 0 for x, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        batch.column(1).slice(at, len(texts)),
                        pa.array([bag.fingerprint(b) if s else None for b, s in zip(found, some)], pa.binary()),
                        pa.array([k if s else None for k, s in zip(keys, some)], pa.list_(pa.int64())),
                        pa.array([k.tobytes() if s else None for k, s in zip(small, some)], pa.binary()),
                    ],
                    names=schema.names,
                )

    return docs.select(column(key).alias("key"), column(id_col).alias("doc_id"), column(text_col).alias("text")).mapInArrow(hash_, schema)


def shingle_sets(docs: DataFrame, wanted: DataFrame, key: str, text_col: str, width: int) -> DataFrame:
    """(fp, bag) of the wanted classes (fp, key), read off one text each. Texts are always
    joined by a shuffle, at any size, for the wanted keys grow with the corpus."""
    here = docs.select(column(key).alias("_id"), column(text_col).alias("_text"))
    texts = here.join(wanted.hint("merge"), here["_id"].eqNullSafe(wanted["key"])).select("fp", "_text")

    def hash_(batches):
        for batch in batches:
            for at, some in pieces([t or "" for t in batch.column(1).to_pylist()], BATCH, CHARACTERS):
                packed = [bag.pack_bag(b) for b in bag.bags(some, width)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), pa.array(packed, pa.binary())], names=["fp", "bag"])

    return texts.mapInArrow(hash_, "fp binary, bag binary")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The links among ``pairs`` (a, b): those whose bags overlap by the threshold."""
    left, right = (sets.select(F.col("fp").alias(k), F.col("bag").alias(f"bag_{k}")) for k in ("a", "b"))

    def check(batches):
        for batch in batches:
            a, b, x, y = batch.columns
            fits = [bag.packed_similarity(x[i].as_py(), y[i].as_py()) >= threshold for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(fits, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "bag_a", "bag_b")
    return joined.mapInArrow(check, "a binary, b binary")


def _hub_pairs(buckets: DataFrame) -> DataFrame:
    """(a, b), a < b: each member of a bucket with the bucket's hub, each pair once."""
    draw = F.xxhash64(F.pmod("key", F.lit(DRAWS)), "fp")
    drawn = buckets.select("key", "fp", F.struct(draw.alias("draw"), "fp").alias("me"))
    found = with_group(drawn, ["key"], hub=(F.min, F.min, "me"))
    pairs = found.select(F.least("fp", "hub.fp").alias("a"), F.greatest("fp", "hub.fp").alias("b"))
    return pairs.filter("a <> b").distinct()


_SIDE = ["ends", "root", "fp", "sketch", "bands", "bag"]


def _open_blocks(buckets: DataFrame, nodes: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """The buckets that hold several components, in blocks sorted by component."""
    rows = settle(buckets.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root")))
    spread = with_group(rows, ["key"], low=(F.min, F.min, "root"), high=(F.max, F.max, "root"))
    rest = spread.filter("low <> high").select("key", "fp", "root")
    rest = rest.join(classes.select("fp", "sketch", "bands"), "fp").join(sets, "fp").select("key", "root", "fp", "sketch", "bands", "bag")
    out = settle(blocks_of(rest, ["key"], ["root", "fp"], BLOCK).withColumn("ends", F.array(F.array_min("root"), F.array_max("root"))))
    discard(rows)
    return out


def _cross_links(blocks: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between the roots of components that share a bucket. Most buckets are
    one block, and only those of several blocks are joined."""
    several = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    left = blocks.join(several, "key").select("key", "block", *_SIDE)
    right = blocks.join(several, "key").select("key", *[F.col(c).alias(f"{c}_2") for c in ("block", *_SIDE)])
    # blocks of one component, the same, need no comparison
    alike = (F.col("ends") == F.col("ends_2")) & (F.col("ends")[0] == F.col("ends")[1])
    two = left.join(right, "key").filter((F.col("block") < F.col("block_2")) & ~alike)

    def within(batches):
        for row in _rows(batches):
            yield _batch(_links_of(row["key"], row, row, threshold))

    def across(batches):
        for row in _rows(batches):
            yield _batch(_links_of(row["key"], row, {c: row[f"{c}_2"] for c in _SIDE}, threshold))

    one = blocks.filter(F.col("ends")[0] != F.col("ends")[1]).select("key", *_SIDE).mapInArrow(within, "a binary, b binary")
    return one.unionByName(two.mapInArrow(across, "a binary, b binary"))


def _rows(batches):
    """A batch's rows one at a time: each holds one or two blocks."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _batch(links: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], names=["a", "b"])


def possible(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of packed bags may reach the threshold: the sum over bins of the lesser
    count bounds what they share."""
    count = lambda bags: np.stack([np.bincount(x >> np.uint32(22), minlength=BINS) for x in bags]).astype(np.int32)
    p, q = count(left), count(right)
    both = np.stack([np.minimum(row, q).sum(1) for row in p])
    whole = p.sum(1)[:, None] + q.sum(1)[None, :] - both
    return both >= threshold * whole - 1e-9


def _links_of(key: int, x: dict, y: dict, threshold: float) -> list[tuple]:
    """A forest of links between the components of two blocks of a bucket, or of one block
    twice. A pair that an earlier band brings together is left to that band."""
    sketch = [np.frombuffer(b"".join(s["sketch"]), np.uint8).reshape(len(s["sketch"]), -1) for s in (x, y)]
    bands = [np.array(s["bands"]) for s in (x, y)]
    bags = [[np.frombuffer(b, "<u4") for b in s["bag"]] for s in (x, y)]
    roots = {v: k for k, v in enumerate(dict.fromkeys(x["root"] + y["root"]))}
    of_x, of_y = (np.array([roots[v] for v in s["root"]]) for s in (x, y))
    here = int(np.argmax(bands[0][0] == key))
    earlier = (bands[0][:, None, :here] == bands[1][None, :, :here]).any(2)
    ask = (of_x[:, None] != of_y[None, :]) & ~earlier & possible(*bags, threshold)
    i, j = np.nonzero(np.triu(ask) if x is y else ask)
    agree = (sketch[0][i] == sketch[1][j]).mean(1)
    order = np.argsort(-agree, kind="stable")
    joined = list(range(len(roots)))

    def top(k):
        while joined[k] != k:
            joined[k] = joined[joined[k]]
            k = joined[k]
        return k

    links = []
    for a, b in zip(i[order].tolist(), j[order].tolist()):
        u, v = top(of_x[a]), top(of_y[b])
        if u != v and bag.overlap(bags[0][a], bags[1][b]) >= threshold:
            joined[v] = u
            links.append((x["root"][a], y["root"][b]))
    return links


def near_dedup(docs: DataFrame, id_col="doc_id", text_col="text", width=WIDTH, threshold=THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, group_id, group_size, kept.

    ``group_id`` is the least doc_id of the rows that links of similarity ``threshold`` or
    more connect (null ids count only where all are null); the row with that id stays (one
    of them, where rows repeat). Similarity is the weighted Jaccard similarity of the
    shingle multisets. Texts without words, null and empty ones among them, link with
    nothing and stay, each a group of its own. An empty table gives an empty result;
    further columns, of any name, are ignored.
    """
    keyed, key = row_keys(docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text")), "doc_id")
    return _grouped(keyed, key, "doc_id", "text", width, threshold).drop("key")


def _grouped(keyed: DataFrame, key: str, id_col: str, text_col: str, width: int, threshold: float) -> DataFrame:
    """``near_dedup`` of rows that ``key`` names, with the key."""
    rows = settle(sketches(keyed, key, id_col, text_col, width))
    some = rows.filter(F.col("fp").isNotNull())
    classes = settle(some.groupBy("fp").agg(F.min("key").alias("key"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    every = classes.select("fp", F.explode("bands").alias("key"))
    shared = settle(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    buckets = settle(every.join(shared, "key").select("key", "fp"))
    discard(shared)

    # every text that a bucket holds is read again once, for its bag
    members = settle(buckets.select("fp").distinct().join(classes.select("fp", "key"), "fp"))
    sets = settle(shingle_sets(keyed, members, key, text_col, width))
    links = settle(verified(_hub_pairs(buckets), sets, threshold))
    nodes = components(links)
    blocks = _open_blocks(buckets, nodes, classes, sets)
    discard(members, sets, buckets, classes, links)
    more = settle(_cross_links(blocks, threshold))
    above = components(more)
    discard(blocks, more)

    grouped = some.select("key", "doc_id", "fp").join(nodes.withColumnRenamed("node", "fp"), "fp", "left")
    grouped = grouped.select("key", "doc_id", F.coalesce("root", "fp").alias("root"))
    top = above.select(F.col("node").alias("root"), F.col("root").alias("top"))
    grouped = settle(grouped.join(top, "root", "left").select("key", "doc_id", F.coalesce("top", "root").alias("root")))
    discard(nodes, above)
    grouped = grouped.withColumn("me", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    placed = with_group(grouped, ["root"], low=(F.min, F.min, "me"), group_size=(F.count, F.sum, "root"))
    linked = placed.select("key", "doc_id", F.col("low.doc_id").alias("group_id"), "group_size", (F.col("me") == F.col("low")).alias("kept"))
    alone = rows.filter(F.col("fp").isNull()).select("key", "doc_id", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


def keep_near_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_dedup`` keeps, all columns as they were; ties, nulls,
    repeated rows and empty tables as there."""
    keyed, key = row_keys(docs, id_col)
    decided = _grouped(keyed, key, id_col, text_col, WIDTH, THRESHOLD)
    return keep_rows(keyed, key, decided.select(F.col("key").alias("doc_id"), "kept"))
