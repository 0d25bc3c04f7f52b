"""Document fingerprints: one-permutation MinHash of five-word shingles, in packed low bits.

Each shingle is hashed once. The leading bits of the hash name one of ``BINS`` bins, and a
bin keeps its least hash. An empty bin takes the hash of the first filled bin in an order
of its own (optimal densification: each empty bin draws a filled one evenly and apart from
all others). Of a bin's hash, mixed with the bin's number, the low ``BITS`` bits are stored.

Two texts agree in a bin with the probability of their Jaccard similarity, or else by
chance in one of ``2**BITS`` cases; ``likeness`` takes that chance out of the share of bins
that agree. As the bin's number is mixed in, chance hits of one borrowed hash in several
bins are apart from each other.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.bagminhash import mix, shingles
from gaugeworks.llm.common import column, map_arrow, partitions, pieces, settle

WIDTH = 5
#: Bins (a power of two) and bits that each stores: 256 bytes a text.
BINS, BITS = 512, 4
#: Texts, and characters, that are hashed at a time.
BATCH, CHARACTERS = 64, 1 << 20
_NONE = np.uint64(2**64 - 1)
#: Places of its order that an empty bin has looked at after each step; the last reaches to
#: its end. Places that are looked at together, in all bins.
_STEPS, _LOOK = (8, 32, 128), 1 << 17


@lru_cache(maxsize=4)
def _orders(bins: int) -> np.ndarray:
    """Row k: the order in which bin k looks for a filled one."""
    number = np.arange(bins * bins, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D)
    return mix(mix(number)).reshape(bins, bins).argsort(1).astype(np.int16)


def densify(least: np.ndarray) -> np.ndarray:
    """``least`` (texts, bins) with every empty bin filled, but for texts without a shingle."""
    filled, orders, out = least != _NONE, _orders(least.shape[1]), least.copy()
    row, bin_ = np.nonzero(~filled & filled.any(1, keepdims=True))
    at = 0
    for to in (*(s for s in _STEPS if s < least.shape[1]), least.shape[1]):
        rest, some = [], max(1, _LOOK // (to - at))
        for k in range(0, len(row), some):
            r, b = row[k : k + some], bin_[k : k + some]
            source = orders[b, at:to]
            found = filled[r[:, None], source]
            hit = found.any(1)
            first = source[np.arange(len(r)), found.argmax(1)]
            out[r[hit], b[hit]] = least[r[hit], first[hit]]
            rest.append(np.flatnonzero(~hit) + k)
        left = np.concatenate(rest) if rest else np.zeros(0, np.int64)
        row, bin_, at = row[left], bin_[left], to
    return out


def _pack(codes: np.ndarray, bits: int) -> np.ndarray:
    parts = codes.astype(np.uint8).reshape(len(codes), -1, 8 // bits)
    return (parts << (np.arange(8 // bits, dtype=np.uint8) * np.uint8(bits))).sum(2, dtype=np.uint8)


def _unpack(packed: list[bytes], bits: int) -> np.ndarray:
    data = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
    shifts = np.arange(8 // bits, dtype=np.uint8) * np.uint8(bits)
    return ((data[:, :, None] >> shifts) & np.uint8((1 << bits) - 1)).reshape(len(packed), -1)


def hash_texts(texts: list[str], width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> list[bytes]:
    """Each text's packed fingerprint; that of a text without words is empty."""
    if not texts:
        return []
    doc, h = shingles(texts, width)
    least = np.full(len(texts) * bins, _NONE)
    shift = np.uint64(64 - (bins.bit_length() - 1))
    np.minimum.at(least, doc * bins + (h >> shift).astype(np.int64), h)
    least = least.reshape(len(texts), bins)
    some = (least != _NONE).any(1)
    numbers = np.arange(bins, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    packed = _pack(mix(densify(least) ^ numbers) & np.uint64((1 << bits) - 1), bits)
    return [p.tobytes() if s else b"" for p, s in zip(packed, some)]


def likeness(left: list[bytes], right: list[bytes], bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of each pair of fingerprints, chance agreement taken out,
    from 0 to 1. Two without words are alike, one without words is like no other."""
    out = np.array([float(not a and not b) for a, b in zip(left, right)])
    at = [k for k, (a, b) in enumerate(zip(left, right)) if a and b]
    if at:
        agree = (_unpack([left[k] for k in at], bits) == _unpack([right[k] for k in at], bits)).mean(1)
        out[at] = np.clip((agree - 2.0**-bits) / (1 - 2.0**-bits), 0, 1)
    return out


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", width=WIDTH, bins=BINS, bits=BITS) -> DataFrame:
    """One row per input row: doc_id, n_chars, fingerprint (binary). No shuffle.

    Null texts count as empty; texts without words have an empty fingerprint; equal texts
    have equal ones. Repeated rows and ids are told apart by nothing and all returned; an
    empty table gives an empty result; further columns are ignored.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for at, texts in pieces([t or "" for t in batch.column(1).to_pylist()], BATCH, CHARACTERS):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array([len(t) for t in texts], pa.int64()), pa.array(hash_texts(texts, width, bins, bits), pa.binary())],
                    names=schema.names,
                )

    return map_arrow(docs.select(column(id_col), column(text_col)), run, schema)


def edited(text: str, next_text: str) -> str:
    """``text`` with its last half replaced by as much of the next text's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + next_text[:half]


_FACTS = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _facts(ids: pa.Array, texts: list[str], nexts: list[str], own: list[bytes], after: list[bytes]) -> list[pa.Array]:
    new = [edited(a, b) for a, b in zip(texts, nexts)]
    prints = hash_texts(new)
    return [
        ids,
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new], pa.string()),
        pa.array(own, pa.binary()),
        pa.array(prints, pa.binary()),
        pa.array(likeness(own, prints), pa.float64()),
        pa.array(likeness(own, after), pa.float64()),
    ]


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint and
    edited_fingerprint (hexadecimal), near_edited, near_next.

    Documents follow each other by id, null ids last, those of one id by a hash of their
    text; after the last comes the first, so a single document is its own next. Null texts
    count as empty. Texts move once, in a range sort by which no id, however common, is
    bound to one task. A task pairs the rows it holds; the last row of each is paired with
    the first row of the next task in a second step, over two rows a task. Empty tables give
    an empty result; further columns are ignored.
    """
    id_type = docs.schema[id_col].dataType
    here = docs.select(column(id_col).alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.col("row")]
    placed = here.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    schema = T.StructType([T.StructField("doc_id", id_type), *T.StructType.fromDDL(_FACTS + ", part int, edge int, text string").fields])

    def pair(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = None  # the last row so far: its id, text and fingerprint

        def edge(kind, row):
            ids, text, own = row
            gap = [pa.nulls(1, f) for f in (pa.int64(), pa.string())]
            arrays = [ids, *gap, pa.array([own], pa.binary()), pa.nulls(1, pa.binary()), *[pa.nulls(1, pa.float64())] * 2]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([text], pa.string())], names=schema.names)

        for batch in batches:
            for at, texts in pieces(batch.column(1).to_pylist(), BATCH, CHARACTERS):
                ids, own = batch.column(0).slice(at, len(texts)), hash_texts(texts)
                if held is None:
                    yield edge(0, (ids.slice(0, 1), texts[0], own[0]))
                else:
                    ids = pa.concat_arrays([held[0], ids])
                    texts, own = [held[1], *texts], [held[2], *own]
                n = len(texts) - 1
                if n:
                    arrays = _facts(ids.slice(0, n), texts[:-1], texts[1:], own[:-1], own[1:])
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array([part] * n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names=schema.names)
                held = ids.slice(n, 1), texts[n], own[n]
        if held is not None:
            yield edge(1, held)

    paired = settle(placed.select("doc_id", "text").mapInArrow(pair, schema))
    heads, tails = (paired.filter(F.col("edge") == k) for k in (0, 1))
    # one row for each task that held any rows
    parts = heads.select("part")
    following = F.lead("part").over(W.orderBy("part"))
    wrapped = F.coalesce(following, F.min("part").over(W.partitionBy()))
    after = parts.select("part", wrapped.alias("next"))
    begin = heads.select(F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("after"))
    last = tails.select("part", "doc_id", "text", "fingerprint").join(after, "part").join(begin, "next").select("doc_id", "text", "next_text", "fingerprint", "after")
    facts = T.StructType([T.StructField("doc_id", id_type), *T.StructType.fromDDL(_FACTS).fields])

    def finish(batches):
        for batch in batches:
            texts, nexts, own, then = (c.to_pylist() for c in batch.columns[1:])
            yield pa.RecordBatch.from_arrays(_facts(batch.column(0), texts, nexts, own, then), names=facts.names)

    out = paired.filter("edge is null").select(*facts.names).unionByName(last.mapInArrow(finish, facts))
    shown = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select("doc_id", "n_chars", "edited_sha256", shown("fingerprint"), shown("edited_fingerprint"), "near_edited", "near_next")
