"""Language identification by nearest centroid over hashed character n-grams.

A text is a normalised TF-IDF vector of its 1- to 3-grams over letters, hashed to ``DIM``
slots. Each language is described by a few centroids, clusters of its training vectors;
the language of the centroid with the largest cosine wins. A text further from every
centroid than training texts of its length ever are, by a wide margin, is rejected.

Document frequencies are counted over all training rows; the centroids are fitted on a
bounded sample of them (``Fit.per_language``, ``Fit.in_all``).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.common import column, map_arrow, pieces

DIM = 1 << 13
#: Documents, and characters, that are turned into vectors at a time; longer texts are counted in pieces.
BLOCK, PIECE = 128, 1 << 20
UNKNOWN = "und"


@dataclass(frozen=True)
class Fit:
    """How the classifier is fitted; the sample's bounds are documents. Where there are more
    than ``in_all`` languages, that many of those with most documents are learned."""

    per_language: int = 400
    in_all: int = 3000
    clusters: int = 4
    turns: int = 8
    #: A text is rejected below ``margin`` times the cosine that all but a share of ``strays`` of the training
    #: texts of its length reach.
    margin: float = 0.5
    strays: float = 0.01


@dataclass
class Model:
    languages: list = field(default_factory=list)
    idf: np.ndarray | None = None
    centroids: np.ndarray | None = None
    #: Index into ``languages`` of each centroid.
    owner: np.ndarray | None = None
    #: Least cosine accepted, by the binary logarithm of the number of n-grams.
    floor: np.ndarray | None = None


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([0xD800 <= c < 0xE000 or chr(c).isalpha() for c in range(0x110000)])


def _cut(text: str):
    """Pieces of a text, cut at white space where there is any near the end of a piece."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            end = max(text.rfind(" ", at + PIECE // 2, end), text.rfind("\n", at + PIECE // 2, end)) + 1 or end
        yield text[at:end]
        at = end


def grams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Counts (len(texts), DIM) of hashed n-grams, and whether each text has a letter. Of a
    text above ``PIECE`` characters the n-grams across its cuts are not counted."""
    if all(len(t) <= PIECE for t in texts):
        return _grams(texts)
    counts, has = np.zeros((len(texts), DIM), np.float32), np.zeros(len(texts), bool)
    for k, text in enumerate(texts):
        for part in _cut(text):
            c, h = _grams([part])
            counts[k] += c[0]
            has[k] |= h[0]
    return counts, has


def _grams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    rows = len(texts)
    has = np.zeros(rows, bool)
    lengths = np.zeros(rows, np.int64)
    parts = []
    for k, text in enumerate(texts):
        data = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        parts.append(data)
        lengths[k] = len(data)
    flat = np.concatenate(parts)
    letter = _letters()[flat]
    doc = np.repeat(np.arange(rows, dtype=np.int64), lengths)
    np.logical_or.at(has, doc[letter], True)
    # of each run of other characters one space is left
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    keep[starts] = True
    code = np.where(letter, flat, np.uint32(32))[keep].astype(np.uint64)
    doc = doc[keep]
    slot = np.zeros(0, np.int64)
    out = np.zeros(rows * DIM, np.float32)
    one = code * np.uint64(0x9E3779B97F4A7C15)
    two = (one[:-1] ^ (one[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + code[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + code[2:]
    for n, value in ((1, one), (2, two), (3, three)):
        if len(value) == 0:
            continue
        mixed = value * np.uint64(0xD6E8FEB86659FD93)
        slot = (mixed >> np.uint64(64 - 13)).astype(np.int64) + doc[: len(value)] * DIM
        inside = doc[: len(value)] == doc[n - 1 :]
        if n == 1:
            inside = inside & (code != 32)
        out += np.bincount(slot[inside], minlength=rows * DIM)
    return out.reshape(rows, DIM), has


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts)
    v *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    v /= np.maximum(norm, 1e-12)[:, None]
    return v


def held_out(id_col) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _frequencies(train: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """Number of texts and, for each slot, of texts that hold it, over all rows."""

    def count(batches):
        df, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for _, texts in pieces([t or "" for t in batch.column(0).to_pylist()], BLOCK, PIECE):
                counts, _ = grams(texts)
                df += (counts > 0).sum(0)
                n += len(texts)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([*range(DIM), DIM], pa.int32()), pa.array([*df.tolist(), n], pa.int64())], names=["slot", "n"])

    rows = train.select(column(text_col)).mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIM + 1, np.int64)
    for r in rows:
        df[r["slot"]] = r["n"]
    return int(df[DIM]), df[:DIM]


def _sample(train: DataFrame, id_col: str, text_col: str, lang_col: str, fit: Fit) -> list:
    """(lang, slots, counts) of the sampled texts, at most ``fit.in_all`` of them."""
    named = train.select(column(lang_col).cast("string").alias("lang"), column(text_col).alias("text"), F.coalesce(column(id_col).cast("string"), F.lit("")).alias("id"))
    most = named.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(fit.in_all).collect()
    sizes = {r["lang"]: r["n"] for r in most}
    if not sizes:
        return []
    each = min(fit.per_language, max(1, fit.in_all // len(sizes)))
    asked = {lang: min(1.0, 1.2 * each / n + 20 / n) for lang, n in sizes.items()}
    share = F.create_map(*[F.lit(x) for pair in asked.items() for x in pair])
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = named.select("lang", "text", draw.alias("draw")).filter((F.col("draw") < share[F.col("lang")]) & F.col("text").rlike(r"\p{L}"))
    # rows alike have one draw and may pass in any number: tasks keep the first few of each language
    place = F.row_number().over(W.partitionBy("lang").orderBy("draw"))
    picked = picked.withColumn("place", place).filter(F.col("place") <= each).drop("place")

    def sparse(batches):
        for batch in batches:
            langs, draws = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for at, texts in pieces([t or "" for t in batch.column(1).to_pylist()], BLOCK, PIECE):
                counts, has = grams(texts)
                for k in np.flatnonzero(has):
                    slots = np.flatnonzero(counts[k])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([langs[at + k]]), pa.array([draws[at + k]]), pa.array([slots.astype("<u2").tobytes()]), pa.array([counts[k][slots].astype("<f4").tobytes()])],
                        names=["lang", "draw", "slots", "counts"],
                    )

    rows = picked.mapInArrow(sparse, "lang string, draw double, slots binary, counts binary").collect()
    rows = sorted(rows, key=lambda r: (r["draw"], r["lang"], bytes(r["slots"]), bytes(r["counts"])))
    return [(r["lang"], np.frombuffer(r["slots"], "<u2"), np.frombuffer(r["counts"], "<f4")) for r in rows]


def cluster(v: np.ndarray, k: int, turns: int) -> np.ndarray:
    """Spherical k-means from far-apart starts; k unit centroids or fewer."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    seeds = [int(np.argmax(v @ unit(v.mean(0, keepdims=True))[0]))]
    near = v @ v[seeds[0]]
    while len(seeds) < min(k, len(v)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, v @ v[seeds[-1]])
    c = v[seeds].copy()
    for _ in range(turns):
        mine = np.argmax(v @ c.T, 1)
        c = unit(np.stack([v[mine == j].mean(0) if (mine == j).any() else c[j] for j in range(len(c))]))
    return c.astype(np.float32)


def train_model(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", fit: Fit = Fit()) -> Model:
    """Fit on the rows that are not held out and name a language; without any, the model
    knows no language and calls every text unknown. Null texts and languages teach nothing,
    letterless texts only how rare n-grams are; null ids are not held out; rows that repeat
    count each for itself; ties of language go to the first by name; further columns, of
    any name, are ignored."""
    train = docs.filter(column(lang_col).isNotNull() & column(text_col).isNotNull() & ~held_out(column(id_col)))
    sample = _sample(train, id_col, text_col, lang_col, fit)
    if not sample:
        return Model()
    n, df = _frequencies(train, text_col)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.1)
    languages = sorted({s[0] for s in sample})
    centroids, owner, cosines, sizes = [], [], [], []
    for j, lang in enumerate(languages):
        mine = [s for s in sample if s[0] == lang]
        counts = np.zeros((len(mine), DIM), np.float32)
        for k, (_, slots, c) in enumerate(mine):
            counts[k, slots] = c
        v = vectors(counts, idf)
        c = cluster(v, fit.clusters, fit.turns)
        centroids.append(c)
        owner += [j] * len(c)
        cosines.append((v @ c.T).max(1))
        sizes.append(counts.sum(1))
    cosine, size = np.concatenate(cosines), np.concatenate(sizes)
    floor, least = np.zeros(32), 0.0
    for b in range(32):
        mine = np.log2(np.maximum(size, 1)).astype(int) == b
        least = max(least, float(np.quantile(cosine[mine], fit.strays))) if mine.sum() >= 20 else least
        floor[b] = fit.margin * least
    return Model(languages, idf, np.concatenate(centroids), np.array(owner), floor)


def predict(model: Model, texts: list) -> tuple[list, list, list]:
    """(language, score, rejected) of each text; null and letterless texts are unknown and
    rejected, a text far from every centroid names the nearest language and is rejected."""
    langs, scores, rejected = [], [], []
    for _, block in pieces([t or "" for t in texts], BLOCK, PIECE):
        counts, has = grams(block)
        if not model.languages:
            has[:] = False
            best, who = np.zeros(len(block)), np.zeros(len(block), int)
            far = np.ones(len(block), bool)
        else:
            cosine = vectors(counts, model.idf) @ model.centroids.T
            nearest = np.argmax(cosine, 1)
            who = model.owner[nearest]
            best = np.clip(cosine[np.arange(len(block)), nearest], 0, 1)
            size = np.log2(np.maximum(counts.sum(1), 1)).astype(int)
            far = best < model.floor[np.minimum(size, 31)]
        langs += [model.languages[w] if h else UNKNOWN for w, h in zip(who, has)]
        scores += [float(b) if h else 0.0 for b, h in zip(best, has)]
        rejected += [bool(f or not h) for f, h in zip(far, has)]
    return langs, scores, rejected


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep_only: bool = False) -> DataFrame:
    """``docs`` with lang_pred, score and rejected, which replace columns of these names;
    with ``keep_only`` the accepted rows of ``docs``, columns unchanged.

    Every row is judged for itself: rows that repeat are judged alike, an empty table gives
    an empty result, other columns pass through.
    """
    added = ["lang_pred", "score", "rejected"]
    kept = [f for f in docs.schema.fields if keep_only or f.name not in added]
    schema = T.StructType(kept + ([] if keep_only else [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]))
    share = docs.sparkSession.sparkContext.broadcast(model)
    at = [f.name for f in kept].index(text_col)

    def judge(batches):
        for batch in batches:
            lang, score, rejected = predict(share.value, batch.column(at).to_pylist())
            if keep_only:
                accepted = batch.filter(pa.array([not r for r in rejected], pa.bool_()))
                yield pa.RecordBatch.from_arrays(accepted.columns, names=schema.names)
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=schema.names)

    return map_arrow(docs.select(*[column(f.name) for f in kept]), judge, schema)
