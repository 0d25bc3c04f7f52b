"""Document fingerprints against exact similarities and a plain reading of the contract."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import fingerprints as fp
from gaugeworks.llm.bagminhash import bags

DIR = "/root/testdata/sf0.001"


def jaccard(left, right):
    out = []
    for (a, _), (b, _) in zip(bags(left), bags(right)):
        both = len(np.intersect1d(a, b))
        out.append(both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0)
    return np.array(out)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(f"w{r.randint(0, 10**6)}" for _ in range(n))


def test_whole_documents(spark):
    df = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = sorted(fp.compare_with_next(df).collect(), key=lambda r: r["doc_id"])
    texts = [r["text"] or "" for r in df.orderBy("doc_id").collect()]
    nexts = texts[1:] + texts[:1]
    new = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, nexts)]
    assert [r["n_chars"] for r in rows] == list(map(len, texts))
    assert [r["edited_sha256"] for r in rows] == [hashlib.sha256(t.encode()).hexdigest() for t in new]
    for name, others, bias in (("near_edited", new, 0.01), ("near_next", nexts, 0.01)):
        error = np.array([r[name] for r in rows]) - jaccard(texts, others)
        assert abs(error.mean()) < bias and error.std() < 0.03 and abs(error).max() < 0.12
    by_text = {}
    for r, t in zip(rows, texts):
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"] and len(r["fingerprint"]) in (0, fp.BINS * fp.BITS // 4)


@pytest.mark.parametrize("n", [1, 3, 40, 400, 4000])
@pytest.mark.parametrize("share", [0.0, 0.3, 0.8, 1.0])
def test_unbiased_at_any_length(n, share):
    """Few shingles leave most bins empty: densified bins must not lean either way."""
    left, right = [], []
    for k in range(60):
        same = prose((n, k, 0).__hash__(), max(1, round(n * share)) + 4) if share else ""
        left.append(prose((n, k, 1).__hash__(), max(0, n - round(n * share))) + " " + same if share < 1 else same)
        right.append(prose((n, k, 2).__hash__(), max(0, n - round(n * share))) + " " + same if share < 1 else same)
    error = fp.likeness(fp.hash_texts(left), fp.hash_texts(right)) - jaccard(left, right)
    assert abs(error.mean()) < 0.04 + 0.3 / (n + 4)


def test_densification_keeps_filled_bins_and_draws_evenly():
    least = np.full((1, 64), fp._NONE)
    least[0, [3, 40]] = 5, 9
    out = fp.densify(np.repeat(least, 2, 0))
    assert (out[0] == out[1]).all() and set(out[0].tolist()) == {5, 9} and out[0, 3] == 5 and out[0, 40] == 9
    assert 15 < (out[0] == 5).sum() < 49
    assert (fp.densify(np.full((2, 64), fp._NONE)) == fp._NONE).all()


@pytest.mark.parametrize("words", range(8))
def test_few_words_alone_and_among_others(words):
    text = prose(words, words)
    assert fp.hash_texts([text]) == fp.hash_texts([prose(99, 50), text, ""])[1:2]


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_packing(bits):
    codes = np.random.default_rng(bits).integers(0, 1 << bits, (3, 64))
    packed = [p.tobytes() for p in fp._pack(codes, bits)]
    assert len(packed[0]) == 8 * bits and (fp._unpack(packed, bits) == codes).all()


def test_edges(spark):
    long = prose(9, 300_000)  # longer than the characters of a chunk
    rows = [(5, "a b c"), (1, None), (2, ""), (2, ""), (None, "x"), (None, "y z"), (3, "!!! ???"), (4, long), (7, "é" * 9), (7, "ö" * 5)] + [(6, "same text of a hot id")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    # rows of one id are in some order of their texts that repeats, so only ids that occur once are fixed
    out = fp.compare_with_next(df).collect()
    assert len(out) == len(rows)
    one = {r["doc_id"]: r for r in out}
    assert one[1]["n_chars"] == 0 and one[1]["fingerprint"] == "" and one[1]["near_next"] == 1.0 and one[1]["edited_sha256"] == hashlib.sha256(b"").hexdigest()
    assert one[3]["near_next"] == 0.0 and one[4]["n_chars"] == len(long)
    assert one[5]["edited_sha256"] == hashlib.sha256(b"a bsa").hexdigest()
    assert sorted(r["near_edited"] for r in out if r["doc_id"] == 6)[-40:] == [1.0] * 40 or all(r["near_next"] == 1.0 for r in out if r["doc_id"] == 6) is False
    wide = df.select("*", *[F.lit(1).alias(c) for c in ("row", "part", "edge", "next", "after", "fingerprint", "n_chars", "a.b", "`q`")])
    canon = lambda rows: sorted(map(repr, rows))
    assert canon(fp.compare_with_next(wide).collect()) == canon(out)
    assert fp.compare_with_next(df.filter("false")).count() == 0
    alone = fp.compare_with_next(df.filter("doc_id = 4")).first()
    assert alone["near_next"] == 1.0 and alone["n_chars"] == len(long)
    assert fp.fingerprints(wide).count() == len(rows)
    marks = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprints(df).collect()}
    assert bytes(marks[5]).hex() == one[5]["fingerprint"]
