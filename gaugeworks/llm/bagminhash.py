"""BagMinHash signatures: minwise hashing of weighted sets by Poisson processes.

Every shingle owns a Poisson process over (time, weight level, component). Its weight axis
is cut into the dyadic intervals (0,1], (1,2], (2,4], (4,8], ...; a text that holds the
shingle c times sees the points at levels up to c, so an interval that c covers counts
whole and the last one is thinned by its points' levels. A component's signature is the
first time that any shingle's process hits it: two texts agree there with the probability
that their weighted Jaccard similarity names.

Times are cut into slabs in which one point is expected. Each slab's points follow from a
hash of shingle, interval and slab alone, so a text looks only at slabs before the time by
which all its components are expected to be hit, and goes on if one is not.
"""

from __future__ import annotations

import math

import numpy as np

U = np.uint64
_RATES = [1 / math.factorial(k) for k in range(16)]
#: Cumulated Poisson(1) probabilities, scaled to 64 bits.
_CDF = np.array([min(2**64 - 1, int(2**64 * sum(_RATES[: k + 1]) / math.e)) for k in range(16)], U)
_WORD = np.zeros(256, bool)
#: Words whose bytes are hashed at a time.
WORDS = 1 << 17
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15 | 1
    inverse = pow(base, -1, 1 << 64)
    out = np.ones((2, n), U)
    for row, b in zip(out, (base, inverse)):
        row[1:] = U(b)
        np.multiply.accumulate(row, out=row)
    return out[0], out[1]


def _word_hashes(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _powers(len(flat))
    total = np.zeros(len(flat) + 1, U)
    np.cumsum((flat.astype(U) + U(1)) * up, out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


def shingles(texts: list, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of every shingle, in order. Words are runs of ASCII
    letters, digits and non-ASCII characters of the lower-cased text; a text of fewer than
    ``width`` words is one shingle, one without words has none."""
    data = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.array([len(d) + 1 for d in data])
    flat = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    word = _WORD[flat]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    doc = np.repeat(np.arange(len(texts)), lengths)[start]
    words = np.empty(len(start), U)
    for k in range(0, len(start), WORDS):
        first, last = start[k : k + WORDS], end[k : k + WORDS]
        words[k : k + WORDS] = _word_hashes(flat[first[0] : last[-1]], first - first[0], last - first[0])
    n = len(words)
    h = np.zeros(n, U)
    for k in range(width):
        h *= U(0xBF58476D1CE4E5B9)
        m = max(n - k, 0)
        h[:m] += np.where(doc[k:] == doc[:m], words[k:], U(0)) if k else words
        h = h ^ (h >> U(29))
    counts = np.bincount(doc, minlength=len(texts))
    place = np.arange(n) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    inside = place < np.maximum(counts[doc] - width + 1, 1)
    return doc[inside], mix(h[inside])


def bags(texts: list, width: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct shingles, sorted, and their counts."""
    doc, h = shingles(texts, width)
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [np.unique(h[a:b], return_counts=True) for a, b in zip(cut[:-1], cut[1:])]


def _points(h, level, width, reach, m):
    """Points of the processes of (shingle, interval) rows before ``reach``: the row, time,
    component and weight level of each."""
    slabs = np.maximum(np.ceil(reach * (m * width)), 1).astype(np.int64)
    row = np.repeat(np.arange(len(h)), slabs)
    slab = np.arange(len(row)) - np.repeat(np.cumsum(slabs) - slabs, slabs)
    seed = mix(h[row] + level[row] * U(0xA24BAED4963EE407) + slab.astype(U) * U(0x9FB21C651E98DF25))
    n = np.searchsorted(_CDF, seed, "right")
    which = np.repeat(np.arange(len(row)), n)
    k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    draw = mix(seed[which] ^ ((k + 1).astype(U) * U(0xE7037ED1A0B428DB)))
    row, slab = row[which], slab[which]
    time = (slab + (draw >> U(11)).astype(np.float64) * 2.0**-53) / (m * width[row])
    more = mix(draw + U(0x8EBC6AF09C88C6E3))
    component = ((more >> U(32)) * U(m) >> U(32)).astype(np.int64)
    at = ((more & U(0xFFFFFFFF)) * width[row].astype(U) >> U(32)).astype(np.int64) + 1
    return row, time, component, at


def signatures(bag_list: list, m: int) -> np.ndarray:
    """(len(bag_list), m) 64-bit signatures; texts without shingles have zeros."""
    out = np.full((len(bag_list), m), np.inf)
    weight = np.array([c.sum() for _, c in bag_list], np.float64)
    todo = np.flatnonzero(weight > 0)
    factor = math.log(m) + 4
    while len(todo):
        doc = np.repeat(todo, [len(bag_list[i][0]) for i in todo])
        h = np.concatenate([bag_list[i][0] for i in todo])
        c = np.concatenate([bag_list[i][1] for i in todo])
        rows = [(doc, h, c, np.zeros(len(h), np.int64), np.ones(len(h)))]
        level = 1
        while (more := c > (1 << (level - 1))).any():
            doc, h, c = doc[more], h[more], c[more]
            low = 1 << (level - 1)
            rows.append((doc, h, c - low, np.full(len(h), level), np.full(len(h), float(low))))
            level += 1
        doc, h, c, lev, width = (np.concatenate(x) for x in zip(*rows))
        row, time, component, at = _points(h, lev.astype(U), width, factor / weight[doc], m)
        seen = at <= c[row]
        np.minimum.at(out, (doc[row[seen]], component[seen]), time[seen])
        # beyond its reach a text has seen only some points: a component hit there, or not at all, is open
        todo = todo[(out[todo] > (factor / weight[todo])[:, None]).any(1)]
        factor *= 2
    bits = mix(np.where(np.isinf(out), 0.0, out).view(U))
    bits[weight == 0] = 0
    return bits


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each run of ``rows`` components, told apart by band."""
    n = sig.shape[1] // rows
    key = np.arange(n, dtype=U)[None, :] * U(0x9E3779B97F4A7C15) + U(1)
    key = np.repeat(key, len(sig), 0)
    for r in range(rows):
        key = mix(key ^ sig[:, r : n * rows : rows])
    return key.view(np.int64)


def similarity(a, b) -> float:
    """Weighted Jaccard similarity of two bags."""
    (x, c), (y, d) = a, b
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(c[i], d[j]).sum())
    whole = int(c.sum() + d.sum()) - both
    return both / whole if whole else 0.0


def fingerprint(bag) -> bytes:
    """16 bytes that name a bag."""
    x, c = bag
    one = mix(x + c.astype(U) * U(0x9FB21C651E98DF25))
    two = mix(one ^ U(0xA24BAED4963EE407))
    return np.array([one.sum(dtype=U), two.sum(dtype=U)], ">u8").tobytes()


def pack_bag(bag) -> bytes:
    """A bag as sorted 32-bit hashes, one for each occurrence of each shingle, told apart by
    the occurrence: the overlap of two packed bags is that of the multisets."""
    x, c = bag
    place = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
    return np.unique((mix(np.repeat(x, c) + place.astype(U) * U(0xA24BAED4963EE407)) >> U(32)).astype("<u4")).tobytes()


def overlap(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard similarity of two packed bags."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0.0
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both / (len(x) + len(y) - both)


def packed_similarity(a: bytes, b: bytes) -> float:
    return overlap(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"))
