"""Packing documents into sequences by a grouping genetic algorithm on islands.

Pieces of one length are interchangeable, so the problem is the histogram of lengths: at
most ``capacity`` numbers, whatever the corpus. An individual is a plan, a map from a bin's
contents (its lengths) to the number of such bins. Crossover injects whole well-filled bins
of one plan into another, removes the bins that would use a piece twice, and best-fits the
displaced pieces; mutation empties the bins with room and fills bins up from their pieces
by sums of lengths. Islands evolve in separate tasks from their own seeds; between rounds
each receives its neighbour's elite. The best plan is then dealt to the pieces: a piece's
rank among those of its length gives its bin and place.
"""

from __future__ import annotations

import json
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.common import column, partitions, settle

CAPACITY, EOS = 1024, 2
ISLANDS, ROUNDS, GENERATIONS, POPULATION = 6, 3, 4, 6
#: A generation's work is about the square of the number of lengths: fewer get more generations,
#: up to ``LONGEST``, for about the same work.
WORK, LONGEST = 4_000_000, 40
#: Rounds in which no island finds a better plan, after which the search ends.
STALLED = 2


def vocabulary(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, id_col="doc_id", text_col="text", path=None, capacity=CAPACITY, eos=EOS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every text's ids with ``eos`` behind."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType),
            T.StructField("piece", T.IntegerType()),
            *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")],
        ]
    )

    def cut(batches):
        from gaugeworks.llm.tokens import pack_ids, tokenizer

        words, end = tokenizer(vocabulary(path)), pack_ids([eos])
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            texts = batch.column(1)
            for i in range(batch.num_rows):
                data = words.packed(texts[i].as_py() or "") + end
                n = len(data) // 4
                at, k = 0, 0
                while at < n:
                    size = (n - at - 1) % capacity + 1 if k == 0 else capacity
                    rows.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(memoryview(data)[4 * at : 4 * (at + size)]))
                    at, k = at + size, k + 1
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
                names=schema.names,
            )

    return docs.select(column(id_col), column(text_col)).mapInArrow(cut, schema)


def best_fit(left: dict[int, int], plan: dict[tuple, int], capacity: int) -> dict[tuple, int]:
    """``plan`` with the pieces of ``left`` (length to count) put, longest first, where they
    leave the least room; alike bins are filled together."""
    gaps: list[dict] = [{} for _ in range(capacity + 1)]
    open_mask = 0
    done: Counter = Counter()
    for bin_, n in plan.items():
        gap = capacity - sum(bin_)
        gaps[gap][bin_] = gaps[gap].get(bin_, 0) + n
        open_mask |= 1 << gap
    for size in sorted(left, reverse=True):
        need = left[size]
        while need > 0:
            fitting = open_mask >> size
            if not fitting:
                each = capacity // size
                for bin_, n in (((size,) * each, need // each), ((size,) * (need % each), 1)):
                    if bin_ and n:
                        gap = capacity - sum(bin_)
                        gaps[gap][bin_] = gaps[gap].get(bin_, 0) + n
                        open_mask |= 1 << gap
                break
            gap = size + (fitting & -fitting).bit_length() - 1
            bin_, n = gaps[gap].popitem()
            k = min(n, need)
            if n > k:
                gaps[gap][bin_] = n - k
            elif not gaps[gap]:
                open_mask &= ~(1 << gap)
            grown = tuple(sorted((*bin_, size), reverse=True))
            gaps[gap - size][grown] = gaps[gap - size].get(grown, 0) + k
            open_mask |= 1 << (gap - size)
            need -= k
    for same in gaps:
        done.update(same)
    return dict(done)


def _take(left: dict[int, int], bin_: tuple, most: int) -> int:
    """How many bins like ``bin_``, ``most`` at most, the pieces in ``left`` allow; they go."""
    need = Counter(bin_)
    n = min(most, *(left.get(size, 0) // k for size, k in need.items()))
    if n > 0:
        for size, k in need.items():
            left[size] -= n * k
    return max(n, 0)


def crossover(a: dict, b: dict, hist: dict[int, int], capacity: int, rng: random.Random) -> dict:
    left, child = dict(hist), {}
    full = [x for x in sorted(b) if capacity - sum(x) <= 2]
    for bin_ in rng.sample(full, max(1, len(full) // 3)) if full else []:
        if n := _take(left, bin_, rng.randint(1, b[bin_])):
            child[bin_] = n
    for bin_ in sorted(a, key=lambda x: (capacity - sum(x), rng.random())):
        # the emptier a bin, the likelier its pieces are displaced
        if capacity - sum(bin_) > 2 and rng.random() < 0.5:
            continue
        if n := _take(left, bin_, a[bin_]):
            child[bin_] = child.get(bin_, 0) + n
    return best_fit({s: n for s, n in left.items() if n}, child, capacity)


def filling(left: dict[int, int], room: int) -> list[int]:
    """Lengths of pieces in ``left`` that fill ``room`` as far as any do, long ones first."""
    sizes = sorted((s for s, n in left.items() if n > 0 and s <= room), reverse=True)
    mask = (1 << (room + 1)) - 1
    reach = [1]  # reach[-k]: bit r where the k - 1 shortest lengths fill r
    for size in reversed(sizes):
        sums, more, step = reach[-1], min(left[size], room // size), 1
        while more > 0:  # counts by doubling, what is left at last
            step = min(step, more)
            sums |= (sums << (size * step)) & mask
            more, step = more - step, step * 2
        reach.append(sums)
    rest, out = reach[-1].bit_length() - 1, []
    for k, size in enumerate(sizes):
        below = reach[len(sizes) - k - 1]
        n = min(left[size], rest // size)
        while n and not below >> (rest - n * size) & 1:
            n -= 1
        out += [size] * n
        rest -= n * size
    return out


def refilled(plan: dict, hist: dict[int, int], capacity: int, rng: random.Random) -> dict:
    """Mutation: the bins with room, and some full ones, are emptied; each of their pieces,
    about the longest first, is put with others that fill its bin as far as any do, alike
    bins together; what may then remain is best-fitted."""
    left, kept, keep = dict(hist), {}, rng.choice((0.0, 0.5, 0.8, 0.9))
    for bin_, n in sorted(plan.items()):
        if sum(bin_) == capacity and rng.random() < keep:
            kept[bin_] = _take(left, bin_, n)
    # how far the order is blurred, and the share of lengths that a bin does without if it can
    blur, shy = rng.choice((0, capacity // 64, capacity // 8)), rng.choice((0.0, 0.3, 0.6))
    order = sorted((s for s, n in left.items() if n > 0), key=lambda s: (-(s + rng.randint(0, blur)), s))
    for size in order:
        while left[size] > 0:
            left[size] -= 1
            some = {s: n for s, n in left.items() if rng.random() >= shy} if shy else left
            rest = filling(some, capacity - size)
            if shy and sum(rest) + size < capacity:
                rest = filling(left, capacity - size)
            bin_ = tuple(sorted((size, *rest), reverse=True))
            left[size] += 1
            kept[bin_] = kept.get(bin_, 0) + _take(left, bin_, left[size])
    return best_fit({s: n for s, n in left.items() if n}, kept, capacity)


def matched(hist: dict[int, int], capacity: int, rng: random.Random) -> dict:
    """A first plan: exact partners of two or three in a random order, then best fit."""
    left, plan = dict(hist), {}
    for size in rng.sample(sorted(left), len(left)):
        rest = capacity - size
        third = rng.randint(1, max(1, rest - 1))
        for bin_ in ((size, rest), (size, third, rest - third)):
            bin_ = tuple(sorted((x for x in bin_ if x > 0), reverse=True))
            if sum(bin_) == capacity and (n := _take(left, bin_, left.get(size, 0))):
                plan[bin_] = plan.get(bin_, 0) + n
    return best_fit({s: n for s, n in left.items() if n}, plan, capacity)


def least_bins(hist: dict[int, int], capacity: int) -> int:
    """No plan has fewer bins. For any ``k`` up to half a bin, pieces above ``capacity - k``
    stand alone among those of ``k`` and more, other pieces above half a bin have one each,
    and what the rest need beyond the room in those takes further bins."""
    long = sorted((s for s in hist if 2 * s > capacity), reverse=True)
    best = -(-sum(s * n for s, n in hist.items()) // capacity)
    count = sum(hist[s] for s in long)
    for k in {s for s in hist if 2 * s <= capacity} | {capacity - s + 1 for s in long}:
        if 2 * k <= capacity:
            room = sum(hist[s] * (capacity - s) for s in long if s <= capacity - k)
            rest = sum(s * n for s, n in hist.items() if k <= s and 2 * s <= capacity)
            best = max(best, count + max(0, -(-(rest - room) // capacity)))
    return best


def fitness(plan: dict, capacity: int) -> tuple:
    """Fewer bins first; then fill gathered in few bins rather than spread."""
    return sum(plan.values()), -sum(n * sum(bin_) ** 2 for bin_, n in plan.items())


def evolve(hist: dict[int, int], start: list[dict], seed: int, capacity=CAPACITY, generations: int | None = None) -> dict:
    rng = random.Random(seed)
    bound = least_bins(hist, capacity)
    hist = dict(sorted(hist.items()))
    people = [*start, best_fit(hist, {}, capacity)]
    while len(people) < POPULATION:
        people.append(matched(hist, capacity, rng))
    for _ in range(generations or max(GENERATIONS, min(LONGEST, WORK // max(len(hist), 1) ** 2))):
        people.sort(key=lambda p: fitness(p, capacity))
        if sum(people[0].values()) <= bound:
            break
        parents = people[: POPULATION // 2]
        children = [refilled(crossover(*rng.sample(parents, 2), hist, capacity, rng), hist, capacity, rng) for _ in range(POPULATION)]
        people = sorted([*parents, *children], key=lambda p: fitness(p, capacity))[:POPULATION]
    return min(people, key=lambda p: fitness(p, capacity))


def _dump(plan: dict) -> str:
    return json.dumps([[list(bin_), n] for bin_, n in sorted(plan.items())])


def _load(text: str) -> dict:
    return {tuple(bin_): n for bin_, n in json.loads(text)}


def plan_on_islands(spark, hist: dict[int, int], capacity=CAPACITY, islands=ISLANDS, rounds=ROUNDS) -> dict:
    """The best plan found. What moves is one plan an island and round: its size is bounded
    by the number of lengths, so the driver may hand the elites on."""
    if not hist:
        return {}
    hist, bound = dict(sorted(hist.items())), least_bins(hist, capacity)
    elites: list[dict] = []
    best, since = None, 0
    for turn in range(rounds):
        came = {k: [_dump(elites[k]), _dump(elites[k - 1])] if elites else [] for k in range(islands)}

        def live(batches, turn=turn, came=came):
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    best = evolve(hist, [_load(x) for x in came[k]], 7919 * turn + k, capacity)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([_dump(best)])], names=["island", "plan"])

        rows = spark.range(0, islands, 1, islands).mapInArrow(live, "island long, plan string").collect()
        elites = [_load(r["plan"]) for r in sorted(rows, key=lambda r: r["island"])]
        now = min(fitness(p, capacity) for p in elites)
        best, since = (now, 0) if best is None or now < best else (best, since + 1)
        if now[0] <= bound or since == STALLED:
            break
    return min(elites, key=lambda p: fitness(p, capacity))


def slots(plan: dict) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, number of bins, first bin, first place) by rank."""
    out: dict[int, list] = {}
    used: Counter = Counter()
    first = 0
    for bin_, n in sorted(plan.items(), reverse=True):
        at = 0
        for size, k in sorted(Counter(bin_).items(), reverse=True):
            out.setdefault(size, []).append((used[size], n, first, at))
            used[size] += n * k
            at += size * k
        first += n
    return {size: np.array(rows, np.int64) for size, rows in out.items()}


def pack(docs: DataFrame, id_col="doc_id", text_col="text", path=None, capacity=CAPACITY, eos=EOS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece that holds ``eos``; only texts above ``capacity``
    ids are cut, and their first piece takes the remainder. Rows that repeat are packed
    each for itself; an empty table gives an empty result; further columns are ignored.

    One length may hold any share of the pieces: ranks are counted in as many hashed
    buckets of each length as there are shuffle partitions.
    """
    spark = docs.sparkSession
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(partitions(spark))).cast("int")
    rows = settle(pieces(docs, id_col, text_col, path, capacity, eos).withColumn("bucket", bucket))
    counts = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    whole = {(capacity,): hist.pop(capacity)} if capacity in hist else {}
    places = slots({**plan_on_islands(spark, hist, capacity), **whole})

    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
    ranked = rows.withColumn("within", within).join(offsets, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within")).alias("rank"))
    schema = T.StructType([*ranked.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def deal(batches):
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            bin_, at = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for one in np.unique(size):
                mine, table = size == one, places[int(one)]
                r = rank[mine]
                row = table[np.searchsorted(table[:, 0], r, "right") - 1]
                inner = r - row[:, 0]
                bin_[mine] = row[:, 2] + inner % row[:, 1]
                at[mine] = row[:, 3] + inner // row[:, 1] * one
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bin_), pa.array(at)], names=schema.names)

    return ranked.mapInArrow(deal, schema)
