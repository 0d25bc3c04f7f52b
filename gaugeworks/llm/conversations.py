"""Repair of conversation structure by shortest paths over small integer costs.

A conversation's rows in order, and the states of an automaton of legal role sequences
(nothing, after a system turn, after a user turn, after an assistant turn), make a graph:
each edit is an arc from (row, state) to (row or next row, next state). Costs are small
integers, so distances to the end come from Dial's ring of buckets. From the start, the
least letter among the tight arcs (those that lie on a shortest path) is walked at each
node, which spells the least of all cheapest edit strings.

Conversations are cut into blocks of rows, so that one of any length spans many tasks:
each block gives its distances from every state to every state, a short pass joins them,
and each block is walked from every state that may enter it. Only the hash of the repaired
text, which is defined over all of it, reads a conversation in one stream, a row at a time.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.common import column, partitions, settle
from gaugeworks.llm.groups import blocks_of, pa_types

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after system, after user, after assistant; where a sequence may end.
STATES, ENDS = 4, (0, 3)
#: The state that keeping a role's initial leads to, and the role that is wanted next.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANTED = {0: "user", 1: "user", 2: "assistant", 3: "user"}
#: Buckets in the ring: one more than the dearest arc.
RING = INSERT + REROLE + 1
#: Rows in a block, at most.
BLOCK = 1024
FAR = 1 << 60
#: What a row is, in priority.
FINE, BLANK, DUPLICATE, CUT = range(4)


def arcs(initial: str, fault: int, state: int):
    """(letter, cost, next state) of the edits of a row in a state, least letter first."""
    yield "D", DELETE, state
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED if fault == CUT else 0
    if (state, initial) in STEP:
        yield "K", KEEP + more, STEP[state, initial]
    yield "R", REROLE + more, STEP[state, WANTED[state][0]]


def inserted(state: int) -> int:
    return STEP[state, WANTED[state][0]]


def distances(rows: list[tuple[str, int]], beyond: list[int]) -> list[list[int]]:
    """Cost of the cheapest way from (row, state) to the end, for every row and the end
    itself, where ``beyond`` says what each state costs from there on (FAR: no way).

    Dial's algorithm on the reversed graph: nodes lie in a ring of buckets by distance.
    """
    n = len(rows)
    into = [[[] for _ in range(STATES)] for _ in range(n + 1)]  # (row, state, cost) that lead to a node
    for k in range(n + 1):
        for s in range(STATES):
            into[k][inserted(s)].append((k, s, INSERT))
            if k < n:
                for _, cost, to in arcs(*rows[k], s):
                    into[k + 1][to].append((k, s, cost))
    far = [[FAR] * STATES for _ in range(n + 1)]
    low = min(beyond)
    if low >= FAR:
        return far
    ring = [[] for _ in range(RING)]
    # states of the end enter when the sweep comes to their distance
    waiting = sorted((d, s) for s, d in enumerate(beyond) if d < FAR)
    at, left = low, 0
    while waiting or left:
        while waiting and waiting[0][0] == at:
            d, s = waiting.pop(0)
            if d < far[n][s]:
                far[n][s] = d
                ring[at % RING].append((n, s))
                left += 1
        bucket = ring[at % RING]
        while bucket:
            k, s = bucket.pop()
            left -= 1
            if far[k][s] != at:
                continue
            for j, r, cost in into[k][s]:
                if at + cost < far[j][r]:
                    far[j][r] = at + cost
                    ring[(at + cost) % RING].append((j, r))
                    left += 1
        at = at + 1 if left or not waiting else waiting[0][0]
    return far


def walk(rows: list[tuple[str, int]], far: list[list[int]], state: int) -> tuple[str, int]:
    """The least string of letters along tight arcs from (0, state) to the last row, and the
    state reached there. Insertions behind the last row are left to what comes next, where
    ``far`` is what that costs; ``tail`` spells them at the very end."""
    out = []
    for k, row in enumerate(rows):
        while True:
            tight = [(letter, to, True) for letter, cost, to in arcs(*row, state) if cost + far[k + 1][to] == far[k][state]]
            if INSERT + far[k][inserted(state)] == far[k][state]:
                tight.append(("I", inserted(state), False))
            letter, state, done = min(tight)
            out.append(letter)
            if done:
                break
    return "".join(out), state


def tail(state: int) -> str:
    """The insertions that end a sequence."""
    out = ""
    while state not in ENDS:
        out, state = out + "I", inserted(state)
    return out


def end_costs() -> list[int]:
    return [INSERT * len(tail(s)) for s in range(STATES)]


def damaged(rows: DataFrame, id_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """(conv_id, turn, role, text, copy): the rows after the contract's damage, by the CRC-32
    of ``conv_id:turn`` modulo 20. Nulls count as one space, but null turns stay null."""
    conv, turn = column(id_col), column(turn_col)
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", space(conv), space(turn))) % 20
    whole = space(column(text_col))
    text = F.when(fate == 1, "").when(fate == 2, F.translate(whole, ".!?", "")).otherwise(whole)
    role = F.when(fate == 4, "user").otherwise(space(column(role_col)))
    copies = F.when(fate == 0, F.array().cast("array<int>")).when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


#: What orders a conversation's rows: null turns first, then turns; rows of one turn by role
#: and a hash of their text, so that equal rows are next to each other.
ORDER = ["some", "turn", "role", "digest", "copy"]


def ordered(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", F.col("turn").isNotNull().alias("some"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "copy", "text")


def row_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, ORDER, row, initial, fault) of ordered rows: the first of blank, duplicate and
    truncated that holds. A duplicate has a row of its role and text before it."""
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    facts = settle(rows.select("conv_id", *ORDER, F.monotonically_increasing_id().alias("row"), F.substring("role", 1, 1).alias("initial"), last.alias("last")))
    place = F.struct(*ORDER, "row")
    # counted before any shuffle; what occurs once needs no look
    again = facts.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    told = facts.join(again.hint("merge"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    fault = (
        F.when(F.col("last") == "", BLANK)
        .when(F.col("first").isNotNull() & (place > F.col("first")), DUPLICATE)
        .when(~F.col("last").isin(".", "!", "?"), CUT)
        .otherwise(FINE)
    )
    return told.select("conv_id", *ORDER, "row", "initial", fault.alias("fault"))


def _stream(rows: DataFrame, order: list, run, schema) -> DataFrame:
    """``run`` over the rows of each conversation in order, a conversation after the other."""
    return rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(run, schema)


def _by_conversation(batches, names):
    """(conversation, its rows as dictionaries, read as they come) of sorted batches."""
    rows = (row for batch in batches for row in batch.select(names).to_pylist())
    return groupby(rows, lambda r: r["conv_id"])


def _out(rows: list[dict], schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], t) for f, t in zip(schema.names, pa_types(schema))], names=schema.names)


def _ends(batches):
    """What each state costs from each block's end on; blocks come last first."""
    for batch_rows in _chunks(_ends_of(batches)):
        yield pa.RecordBatch.from_pylist(batch_rows, pa.schema([("at", pa.int64()), ("beyond", pa.list_(pa.int64()))]))


def _ends_of(batches):
    for _, blocks in _by_conversation(batches, ["conv_id", "block", "way"]):
        beyond = end_costs()
        for b in blocks:
            yield {"at": b["block"], "beyond": beyond}
            way = b["way"]  # by state at the end, then state at the beginning
            beyond = [min(FAR, *(way[e * STATES + s] + beyond[e] for e in range(STATES))) for s in range(STATES)]


def _entries_of(batches):
    """The state in which each block is entered, and the initial of the row before it."""
    for _, blocks in _by_conversation(batches, ["conv_id", "block", "exits", "ends"]):
        state, before = 0, None
        for b in blocks:
            yield {"at": b["block"], "entry": state, "before": before}
            state, before = b["exits"][state], b["ends"][1]


def _entries(batches):
    for batch_rows in _chunks(_entries_of(batches)):
        yield pa.RecordBatch.from_pylist(batch_rows, pa.schema([("at", pa.int64()), ("entry", pa.int32()), ("before", pa.string())]))


def _chunks(rows, size=4096):
    kept: list = []
    for row in rows:
        kept.append(row)
        if len(kept) == size:
            yield kept
            kept = []
    if kept:
        yield kept


LEGAL = ("su", "ua", "au")


def _measure(batches):
    """The ways through a block that isn't its conversation's only one."""
    for batch in batches:
        for b in batch.to_pylist():
            rows = list(zip(b["initial"], b["fault"]))
            way = [d for e in range(STATES) for d in distances(rows, [0 if s == e else FAR for s in range(STATES)])[0]]
            yield pa.RecordBatch.from_pylist([{"conv_id": b["conv_id"], "block": b["block"], "way": way}], pa.schema([batch.schema.field(0), ("block", pa.int64()), ("way", pa.list_(pa.int64()))]))


def _digests(batches, schema):
    """(conv_id, repaired_sha256): a conversation's edits come before the rows they edit."""
    for rows in _chunks(_digests_of(batches)):
        yield _out(rows, schema)


def _digests_of(batches):
    for conv, rows in _by_conversation(batches, ["conv_id", "role", "text", "piece"]):
        sha, state, edits, at, some = hashlib.sha256(), 0, "", 0, False

        def say(role, text):
            nonlocal some
            sha.update((("\n" if some else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            some = True

        def insert():
            nonlocal at, state
            while at < len(edits) and edits[at] == "I":
                say(WANTED[state], "")
                state, at = inserted(state), at + 1

        for r in rows:
            if r["piece"] is not None:
                edits, at = edits[at:] + r["piece"], 0
                continue
            insert()
            letter, at = edits[at], at + 1
            if letter != "D":
                role = r["role"] if letter == "K" else WANTED[state]
                say(role, r["text"])
                state = STEP[state, role[:1]]
        insert()
        yield {"conv_id": conv, "repaired_sha256": sha.hexdigest()}


def repair(rows: DataFrame) -> DataFrame:
    """Structure and cheapest repair of conversations, of rows (conv_id, turn, role, text, copy):
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are in the order of ``ORDER``; null ids are one conversation. An empty table gives
    an empty result.
    """
    schema = rows.schema
    named = ordered(rows)
    cut = settle(blocks_of(row_faults(named), ["conv_id"], [*ORDER, "row"], BLOCK))
    turns = cut.select("conv_id", F.explode("turn").alias("turn")).filter("turn is not null").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"))
    gaps = turns.groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count(F.lit(1)).alias("n"))
    gaps = gaps.select(F.col("conv_id").alias("c"), F.expr("cast(try_add(try_subtract(cast(high as bigint), cast(low as bigint)), 1 - n) as bigint)").alias("gaps"))

    # conversations of several blocks: distances through each, then from each to the end
    many = cut.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("block").alias("final"))
    seen = cut.join(many.select(F.col("conv_id").alias("c"), "n", "final"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    conv = schema["conv_id"]
    ways = seen.filter("n > 1").select("conv_id", "block", "initial", "fault").mapInArrow(_measure, T.StructType([conv, *T.StructType.fromDDL("block long, way array<bigint>").fields]))
    ends = _stream(ways, [F.col("block").desc()], _ends, "at long, beyond array<bigint>")

    facts = T.StructType(
        [conv, *T.StructType.fromDDL("block long, final long, cost long, blank long, duplicate long, truncated long, illegal long, audits array<string>, exits array<int>, ends array<string>").fields]
    )

    def spell(batches):
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                rows, beyond = list(zip(b["initial"], b["fault"])), b["beyond"] or end_costs()
                far = distances(rows, beyond)
                entries = [s for s in range(STATES) if b["n"] > 1 or s == 0]
                found = [walk(rows, far, s) for s in entries]
                if b["block"] == b["final"]:
                    found = [(audit + tail(s), s) for audit, s in found]
                out.append(
                    {f: b[f] for f in ("conv_id", "block", "final")}
                    | {"cost": far[0][0], "audits": [a for a, _ in found], "exits": [s for _, s in found], "ends": [b["initial"][0], b["initial"][-1]]}
                    | {name: b["fault"].count(kind) for name, kind in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT))}
                    | {"illegal": sum(x + y not in LEGAL for x, y in zip(b["initial"], b["initial"][1:]))}
                )
            yield _out(out, facts)

    spelt = seen.select("conv_id", "block", "final", "n", "initial", "fault").join(ends.hint("merge"), F.col("block") == F.col("at"), "left").drop("at").mapInArrow(spell, facts)
    spelt = settle(spelt)
    entries = _stream(spelt.filter(F.size("exits") > 1).select("conv_id", "block", "exits", "ends"), ["block"], _entries, "at long, entry int, before string")
    first = cut.select(F.col("block").alias("b"), *[F.col(c)[0].alias(c) for c in ORDER])
    placed = spelt.join(entries.hint("merge"), F.col("block") == F.col("at"), "left").join(first.hint("merge"), F.col("block") == F.col("b"))
    piece = F.col("audits")[F.coalesce("entry", F.lit(0))]
    seam = F.when(F.col("before").isNotNull() & ~F.concat("before", F.col("ends")[0]).isin(*LEGAL), 1).otherwise(0)
    opens = F.coalesce("entry", F.lit(0)) + F.when(F.col("before").isNotNull(), 1).otherwise(0) == 0
    placed = settle(placed.select("conv_id", "block", *ORDER, "blank", "duplicate", "truncated", (F.col("illegal") + seam).alias("illegal"), F.when(opens, F.col("cost")).alias("cost"), piece.alias("piece")))
    spelling = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda x: x["piece"]), "")
    sums = [F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    told = placed.groupBy("conv_id").agg(*sums, spelling.alias("audit"))

    edits = placed.select("conv_id", *ORDER, F.lit(0).alias("kind"), "block", F.lit(None).cast("string").alias("text"), "piece")
    texts = named.select("conv_id", *ORDER, F.lit(1).alias("kind"), F.lit(None).cast("long").alias("block"), "text", F.lit(None).cast("string").alias("piece"))
    digests = T.StructType([conv, T.StructField("repaired_sha256", T.StringType())])
    hashed = _stream(edits.unionByName(texts), [*ORDER, "kind", "block"], lambda b: _digests(b, digests), digests).withColumnRenamed("conv_id", "h")
    out = told.join(hashed, F.col("conv_id").eqNullSafe(F.col("h"))).join(gaps, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return out.select("conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage_and_repair(rows: DataFrame, id_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """``repair`` of the damaged rows, for every conversation of the undamaged ones: one that
    has no row left has zeros, an empty audit and the hash of an empty text. Null ids are one
    conversation. Further columns, of any name, are ignored; repeated rows count as often as
    they occur; rows of one turn are ordered by role and a hash of their text."""
    fixed = repair(damaged(rows, id_col, turn_col, role_col, text_col)).withColumnRenamed("conv_id", "id")
    every = rows.select(column(id_col).alias("conv_id")).distinct()
    joined = every.join(fixed, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
