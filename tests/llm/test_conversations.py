"""Conversation repair against a search over all repairs."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import conversations as talk

SPACE = " \t\n\x0b\x0c\r"
COLUMNS = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        say = lambda v: " " if v is None else str(v)
        fate = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        if fate == 1:
            text = ""
        elif fate == 2:
            text = re.sub("[.!?]", "", text)
        elif fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Least (cost, audit, lines) by the best way into each role so far, without a graph."""
    best = {"": (0, "", ())}  # by the last role's initial

    def fits(last, role):
        return bool(role) and last + role in ("s", "u", "su", "ua", "au")

    def insertions(ways):
        for _ in range(3):
            for last, (cost, audit, lines) in list(ways.items()):
                for role in ("user", "assistant"):
                    new = (cost + 5, audit + "I", (*lines, role + ":"))
                    if fits(last, role[0]) and new < ways.get(role[0], (1 << 60,)):
                        ways[role[0]] = new
        return ways

    for (_, _, role, text), fault in zip(rows, found):
        ways, after = insertions(dict(best)), {}

        def offer(last, way):
            if way < after.get(last, (1 << 60,)):
                after[last] = way

        for last, (cost, audit, lines) in ways.items():
            offer(last, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault else 0
            if fits(last, role[:1]):
                offer(role[:1], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
            for new in ("user", "assistant"):
                if fits(last, new[0]):
                    offer(new[0], (cost + more + 1, audit + "R", (*lines, f"{new}:{text}")))
        best = after
    return min(way for last, way in insertions(best).items() if last in ("", "a"))


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out = []
    for conv, all_rows in by.items():
        left = damage(all_rows)
        found, turns = faults(left), [r[1] for r in left if r[1] is not None]
        cost, audit, lines = cheapest(left, found)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(left, left[1:]))
        out.append((conv, gaps, *[found.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def random_rows(seed, conversations, longest):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "Why?", " ", "", None, "a. \n", "é…", "more.  \t", *[f"line {k}." for k in range(12)]]
    return [(c, r.choice([None, *range(14)]), r.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""]), r.choice(texts)) for c in range(conversations) for _ in range(r.randint(1, longest))]


def got(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.mark.parametrize("block", [1024, 4])
def test_against_all_repairs(spark, monkeypatch, block):
    monkeypatch.setattr(talk, "BLOCK", block)
    rows = random_rows(block, 80, 14) + [(None, 1, "user", "Hi."), (None, None, "assistant", "Hello."), (7, 3, "user", "Again."), (7, 3, "user", "Again.")] * 2
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert got(talk.damage_and_repair(df)) == brute(rows)


def test_a_conversation_of_many_blocks(spark, monkeypatch):
    """One conversation holds nearly all rows; many are equal."""
    monkeypatch.setattr(talk, "BLOCK", 256)
    r = random.Random(3)
    rows = [(1, k // 2, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["Same.", f"Row {k}.", f"cut {k}"])) for k in range(4000)]
    rows += [(1, 77, "user", "Copied.")] * 900 + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Hello.")]
    df = spark.createDataFrame(rows, COLUMNS).repartition(6)
    assert got(talk.damage_and_repair(df)) == brute(rows)


def test_nothing_left_empty_table_and_clashing_names(spark):
    lost = next(c for c in range(10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "Gone."), (lost + 1, None, None, None)]
    df = spark.createDataFrame(rows, COLUMNS)
    empty = hashlib.sha256(b"").hexdigest()
    out = got(talk.damage_and_repair(df))
    assert (lost, 0, 0, 0, 0, 0, 0, "", empty) in out and out == brute(rows)
    wide = df.select("*", *[F.lit(1).alias(c) for c in ("some", "digest", "copy", "row", "block", "kind", "c", "n", "id", "h", "`q`", "a.b")])
    assert got(talk.damage_and_repair(wide)) == out
    assert talk.damage_and_repair(df.filter("false")).count() == 0


def test_distances_are_shortest():
    """Dial's buckets against relaxing every arc until nothing changes."""
    r = random.Random(5)
    for _ in range(60):
        rows = [(r.choice("suat"), r.choice([0, 0, 1, 2, 3])) for _ in range(r.randint(0, 9))]
        beyond = [r.choice([0, 5, 11, talk.FAR]) for _ in range(4)]
        want = [[talk.FAR] * 4 for _ in rows] + [list(beyond)]
        for _ in range(4):
            for k in range(len(rows), -1, -1):
                for s in (0, 1, 2, 3) * 3:
                    ways = [cost + want[k + 1][to] for _, cost, to in talk.arcs(*rows[k], s)] if k < len(rows) else []
                    want[k][s] = min([want[k][s], talk.FAR, talk.INSERT + want[k][talk.inserted(s)], *ways])
        assert talk.distances(rows, beyond) == want
