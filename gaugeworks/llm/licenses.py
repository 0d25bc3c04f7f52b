"""License scans by a positional index of rare words.

Each licence template is a run of words, and every word of it is posted with its places. Of
a text's licence words those with the highest IDF in the scanned corpus are looked up, for
each template whose mandatory key phrases the text's words do not rule out: their places
in the text less those in the template vote for where it would begin. Where enough agree
on one place, the words around are compared and the key phrases verified. Phrases that are
labels by themselves ("mit license") are looked up by their rarest word and verified word
for word.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.common import column
from gaugeworks.llm.groups import pa_types

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Phrases that are labels by themselves.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
#: Label, words of the notice, key phrases it must hold.
TEMPLATES = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge",),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify", "with or without fee"),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
        "obtain a copy of the license at",
        ("apache license",),
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation",
        ("gnu general public license",),
    ),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
        "published by the free software foundation",
        ("lesser general public license",),
    ),
    (
        "agpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license",
        ("affero general public license",),
    ),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("released into the public domain",)),
    ("cc0", "to the extent possible under law the author has waived all copyright under the cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
)
#: Words of a text that are looked up for a template, how many must agree on a place, share of its words that must
#: stand there, places they may shift.
ASKED, VOTES, ENOUGH, SHIFT = 8, 3, 0.6, 2


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


@dataclass
class Template:
    words: list
    label: str
    keys: list
    #: Words without which no key phrase can stand, and the places of each word.
    needed: frozenset
    places: dict


@dataclass
class Index:
    idf: dict
    phrases: list
    templates: list


def vocabulary() -> set[bytes]:
    return {w for _, text, _ in TEMPLATES for w in words_of(text)} | {w for text, _ in PHRASES for w in words_of(text)}


def build_index(df: dict[bytes, int], texts: int) -> Index:
    """The positional index of phrases and templates, and the IDF of their words."""
    idf = {w: math.log((1 + texts) / (1 + df.get(w, 0))) for w in vocabulary()}
    templates = []
    for label, text, keys in TEMPLATES:
        places = defaultdict(list)
        for k, w in enumerate(words_of(text)):
            places[w].append(k)
        keys = [words_of(k) for k in keys]
        templates.append(Template(words_of(text), label, keys, frozenset(w for k in keys for w in k), dict(places)))
    return Index(idf, [(words_of(text), label) for text, label in PHRASES], templates)


def lookups(index: Index, there: set) -> dict:
    """What to look up of a text that has these licence words: word to (is a base phrase,
    number, place) of each posting."""
    asked = defaultdict(list)
    for n, (words, _) in enumerate(index.phrases):
        if there.issuperset(words):
            at = max(range(len(words)), key=lambda k: (index.idf[words[k]], -k))
            asked[words[at]].append((True, n, at))
    for n, t in enumerate(index.templates):
        if t.needed <= there:
            rarest = sorted(there.intersection(t.places), key=lambda w: (-index.idf[w], w))[:ASKED]
            for w in rarest:
                asked[w] += [(False, n, place) for place in t.places[w]]
    return asked


def _holds(words: list, phrase: list, low: int, high: int) -> bool:
    n = len(phrase)
    return any(words[k : k + n] == phrase for k in range(max(low, 0), min(high, len(words) - n + 1)))


def scan(index: Index, words: list[bytes]) -> list[tuple]:
    """(label, first word, word behind the last, score, is a base phrase) of each find."""
    asked = lookups(index, index.idf.keys() & set(words))
    found, votes = [], Counter()
    if not asked:
        return found
    for at, word in enumerate(words):
        for base, n, place in asked.get(word, ()):
            start = at - place
            if base:
                phrase, label = index.phrases[n]
                if start >= 0 and words[start : start + len(phrase)] == phrase:
                    found.append((label, start, start + len(phrase), 1.0, True))
            else:
                votes[n, start] += 1
    last: dict = {}
    for n, start in sorted(votes):
        t = index.templates[n]
        size = len(t.words)
        near = sum(votes.get((n, start + d), 0) for d in range(-SHIFT, SHIFT + 1))
        if near < min(VOTES, size // 2) or start <= last.get(n, -size):
            continue
        inside = sum(w in words[max(start + k - SHIFT, 0) : max(start + k + SHIFT + 1, 0)] for k, w in enumerate(t.words))
        score = inside / size
        low, high = start - SHIFT, start + size + SHIFT
        if score >= ENOUGH and all(_holds(words, key, low, high) for key in t.keys):
            found.append((t.label, max(start, 0), min(start + size, len(words)), score, False))
            last[n] = start + SHIFT
    return found


def word_frequencies(docs: DataFrame, text_col: str) -> tuple[dict[bytes, int], int]:
    """In how many texts each licence word stands, over all rows, and their number. What
    comes to the driver is a number per word of the templates."""
    wanted = vocabulary()

    def count(batches):
        df, n = Counter(), 0
        for batch in batches:
            for text in batch.column(0):
                df.update(wanted.intersection(words_of(text.as_py() or "")))
                n += 1
        if n:
            df[b" "] = n
            yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.binary()), pa.array(list(df.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(column(text_col)).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {bytes(r["word"]): r["n"] for r in rows}
    return df, df.pop(b" ", 0)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, finds) of every row; a find has label, first, behind, score, base.

    Words are counted from 0 over the whole text. Null and empty texts have no words and no
    finds; rows that repeat are scanned each for itself; an empty table gives an empty
    result; further columns are ignored.
    """
    df, texts = word_frequencies(docs, text_col)
    index = build_index(df, texts)
    find = T.StructType(
        [
            T.StructField("label", T.StringType()),
            T.StructField("first", T.LongType()),
            T.StructField("behind", T.LongType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("base", T.BooleanType()),
        ]
    )
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("finds", T.ArrayType(find))])
    types = pa_types(schema)
    names = find.names

    def look(batches):
        for batch in batches:
            counts, finds = [], []
            for text in batch.column(1):
                words = words_of(text.as_py() or "")
                counts.append(len(words))
                finds.append([dict(zip(names, f)) for f in scan(index, words)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(finds, types[2])], names=schema.names)

    return docs.select(column(id_col), column(text_col)).mapInArrow(look, schema)


def summary(scanned: DataFrame) -> DataFrame:
    """The digest of ``scan_licenses``: places and labels of base phrases, all labels, score."""
    base = F.filter("finds", lambda f: f["base"])
    starts = F.transform(base, lambda f: f["first"])
    joined = lambda finds: F.array_join(F.array_sort(F.array_distinct(F.transform(finds, lambda f: f["label"]))), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("finds")).alias("labels"),
        F.coalesce(F.array_max(F.transform("finds", lambda f: f["score"])), F.lit(0.0)).alias("score"),
    )
