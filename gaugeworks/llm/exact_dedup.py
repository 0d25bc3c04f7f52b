"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

Each normalised text is cut into chunks at places that its own bytes choose, in any script,
so passages that recur are cut alike wherever they stand. A chunk's identifier is a pair of
64-bit hashes. The chunk dictionary holds every distinct chunk once and proves that no two
chunks share an identifier; should two ever do, the seed changes and the identifiers are
drawn anew. Texts are then equal exactly when their ordered identifier lists are, and only
these lists (about 16 bytes for each 500 bytes) move from there on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import column, keep_rows, partitions, row_keys, settle

#: On the bytes of UTF-8, each as one character: at least 384, then up to the next boundary; 8192 at most. A boundary
#: is a word's end in n, s or t before a word in a to h, or a longer character whose last byte is 1 modulo 8.
CHUNK = r"(?s).{384,8192}?(?:[nst] [a-h]|[\x81\x89\x91\x99\xA1\xA9\xB1\xB9](?![\x80-\xBF])|\z)|.{8192}|.+"
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text) -> F.Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def chunk_ids(chunk, seed: int, bits: int) -> F.Column:
    pair = [F.xxhash64(F.lit(seed), chunk), F.xxhash64(F.lit(seed + 1), chunk, F.lit(seed))]
    return F.array(*[F.shiftrightunsigned(h, 64 - bits) if bits < 64 else h for h in pair])


def chunks(norm) -> F.Column:
    as_bytes = F.decode(F.encode(norm, "UTF-8"), "ISO-8859-1")
    return F.regexp_extract_all(as_bytes, F.lit(CHUNK), F.lit(0))


def clashing(docs: DataFrame, text_col: str, seed: int, bits: int) -> bool:
    """Whether two distinct chunks of ``docs`` have one identifier.

    Every chunk's bytes move at most once here, combined on the map side first.
    """
    distinct = (
        docs.select(F.explode(chunks(normalised(column(text_col)))).alias("chunk"))
        .groupBy(chunk_ids(F.col("chunk"), seed, bits).alias("id"), "chunk")
        .agg(F.lit(1).alias("one"))
    )
    worst = distinct.groupBy("id").agg(F.sum("one").alias("n")).agg(F.max("n").alias("n"))
    return (worst.first()["n"] or 0) > 1


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """(id, text_sha256, recipe): the ordered verified chunk identifiers of each text."""
    seed = 0
    while clashing(docs, text_col, seed, bits):
        seed, bits = seed + 2, min(64, 2 * bits)
    ids = F.flatten(F.transform(chunks(F.col("norm")), lambda c: chunk_ids(c, seed, bits)))
    return docs.select(column(id_col).alias("doc_id"), normalised(column(text_col)).alias("norm")).select(
        "doc_id", F.sha2("norm", 256).alias("text_sha256"), ids.alias("recipe")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal normalised text the smallest doc_id stays (null ids only when all
    are null); of repeated rows with that id one stays. Null texts equal empty ones. An
    empty table gives an empty result; further columns, of any name, are ignored.

    A group may hold a third of all rows, and these may all have one id: its rows are
    salted by their numbers, counted per salt and then per recipe, so no task gathers a
    group.
    """
    rows = settle(recipes(docs, id_col, text_col, bits).withColumn("row", F.monotonically_increasing_id()))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(partitions(docs.sparkSession))).cast("int"))
    me = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    part = rows.groupBy("recipe", "salt").agg(F.min(me).alias("low"), F.count(F.lit(1)).alias("n"))
    whole = part.groupBy("recipe").agg(F.min("low").alias("low"), F.sum("n").alias("group_size"))
    groups = part.select("recipe", "salt").join(whole, "recipe")
    return rows.join(groups, ["recipe", "salt"]).select(
        "doc_id", F.col("low.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("low.row")).alias("kept"), "text_sha256"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, all columns as they were; ties, nulls,
    repeated rows and empty tables as there."""
    keyed, key = row_keys(docs, id_col)
    return keep_rows(keyed, key, exact_dedup(keyed, key, text_col))
