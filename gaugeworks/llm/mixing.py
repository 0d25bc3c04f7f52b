"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1]; its integral, scaled to
the source's target, is the cumulative demand D(t) in words. A source's documents stand in
a fixed pseudo-random order, and the document that starts after x words of it is trained on
at the t where D(t) = x. Past its end a source starts again, up to the cap on repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.llm.common import column, fresh, ids_repeat, row_keys, settle

WORD = r"[^\x20\x09-\x0D]+"
#: Weights and schedule slopes by the source's rank, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SLOPES = (0.5, 0.0, -0.5)
SHARE, CAP = 1.5, 2.0
#: Hex digits of the order key that name a bucket: 4096 buckets for each source.
DIGITS = 3


def _cycle(values, rank) -> F.Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP, slopes=SLOPES) -> DataFrame:
    """(source, source_size, slope, target) from (source, size): the shares, by weight, of
    ``share`` times all sizes, none above ``cap`` times its source.

    What capped sources leave is shared again by weight until none is above: that ends at
    min(cap * size, level * weight) for one level, read off the sources in the order in
    which they fill up. Here one row stands for a whole source.
    """
    filling, whole = W.orderBy("fills", "source"), W.partitionBy()
    src = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(W.orderBy("source")))
        .withColumn("weight", _cycle(weights, F.col("rank")))
        .withColumn("slope", _cycle(slopes, F.col("rank")))
        .withColumn("room", F.col("source_size") * F.lit(float(cap)))
        .withColumn("fills", F.col("room") / F.col("weight"))
        .withColumn("asked", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("full", F.coalesce(F.sum("room").over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(filling.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("level", (F.col("asked") - F.col("full")) / F.col("rest"))
    )
    first = F.min(F.when(F.col("level") <= F.col("fills"), F.struct("fills", "source", "level"))).over(whole)
    level = F.coalesce(F.col("first.level"), F.col("fills"))
    return src.withColumn("first", first).select("source", "source_size", "slope", F.least("room", level * F.col("weight")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, taken_again
    (of ``taken``, by the second copy), position, position_again.

    Whole documents are taken from a source in order until its target is met: the last one
    if half of it at least lies within. ``position`` is the training time of a document's
    first copy and ``position_again`` that of its second (null: not taken). The result is
    range-sorted by position, untaken documents last. Null texts have size 0 and are not
    taken, a null source is a source of its own that comes last; rows that repeat are taken
    each for itself. Empty tables give an empty result; further columns are ignored.

    The order is that of a hash of the id or, only where ids repeat, of id and row number,
    so ties are broken alike in every run over the same files. A source may hold any share
    of the rows: it is cut into 4096 buckets by its order key, and only bucket sums are
    accumulated per source.
    """
    rows = settle(
        docs.select(
            column(id_col).alias("doc_id"),
            F.coalesce(F.concat(F.lit("s"), column(source_col).cast("string")), F.lit("z")).alias("source"),
            F.coalesce(F.regexp_count(column(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    if ids_repeat(rows, "doc_id"):
        name = F.concat_ws("#", name, F.col("row").cast("string"))
    rows = rows.withColumn("key", F.md5(name.cast("binary"))).withColumn("bucket", F.substring("key", 1, DIGITS))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    offsets = offsets.join(targets(rows, **options), "source")
    within = W.partitionBy("source", "bucket").orderBy("key", "row").rowsBetween(W.unboundedPreceding, -1)
    taken = lambda start: F.when(2 * start + F.col("size") <= 2 * F.col("words"), F.col("size")).otherwise(0)
    x = lambda start: start / F.col("words")
    at = lambda u: 2 * u / (1 + F.col("slope") + F.sqrt(F.pow(1 + F.col("slope"), F.lit(2)) - 4 * F.col("slope") * u))
    start, again = F.col("start"), F.col("start") + F.col("source_size")
    placed = (
        rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(offsets, ["source", "bucket"])
        .withColumn("start", F.col("offset") + F.col("inner"))
        .withColumn("words", F.floor(F.col("target") + 0.5))
        .withColumn("first", taken(start))
        .withColumn("second", taken(again))
    )
    return (
        placed.select(
            "doc_id",
            "size",
            "source_size",
            "target",
            (F.col("first") + F.col("second")).alias("taken"),
            F.col("second").alias("taken_again"),
            F.round(F.when(F.col("first") > 0, at(x(start))), 9).alias("position"),
            F.round(F.when(F.col("second") > 0, at(x(again))), 9).alias("position_again"),
        )
        .orderBy(F.col("position").asc_nulls_last(), "doc_id")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` as the mix reads them: a row per copy that ``mix`` takes, whole, range-sorted
    by position, the columns as they were. Rows without words (null and empty texts among
    them) are never taken; repeated rows, ties and empty tables are as in ``mix``."""
    keyed, key = row_keys(docs, id_col)
    at, of = fresh(keyed, "_at"), fresh(keyed, "_of")
    plan = mix(keyed, key, text_col, source_col, **options)
    plan = plan.select(F.col("doc_id").alias(of), F.explode(F.array("position", "position_again")).alias(at))
    plan = settle(plan.filter(F.col(at).isNotNull()))
    joined = keyed.join(plan.hint("merge"), keyed[key].eqNullSafe(plan[of]))
    return joined.orderBy(at, of).select(*[column(c) for c in docs.columns])
