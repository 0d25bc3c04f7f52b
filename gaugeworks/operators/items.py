"""Items: ties, chords, edits, element distances and explicit catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions.expr import tidy
from gaugeworks.operators.series import islands


def tie_groups(events: DataFrame, part: list[str], order: list[str], state: str, event: str) -> DataFrame:
    """Runs of events of one state in a part: a start and what continues it."""
    runs = islands(events, part, order, F.col(state)).withColumn("note_group", F.col("island"))
    first = F.min_by(event, F.struct(*order))
    return runs.groupBy(*part, "note_group").agg(first.alias("first_event"), F.count(F.lit(1)).alias("members"))


def chords(events: DataFrame, part: list[str], beat: str, event: str, tolerance: float) -> DataFrame:
    """Notes that start together, each within ``tolerance`` of the one before."""
    w = W.partitionBy(*part).orderBy(beat, event)
    turn = F.when(F.abs(F.col(beat) - F.lag(beat).over(w)) < tolerance, 0).otherwise(1)
    rows = events.withColumn("_turn", turn).withColumn("chord", F.sum("_turn").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*part, "chord").agg(F.count(F.lit(1)).alias("notes"), F.min(beat).alias("beat")).filter("notes > 1")


def apply_edits(items: DataFrame, edits: DataFrame) -> DataFrame:
    """``items`` (item, end_bound) with edits (item, action, bound, reason): exclude names a
    reason, lock sets the bound, drop removes the item."""
    rows = items.join(edits, "item", "left").filter(F.col("action").isNull() | (F.col("action") != "drop"))
    lock = F.coalesce(F.col("action") == "lock", F.lit(False))
    return rows.select(
        "item", F.when(F.col("action") == "exclude", F.col("reason")).alias("exclusion_reason"), F.when(lock, F.col("bound")).otherwise(F.col("end_bound")).alias("end_bound"), lock.alias("locked")
    )


def element_distances(traits: DataFrame, reference: str, model: str, least: int = 4) -> DataFrame:
    """Root mean square of the differences of scaled traits (element, side, trait, v), for
    each pair of elements of either side. Elements are groups, a few dozen."""
    a = traits.select(F.col("element").alias("left_element"), "side", "trait", F.col("v").alias("a"))
    b = traits.select(F.col("element").alias("right_element"), "side", "trait", F.col("v").alias("b"))
    apart = (F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))
    pairs = a.join(b, ["side", "trait"]).filter("left_element < right_element").groupBy("left_element", "right_element", "side").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(apart)).alias("d"))
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("d")))
    both = pairs.filter(F.col("n") >= least).groupBy("left_element", "right_element").agg(side(reference).alias("r"), side(model).alias("m"))
    return both.select("left_element", "right_element", tidy(F.col("r")).alias("reference_distance"), tidy(F.col("m")).alias("model_distance"), tidy(F.col("m") - F.col("r")).alias("delta"))


def expand(entities: DataFrame, kinds: list[int], facts: DataFrame, key: list[str]) -> DataFrame:
    """Every entity by every kind of a fixed catalogue, with its fact or without."""
    every = entities.withColumn("kind", F.explode(F.array(*[F.lit(k).cast("long") for k in kinds])))
    rows = every.join(facts, [*key, "kind"], "left")
    return rows.select(*key, "kind", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "UNAVAILABLE").otherwise("AVAILABLE").alias("availability"))


def probe_index(sample: Column, start: int, numerator: int, denominator: int, rate: int) -> Column:
    """floor((sample - start) * numerator / (rate * denominator)) in whole numbers: a probe
    of numerator / denominator values a second, read at a sample of a clock of ``rate``."""
    n = (sample.cast("decimal(20,0)") - F.lit(start)) * F.lit(numerator).cast("decimal(10,0)")
    d = F.lit(rate * denominator).cast("decimal(20,0)")
    rest = ((n % d) + d) % d
    return ((n - rest) / d).cast("long")
