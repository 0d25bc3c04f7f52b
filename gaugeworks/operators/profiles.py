"""Profiles: grouped distributions of measurements, and ranked gaps between two sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions.expr import tidy
from gaugeworks.functions.stats import QUANTILES, STATISTICS, profile_gap


def unpivot(df: DataFrame, ids: list[str], kinds: list[str]) -> DataFrame:
    """Long form: the id columns, kind, value."""
    return df.unpivot(ids, [F.col(k).cast("double").alias(k) for k in kinds], "kind", "value")


def by_selector(df: DataFrame, keys: list[str], labels: list[str], *aggregates) -> DataFrame:
    """Aggregates (selector, group_value, keys) of all rows (ALL) and of each label that a
    row has, by grouping sets: rows are combined before they are shuffled, never copied."""
    sets = [keys, *[[c, *keys] for c in labels]]
    flags = [F.grouping(c).alias(f"_{c}") for c in labels]
    found = df.groupingSets(sets, *labels, *keys).agg(*aggregates, *flags)
    selector, value = F.lit("ALL"), F.lit("")
    for c in labels:
        selector = F.when(F.col(f"_{c}") == 0, c).otherwise(selector)
        value = F.when(F.col(f"_{c}") == 0, F.col(c)).otherwise(value)
    found = found.withColumn("selector", selector).withColumn("group_value", value).filter((F.col("selector") == "ALL") | (F.col("group_value") != ""))
    return found.drop(*labels, *[f"_{c}" for c in labels])


def facts() -> list:
    """Aggregates of (value, confidence): counts, extremes, mean, population deviation,
    confidence. Null values are missing; missing rows weigh down the confidence."""
    v = F.col("value")
    return [
        F.count(F.lit(1)).alias("total_count"),
        F.count(v).alias("valid_count"),
        (F.count(F.lit(1)) - F.count(v)).alias("missing_count"),
        F.min(v).alias("minimum"),
        F.max(v).alias("maximum"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("population_sd"),
        (F.sum(F.when(v.isNotNull(), F.col("confidence")).otherwise(0.0)) / F.count(F.lit(1))).alias("confidence"),
    ]


#: Parts of an octave that values are binned by on the way to their quantiles.
OCTAVE = 256


def value_bin(v) -> F.Column:
    """A whole number that never falls as ``v`` rises, alike in every run."""
    size = F.floor(F.log2(F.abs(v)) * OCTAVE) + 2048 * OCTAVE
    return F.when(v > 0, size).when(v < 0, -size).otherwise(0)


def quantiles(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Five exact, interpolated quantiles of each group, from its values and their numbers n.

    A group may hold any share of the rows, so none is gathered: a histogram tells in which
    few bins a group's quantiles lie, and only the values in these are put in order.
    """
    counts = counts.filter("value is not null").withColumn("bin", value_bin(F.col("value")))
    whole, before = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = counts.groupBy(*keys, "bin").agg(F.sum("n").alias("here"))
    bins = bins.withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0))).withColumn("of", F.sum("here").over(whole))
    place = lambda p: (F.col("of") - 1) * F.lit(p)
    asked = F.array(*[end(place(p)) for p in QUANTILES.values() for end in (F.floor, F.ceil)])
    bins = bins.filter(F.exists(asked, lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("here"))))
    upto = F.sum("n").over(W.partitionBy(*keys, "bin").orderBy("value").rowsBetween(W.unboundedPreceding, 0)) + F.col("before")
    rows = counts.join(bins.select(*keys, "bin", "before", "of"), [*keys, "bin"]).withColumn("upto", upto)
    at = lambda k: F.max(F.when((F.col("upto") > k) & (F.col("upto") - F.col("n") <= k), F.col("value")))
    share = lambda p: F.max(place(p) - F.floor(place(p)))
    low = {q: at(F.floor(place(p))) for q, p in QUANTILES.items()}
    return rows.groupBy(*keys).agg(*[(low[q] + (at(F.ceil(place(p))) - low[q]) * share(p)).alias(q) for q, p in QUANTILES.items()])


def distributions(obs: DataFrame, keys: list[str]) -> DataFrame:
    """The statistics of each group of observations (keys, value, confidence)."""
    counts = obs.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    return obs.groupBy(*keys).agg(*facts()).join(quantiles(counts, keys), keys, "left").select(*keys, *STATISTICS)


def selector_facts(obs: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """``facts`` of the group ALL and each label's groups. Rows are read once, by all labels
    together; only these parts, far fewer, are dealt to the groups and put together there."""
    v = F.col("value")
    held = F.sum(F.when(v.isNotNull(), F.col("confidence")).otherwise(0.0)).alias("held")
    parts = obs.groupBy(*labels, *keys).agg(F.count(F.lit(1)).alias("total"), F.count(v).alias("valid"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("m"), F.var_pop(v).alias("s"), held)
    groups = ["selector", "group_value", *keys]
    of = [F.struct(F.lit(c).alias("selector"), g.cast("string").alias("group_value")) for c, g in (("ALL", F.lit("")), *((c, F.col(c)) for c in labels))]
    parts = parts.select("*", F.inline(F.array(*of))).filter((F.col("selector") == "ALL") | (F.col("group_value") != ""))
    whole = W.partitionBy(*groups)
    valid = F.sum("valid").over(whole)
    parts = parts.withColumn("mean", F.sum(F.col("valid") * F.col("m")).over(whole) / F.when(valid > 0, valid))
    apart = F.col("valid") * (F.col("s") + (F.col("m") - F.col("mean")) ** 2)
    return parts.groupBy(*groups).agg(
        F.sum("total").alias("total_count"),
        F.sum("valid").alias("valid_count"),
        (F.sum("total") - F.sum("valid")).alias("missing_count"),
        F.min("low").alias("minimum"),
        F.max("high").alias("maximum"),
        F.max("mean").alias("mean"),
        F.sqrt(F.sum(apart) / F.when(F.sum("valid") > 0, F.sum("valid"))).alias("population_sd"),
        (F.sum("held") / F.sum("total")).alias("confidence"),
    )


def selector_distributions(obs: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """The same for the group ALL and each label's groups."""
    groups = ["selector", "group_value", *keys]
    values = obs.groupBy(*labels, *keys, "value").agg(F.count(F.lit(1)).alias("c"))
    counts = by_selector(values, [*keys, "value"], labels, F.sum("c").alias("n"))
    return selector_facts(obs, keys, labels).join(quantiles(counts, groups), groups, "left").select(*groups, *STATISTICS)


def gaps(reference: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two sets of distributions and the gap of each pair."""
    r = reference.select(*keys, *[F.col(s).alias(f"r_{s}") for s in STATISTICS])
    m = model.select(*keys, *[F.col(s).alias(f"m_{s}") for s in STATISTICS])
    return _with_gap(r.join(m, keys, "full"))


def side_gaps(stats: DataFrame, keys: list[str], reference: str, model: str, side: str = "side") -> DataFrame:
    """The same of two sides of one set, brought together by one aggregation."""
    pick = lambda which, s: F.max(F.when(F.col(side) == which, F.col(s)))
    both = [pick(which, s).alias(f"{p}_{s}") for p, which in (("r", reference), ("m", model)) for s in STATISTICS]
    return _with_gap(stats.groupBy(*keys).agg(*both))


def _with_gap(pairs: DataFrame) -> DataFrame:
    return pairs.select("*", *[tidy(c).alias(n) for n, c in profile_gap().items()])


def ranked(df: DataFrame, by: list, score: str = "gap_score", name: str = "rank") -> DataFrame:
    """Ranks 1.. of the rows that have a score, 0 for the others. ``by`` orders wholly.

    Ranks are global, so this is for tables of gaps, which are far fewer than observations.
    """
    order = W.orderBy(F.col(score).isNull(), *by)
    return df.withColumn(name, F.when(F.col(score).isNotNull(), F.row_number().over(order)).otherwise(0).cast("long"))


def rank_gaps(df: DataFrame, keys: list[str]) -> DataFrame:
    return ranked(df, [F.desc("gap_score"), F.desc("quantile_distance"), F.desc(F.abs("median_delta")), *keys])


def compare_sides(facts: DataFrame, keys: list[str], reference: str, candidate: str, side: str = "side") -> DataFrame:
    """Signed difference, candidate less reference, of each fact (side, keys, value) that both have."""
    pick = lambda which: F.max(F.when(F.col(side) == which, tidy(F.col("value"))))
    known = F.count(F.when(F.col(side).isin(reference, candidate), 1)).alias("_sides")
    both = facts.groupBy(*keys).agg(pick(reference).alias("reference_value"), pick(candidate).alias("candidate_value"), known).filter("_sides = 2").drop("_sides")
    return both.withColumn("delta", tidy(F.col("candidate_value") - F.col("reference_value")))
