"""Gap reports: candidates of all sources in one form, families, scores, ranks, groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions.expr import clamp, tidy
from gaugeworks.functions.stats import OCCURS, candidate_score

#: Audibility by metric class.
AUDIBILITY = {"level": 0.85, "crest": 0.75, "pitch": 1.0, "timing": 1.0, "other": 0.70}
BAND_AUDIBILITY = (0.25, 0.35, 0.55, 0.75, 0.90, 1.0, 1.0, 0.90, 0.70, 0.45)
AXES = ("pitch", "register", "dynamic", "gesture", "element", "section")
MISSING = "unlabelled"


def audibility(metric: Column) -> Column:
    """Weight of a metric class; ``band:k`` has the band's."""
    table = AUDIBILITY | {f"band:{k}": w for k, w in enumerate(BAND_AUDIBILITY)}
    return F.coalesce(*[F.when(metric == name, w) for name, w in table.items()])


def union(sources: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, sources)


#: What a candidate has, and each of its cases carries.
CANDIDATE = ("source", "candidate", "kind", "family", "metric", "raw_value", "confidence", "flags")


def with_cases(candidates: DataFrame, cases: DataFrame, on: list[str], value: Column) -> DataFrame:
    """Each candidate with each of its cases: ``cases`` tells, by ``on``, what reference and
    model have in a case, ``value`` how far they are apart there (null where a side is
    missing). A candidate without a case has one row with no case."""
    rows = candidates.join(cases, on, "left").withColumn("value", tidy(value))
    score = tidy(clamp(F.abs("value"), 0.0, 1.0) * F.col("confidence"))
    return rows.select(*CANDIDATE, "case_id", "value", score.alias("case_score"))


def score_candidates(cases: DataFrame) -> DataFrame:
    """Size, audibility, occurrence, confidence_factor and score of the candidates in a table
    of their cases. Occurrence is the share of a candidate's available cases that reach one
    twelfth; none available: no occurrence."""
    reached = F.when(F.col("value").isNotNull(), F.when(F.abs("value") >= OCCURS, 1.0).otherwise(0.0))
    rows = cases.groupBy(*CANDIDATE).agg(tidy(F.avg(reached)).alias("occurrence"))
    rows = rows.withColumn("size", clamp(F.abs("raw_value"), 0.0, 1.0)).withColumn("audibility", audibility(F.col("metric")))
    rows = rows.withColumn("confidence_factor", F.col("confidence") / (1 + F.bit_count("flags")))
    return rows.withColumn("score", tidy(candidate_score(F.col("size"), F.col("audibility"), F.coalesce("occurrence", F.lit(0.0)), F.col("confidence_factor"))))


def _order() -> list:
    return [F.desc("score"), F.desc("size"), F.desc("occurrence"), F.desc("confidence_factor"), "family", "source", "kind", "candidate"]


def primaries(scored: DataFrame) -> DataFrame:
    """``primary``: the best of its source and family; ``rank``: among primaries, else 0."""
    w = W.partitionBy("source", "family").orderBy(F.col("score").isNull(), F.desc("score"), "kind", "candidate")
    rows = scored.withColumn("primary", F.row_number().over(w) == 1)
    # candidates are gaps between groups, far fewer than what was measured
    number = F.row_number().over(W.orderBy(~F.col("primary"), F.col("score").isNull(), *_order()))
    return rows.withColumn("rank", F.when(F.col("primary") & F.col("score").isNotNull(), number).otherwise(0).cast("long"))


def label_cases(cases: DataFrame, labels: DataFrame, on: list[str]) -> DataFrame:
    """Cases with the six axis labels; what has none gets a word of its own."""
    joined = cases.filter("case_id is not null and value is not null").join(labels, on, "left")
    return joined.select(*cases.columns, *[F.coalesce(F.col(a), F.lit(MISSING)).alias(a) for a in AXES])


def axis_groups(labelled: DataFrame, axes=AXES) -> DataFrame:
    """(axis, axis_value): spread of the candidates' best case scores within the group."""
    long = labelled.unpivot(["source", "candidate", "case_score"], list(axes), "axis", "axis_value")
    best = long.groupBy("axis", "axis_value", "source", "candidate").agg(F.max("case_score").alias("best"))
    q = F.percentile("best", F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    groups = best.groupBy("axis", "axis_value").agg(F.count(F.lit(1)).alias("candidates"), q.alias("q"))
    return groups.select("axis", "axis_value", "candidates", *[tidy(F.col("q")[k], 8).alias(n) for k, n in enumerate(("q05", "q25", "q50", "q75", "q95"))], tidy(F.col("q")[4] - F.col("q")[0], 8).alias("spread"))


def worst_cases(cases: DataFrame, most: int = 20) -> DataFrame:
    """The report's list of the worst available cases."""
    return cases.filter("value is not null").orderBy(F.desc("case_score"), F.desc(F.abs("value")), F.desc("confidence"), "source", "candidate", "case_id").limit(most)


def warnings(rules: list[tuple[DataFrame, str, str, Column]]) -> DataFrame:
    """Each (table, code, message, reference) as rows code, message, reference."""
    return union([df.select(F.lit(code).alias("code"), F.lit(text).alias("message"), ref.cast("string").alias("reference")) for df, code, text, ref in rules])


def same_rows(saved: DataFrame, derived: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with how often: empty if they are equal."""
    count = lambda df, n: df.groupBy(*df.columns).agg(F.sum(F.lit(n)).alias("n"))
    both = count(saved, 1).unionByName(count(derived, -1))
    return both.groupBy(*saved.columns).agg(F.sum("n").alias("surplus")).filter("surplus <> 0")
