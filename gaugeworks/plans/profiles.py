"""Profile queries over lineitem and part: returned items (A) against the model (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions.expr import tidy
from gaugeworks.functions.stats import STATISTICS
from gaugeworks.operators import profiles as P
from gaugeworks.plans.registry import query, table

KINDS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS = ["selector", "group_value", "kind"]

_OBS = """
    base AS (SELECT l_returnflag AS side, p_brand, p_type, l_linenumber AS line, 1 - l_tax AS confidence, l_quantity, l_extendedprice, l_discount, l_tax
             FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('A', 'R')),
    long AS (SELECT side, p_brand, p_type, line, confidence, 'l_quantity' AS kind, l_quantity AS value FROM base
             UNION ALL SELECT side, p_brand, p_type, line, confidence, 'l_extendedprice', l_extendedprice FROM base
             UNION ALL SELECT side, p_brand, p_type, line, confidence, 'l_discount', nullif(l_discount, 0) FROM base
             UNION ALL SELECT side, p_brand, p_type, line, confidence, 'l_tax', l_tax FROM base),
    obs AS (SELECT side, 'ALL' AS selector, '' AS group_value, line, kind, value, confidence FROM long
            UNION ALL SELECT side, 'p_brand', p_brand, line, kind, value, confidence FROM long
            UNION ALL SELECT side, 'p_type', p_type, line, kind, value, confidence FROM long),
    stat AS (SELECT side, selector, group_value, kind, count(*) AS total_count, count(value) AS valid_count, count(*) - count(value) AS missing_count,
             min(value) AS minimum, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50,
             quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.95) AS q95, max(value) AS maximum, avg(value) AS mean,
             stddev_pop(value) AS population_sd, sum(CASE WHEN value IS NOT NULL THEN confidence ELSE 0 END) / count(*) AS confidence
             FROM obs GROUP BY side, selector, group_value, kind)"""

_GAPS = f"""
    {_OBS},
    pair AS (SELECT coalesce(r.selector, m.selector) AS selector, coalesce(r.group_value, m.group_value) AS group_value, coalesce(r.kind, m.kind) AS kind,
             r.valid_count AS n1, m.valid_count AS n2, r.total_count AS t1, m.total_count AS t2, m.mean - r.mean AS dm, m.q50 - r.q50 AS dq,
             (abs(m.q05 - r.q05) + abs(m.q25 - r.q25) + abs(m.q50 - r.q50) + abs(m.q75 - r.q75) + abs(m.q95 - r.q95)) / 5 AS qd,
             sqrt((r.valid_count * r.population_sd ** 2 + m.valid_count * m.population_sd ** 2) / (r.valid_count + m.valid_count)) AS pooled,
             (r.q75 - r.q25 + m.q75 - m.q25) / (2 * 1.349) AS spread
             FROM (SELECT * FROM stat WHERE side = 'A') r FULL JOIN (SELECT * FROM stat WHERE side = 'R') m
             ON r.selector = m.selector AND r.group_value = m.group_value AND r.kind = m.kind),
    part2 AS (SELECT *, greatest(pooled, spread) AS scale, least(n1 / t1, n2 / t2) AS coverage,
              CASE WHEN pooled > 0 THEN abs(dm / pooled) / (1 + abs(dm / pooled)) WHEN dm = 0 THEN 0 ELSE 1 END AS mean_part FROM pair),
    gap AS (SELECT selector, group_value, kind, round(dm, 6) + 0.0 AS mean_delta, round(dq, 6) + 0.0 AS median_delta, round(qd, 6) + 0.0 AS quantile_distance,
            round(coverage, 6) + 0.0 AS valid_coverage, pooled,
            round(coverage * (mean_part + CASE WHEN scale > 0 THEN (qd / scale) / (1 + qd / scale) WHEN qd = 0 THEN 0 ELSE 1 END) / 2, 6) + 0.0 AS gap_score
            FROM part2)"""


LABELS = ["p_brand", "p_type"]


def observations(spark, sf_dir):
    """(side, p_brand, p_type, line, kind, value, confidence); no discount counts as missing."""
    items = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("A", "R"))
    items = items.select("l_partkey", F.col("l_returnflag").alias("side"), F.col("l_linenumber").alias("line"), *KINDS)
    # what is computed comes behind the join, so that all that read it share one exchange
    labelled = items.join(table(spark, sf_dir, "part").select("p_partkey", *LABELS), F.col("l_partkey") == F.col("p_partkey")).withColumn("confidence", 1 - F.col("l_tax"))
    long = P.unpivot(labelled, ["side", *LABELS, "line", "confidence"], KINDS)
    return long.withColumn("value", F.when((F.col("kind") == "l_discount") & (F.col("value") == 0), None).otherwise(F.col("value")))


def statistics(spark, sf_dir):
    return P.selector_distributions(observations(spark, sf_dir), ["side", "kind"], LABELS)


def ranked_gaps(spark, sf_dir):
    return P.rank_gaps(P.side_gaps(statistics(spark, sf_dir), KEYS, "A", "R"), KEYS)


@query(
    "profile_statistics",
    f"""WITH {_OBS} SELECT side, selector, group_value, kind, total_count, valid_count, missing_count,
        {', '.join(f'round({s}, 6) + 0.0 AS {s}' for s in STATISTICS[3:])} FROM stat""",
)
def profile_statistics(spark, sf_dir):
    stats = statistics(spark, sf_dir)
    return stats.select("side", *KEYS, *STATISTICS[:3], *[tidy(F.col(s)).alias(s) for s in STATISTICS[3:]])


@query(
    "profile_gap_rank",
    f"""WITH {_GAPS} SELECT * EXCLUDE (pooled), CASE WHEN gap_score IS NULL THEN 0 ELSE row_number() OVER (ORDER BY gap_score IS NULL, gap_score DESC,
        quantile_distance DESC, abs(median_delta) DESC, selector, group_value, kind) END AS rank FROM gap""",
)
def profile_gap_rank(spark, sf_dir):
    return ranked_gaps(spark, sf_dir).select(*KEYS, "mean_delta", "median_delta", "quantile_distance", "valid_coverage", "gap_score", "rank")


@query(
    "signed_compare",
    f"""WITH {_OBS}, fact AS (SELECT side, selector, group_value, kind, unnest(['mean', 'q50', 'maximum']) AS fact, unnest([mean, q50, maximum]) AS v FROM stat)
        SELECT r.selector, r.group_value, r.kind, r.fact, round(r.v, 6) + 0.0 AS reference_value, round(m.v, 6) + 0.0 AS candidate_value,
               round(round(m.v, 6) - round(r.v, 6), 6) + 0.0 AS delta
        FROM (SELECT * FROM fact WHERE side = 'A') r JOIN (SELECT * FROM fact WHERE side = 'R') m USING (selector, group_value, kind, fact)""",
)
def signed_compare(spark, sf_dir):
    stats = statistics(spark, sf_dir).unpivot(["side", *KEYS], ["mean", "q50", "maximum"], "fact", "value")
    return P.compare_sides(stats, [*KEYS, "fact"], "A", "R")
