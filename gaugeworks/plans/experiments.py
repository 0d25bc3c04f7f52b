"""Experiment queries: part size class and line number are parameters, the discount in per
cent is the response, the return flag the case."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions.expr import tidy
from gaugeworks.operators import experiments as X
from gaugeworks.plans.registry import query, table

LEVELS = {"gain": [0.0, 1.0, 2.0], "size": [1.0, 2.0, 4.0, 8.0], "tone": [0.5, 1.5]}
HOME = {"gain": 1.0, "size": 2.0, "tone": 0.5}
WEIGHTS = {"A": 1.0, "N": 2.0, "R": 3.0}

_OBS = """obs AS (SELECT p_size % 5 AS size_class, l_linenumber AS line, l_returnflag AS "case",
    CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 2.0 ELSE 3.0 END AS weight, CASE WHEN l_partkey % 997 <> 5 THEN l_discount * 100 END AS y FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_PTS = f"""{_OBS}, cell AS (SELECT size_class, line, "case", CASE WHEN bool_and(y IS NOT NULL) THEN avg(y) END AS cell, max(weight) AS weight, count(y) AS replicates FROM obs GROUP BY ALL),
    pt AS (SELECT size_class, line, CAST(sum(replicates) AS BIGINT) AS replicates, CASE WHEN count(cell) = (SELECT count(DISTINCT "case") FROM cell) THEN sum(weight * cell) / sum(weight) END AS mean_gap
           FROM cell GROUP BY size_class, line)"""


def observations(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 5).alias("size_class"))
    weight = F.coalesce(*[F.when(F.col("l_returnflag") == k, w) for k, w in WEIGHTS.items()])
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("case"), weight.alias("weight"), F.when(F.col("l_partkey") % 997 != 5, F.col("l_discount") * 100).alias("y"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("size_class", "line", "case", "weight", "y")


def points(spark, sf_dir):
    return X.candidates(observations(spark, sf_dir), ["size_class", "line"])


@query(
    "grid_plan",
    """WITH l AS (SELECT * FROM (VALUES (1, 0.0::DOUBLE), (2, 1.0), (3, 2.0)) a(i, gain), (VALUES (1, 1.0::DOUBLE), (2, 2.0), (3, 4.0), (4, 8.0)) b(j, size), (VALUES (1, 0.5::DOUBLE), (2, 1.5)) c(k, tone))
       SELECT row_number() OVER (ORDER BY NOT (gain = 1 AND size = 2 AND tone = 0.5), i, j, k) AS point, gain, size, tone FROM l""",
)
def grid_plan(spark, sf_dir):
    return X.grid_plan(spark, LEVELS, HOME)


@query(
    "oat_plan",
    """SELECT * FROM (VALUES (1::BIGINT, 1.0::DOUBLE, 2.0::DOUBLE, 0.5::DOUBLE), (2, 0.0, 2.0, 0.5), (3, 2.0, 2.0, 0.5), (4, 1.0, 1.0, 0.5), (5, 1.0, 4.0, 0.5), (6, 1.0, 8.0, 0.5), (7, 1.0, 2.0, 1.5)) t(point, gain, size, tone)""",
)
def oat_plan(spark, sf_dir):
    return X.one_at_a_time_plan(spark, LEVELS, HOME)


_M = "18446744073709551616::UHUGEINT"
_SPLITMIX = f"""WITH p AS (SELECT unnest(range(1, 1002)) AS point), d AS (SELECT point, k, CAST((42::UHUGEINT + greatest((point - 2) * 3 + k, 1)::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT) % {_M} AS UBIGINT) AS z
        FROM p, (SELECT unnest([1, 2, 3]) AS k)),
    a AS (SELECT point, k, CAST((xor(z, z >> 30)::UHUGEINT * {0xBF58476D1CE4E5B9}::UHUGEINT) % {_M} AS UBIGINT) AS z FROM d),
    b AS (SELECT point, k, CAST((xor(z, z >> 27)::UHUGEINT * {0x94D049BB133111EB}::UHUGEINT) % {_M} AS UBIGINT) AS z FROM a),
    u AS (SELECT point, k, CAST(xor(z, z >> 31) >> 11 AS DOUBLE) / 9007199254740992 AS u FROM b)
    SELECT point, CASE WHEN point = 1 THEN 1.0 ELSE 2 * max(u) FILTER (k = 1) END AS gain, CASE WHEN point = 1 THEN 2.0 ELSE 1 + 7 * max(u) FILTER (k = 2) END AS size,
           CASE WHEN point = 1 THEN 0.5 ELSE 0.5 + max(u) FILTER (k = 3) END AS tone FROM u GROUP BY point"""


@query("random_plan", _SPLITMIX)
def random_plan(spark, sf_dir):
    return X.random_plan(spark, {"gain": (0.0, 2.0), "size": (1.0, 8.0), "tone": (0.5, 1.5)}, HOME, seed=42, count=1000)


@query("experiment_candidates", f"WITH {_PTS} SELECT size_class, line, replicates, round(mean_gap, 6) + 0.0 AS mean_gap FROM pt")
def experiment_candidates(spark, sf_dir):
    return points(spark, sf_dir).withColumn("mean_gap", tidy(F.col("mean_gap")))


@query(
    "worst_harm",
    f"""WITH {_PTS}, h AS (SELECT "case", cell AS home FROM cell WHERE size_class = 0 AND line = 1)
        SELECT size_class, line, CASE WHEN count(cell - home) = (SELECT count(DISTINCT "case") FROM cell) THEN round(max(cell - home), 6) + 0.0 END AS worst_harm
        FROM cell LEFT JOIN h USING ("case") GROUP BY size_class, line""",
)
def worst_harm(spark, sf_dir):
    return X.harm(observations(spark, sf_dir), ["size_class", "line"], (F.col("size_class") == 0) & (F.col("line") == 1))


@query(
    "sensitivity",
    f"""WITH {_PTS}, l AS (SELECT 'size_class' AS parameter, size_class / 4.0 AS x, mean_gap FROM pt UNION ALL SELECT 'line', line, mean_gap FROM pt)
        SELECT parameter, count(mean_gap) AS points, round(regr_slope(mean_gap, x), 6) + 0.0 AS slope, round(corr(x, mean_gap), 6) + 0.0 AS pearson,
               round(corr(x, mean_gap) ** 2, 6) + 0.0 AS r_squared FROM l GROUP BY parameter""",
)
def sensitivity(spark, sf_dir):
    return X.sensitivity(points(spark, sf_dir), ["size_class", "line"], {"size_class": 4.0})


def _direction(p: str) -> str:
    return f"""SELECT '{p}' AS parameter, count(*) AS levels, CASE WHEN NOT coalesce(bool_or(d > 1e-6), false) AND NOT coalesce(bool_or(d < -1e-6), false) THEN 'FLAT'
        WHEN NOT coalesce(bool_or(d < -1e-6), false) THEN 'INCREASING' WHEN NOT coalesce(bool_or(d > 1e-6), false) THEN 'DECREASING' ELSE 'MIXED' END AS monotonicity
        FROM (SELECT round(m - lag(m) OVER (ORDER BY x), 9) AS d FROM (SELECT {p} AS x, avg(mean_gap) AS m FROM pt GROUP BY {p}))"""


@query("monotonicity", f"WITH {_PTS} {_direction('size_class')} UNION ALL {_direction('line')}")
def monotonicity(spark, sf_dir):
    rows = points(spark, sf_dir)
    return X.monotonicity(rows, "size_class").unionByName(X.monotonicity(rows, "line"))


def _effect(p: str) -> str:
    return f"""SELECT '{p}' AS parameter, CAST(sum(n) AS BIGINT) AS points, round(sum(n * (m - g) ** 2) / sum(n) / max(v), 6) + 0.0 AS effect
        FROM (SELECT {p}, avg(mean_gap) AS m, count(*) AS n FROM pt WHERE mean_gap IS NOT NULL GROUP BY {p}), (SELECT avg(mean_gap) AS g, var_pop(mean_gap) AS v FROM pt)"""


@query("main_effect", f"WITH {_PTS} {_effect('size_class')} UNION ALL {_effect('line')}")
def main_effect(spark, sf_dir):
    rows = points(spark, sf_dir)
    return X.main_effect(rows, "size_class").unionByName(X.main_effect(rows, "line"))


@query(
    "interaction",
    f"""WITH {_PTS}, i AS (SELECT size_class, line, mean_gap AS c, avg(mean_gap) OVER (PARTITION BY size_class) AS a, avg(mean_gap) OVER (PARTITION BY line) AS b,
            avg(mean_gap) OVER () AS g FROM pt WHERE mean_gap IS NOT NULL)
        SELECT 'size_class' AS "left", 'line' AS "right", count(*) AS points, round(avg((c - a - b + g) ** 2) / var_pop(c), 6) + 0.0 AS effect FROM i""",
)
def interaction(spark, sf_dir):
    return X.interaction(points(spark, sf_dir), "size_class", "line")


@query(
    "replicate_noise",
    f"""WITH {_OBS}, c AS (SELECT count(y) AS n, var_pop(y) AS v FROM obs GROUP BY size_class, line, "case" HAVING count(y) >= 2)
        SELECT CAST(sum(n) AS BIGINT) AS replicates, round(sqrt(sum(n * v) / sum(n)), 6) + 0.0 AS noise FROM c""",
)
def replicate_noise(spark, sf_dir):
    return X.replicate_noise(observations(spark, sf_dir), ["size_class", "line", "case"])
