"""Modes of embeddings' spectra: each even vector is the reference of the odd one behind it."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import modes as M
from gaugeworks.plans.registry import query, table

STEP = 187.5

_SQL = f"""WITH RECURSIVE sp AS MATERIALIZED (SELECT vec_id, k - 1 AS k, CAST(embedding[k] AS DOUBLE) * CAST(embedding[k] AS DOUBLE) AS p FROM embeddings, range(1, 65) AS r(k)),
    tops AS (SELECT vec_id, k, p FROM (SELECT *, lag(p) OVER w AS l, lead(p) OVER w AS r FROM sp WINDOW w AS (PARTITION BY vec_id ORDER BY k))
             WHERE k BETWEEN 1 AND 62 AND p > l AND p >= r AND k * {STEP} BETWEEN 40 AND 0.49 * 126 * {STEP}),
    base AS (SELECT t.vec_id, t.k, t.p, avg(s.p) AS base FROM tops t JOIN sp s ON s.vec_id = t.vec_id AND s.k BETWEEN greatest(t.k - 16, 1) AND least(t.k + 16, 63) AND abs(s.k - t.k) > 2
             GROUP BY t.vec_id, t.k, t.p),
    stands AS (SELECT vec_id, k, p, 10 * log10(p / base) AS prominence FROM base WHERE base > 0 AND p > 0 AND 10 * log10(p / base) >= 3),
    wide AS (SELECT t.vec_id, t.k, t.prominence, max(s.k) FILTER (s.k BETWEEN 1 AND t.k AND (s.k = 1 OR s.p <= t.p / 2)) AS low, min(s.k) FILTER (s.k >= t.k AND (s.k = 63 OR s.p <= t.p / 2)) AS high
             FROM stands t JOIN sp s ON s.vec_id = t.vec_id GROUP BY t.vec_id, t.k, t.prominence),
    modes AS MATERIALIZED (SELECT vec_id // 2 AS c, vec_id % 2 AS side, row_number() OVER (PARTITION BY vec_id ORDER BY k) - 1 AS r, CAST(k * {STEP} AS DOUBLE) AS hz, prominence, CAST(greatest((high - low) * {STEP}, {STEP}) AS DOUBLE) AS bw FROM wide),
    walk AS (SELECT DISTINCT vec_id // 2 AS c, 0::BIGINT AS i, 0::BIGINT AS j FROM embeddings
             UNION ALL
             SELECT w.c, w.i + CASE WHEN m.hz - f.hz < -greatest(100, 0.15 * f.hz) THEN 0 ELSE 1 END, w.j + CASE WHEN m.hz - f.hz > greatest(100, 0.15 * f.hz) THEN 0 ELSE 1 END
             FROM walk w JOIN modes f ON f.c = w.c AND f.side = 0 AND f.r = w.i JOIN modes m ON m.c = w.c AND m.side = 1 AND m.r = w.j),
    pairs AS (SELECT w.c, row_number() OVER (PARTITION BY w.c ORDER BY w.i) - 1 AS n, f.hz AS a_hz, m.hz AS b_hz, f.bw AS a_bw, m.bw AS b_bw, f.prominence AS a_p, m.prominence AS b_p
              FROM walk w JOIN modes f ON f.c = w.c AND f.side = 0 AND f.r = w.i JOIN modes m ON m.c = w.c AND m.side = 1 AND m.r = w.j WHERE abs(m.hz - f.hz) <= greatest(100, 0.15 * f.hz)),
    cases AS (SELECT DISTINCT vec_id // 2 AS c FROM embeddings),
    sides AS (SELECT e.c, e.side, count(m.hz) / 11.8125 AS density FROM (SELECT vec_id // 2 AS c, vec_id % 2 AS side FROM embeddings) e LEFT JOIN modes m ON m.c = e.c AND m.side = e.side GROUP BY e.c, e.side),
    v AS (SELECT c, coalesce(n, 0) AS "index", unnest(['body_mode_frequency_hz', 'body_mode_bandwidth_hz', 'body_mode_q', 'body_mode_prominence_db', 'body_mode_decay_seconds']) AS kind,
                 unnest([a_hz, a_bw, a_hz / a_bw, a_p, ln(1000) / (pi() * a_bw)]) AS rv, unnest([b_hz, b_bw, b_hz / b_bw, b_p, ln(1000) / (pi() * b_bw)]) AS mv FROM cases LEFT JOIN pairs USING (c)
          UNION ALL SELECT c, 0, 'body_mode_density_per_khz', max(density) FILTER (side = 0), max(density) FILTER (side = 1) FROM sides GROUP BY c),
    d AS (SELECT c, "index", kind, round(rv, 6) + 0.0 AS reference_value, round(mv, 6) + 0.0 AS model_value, round(round(mv, 6) - round(rv, 6), 6) + 0.0 AS delta FROM v
          UNION ALL SELECT c, 0, 'body_mode_distance_cents', NULL, NULL, round(avg(abs(1200 * log2(b_hz / a_hz))), 6) + 0.0 FROM cases LEFT JOIN pairs USING (c) GROUP BY c)
    SELECT 'body' AS scope, CAST(c AS VARCHAR) AS "case", kind, "index", reference_value, model_value, delta, CASE WHEN delta IS NULL THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS availability FROM d"""


@query("body_mode_pairs", _SQL)
def body_mode_pairs(spark, sf_dir):
    """Facts of every pair of modes of two spectra, above a local baseline."""
    rows = table(spark, sf_dir, "embeddings")
    power = F.transform("embedding", lambda e: e.cast("double") * e.cast("double"))
    side = F.when(F.col("vec_id") % 2 == 0, "reference").otherwise("model")
    return M.mode_checks(rows.select(F.floor(F.col("vec_id") / 2).cast("string").alias("case"), side.alias("side"), power.alias("power"), F.lit(STEP).alias("bin_hz")))
