"""Harmonic tracking of the embeddings' spectra: bins of 187.5 Hz, power by squares."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions.expr import BAND_EDGES, tidy
from gaugeworks.operators import harmonics as H
from gaugeworks.plans.registry import query, table

STEP = 187.5


def tracked(spark, sf_dir):
    """Each embedding as a spectrum, tracked around its strongest bin of 3 to 9."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") * v.cast("double")).alias("power"))
    low = F.slice("power", 4, 7)
    rows = rows.withColumn("bin_hz", F.lit(STEP)).withColumn("expected_hz", (2 + F.array_position(low, F.array_max(low))) * STEP)
    return H.track(rows)


def _peaks(name: str, source: str) -> str:
    """CTEs of the strongest bin near each place (vec_id, o, hz) of a source."""
    return f"""{name}_a AS (SELECT *, hz / {STEP} AS spot, greatest(2, ceil(hz / {STEP} * (pow(2, 35 / 1200.0) - 1))) AS wide, floor(hz / {STEP} + 0.5) AS mid FROM {source}),
    {name}_b AS (SELECT *, CASE WHEN mid > wide THEN mid - wide ELSE 1 END AS s, least(mid + wide, 62) AS e FROM {name}_a WHERE spot >= 1 AND spot < 63),
    {name}_c AS (SELECT vec_id, o, hz, s, e, arg_max(k, (p, -k)) AS best, max(p) AS top FROM {name}_b JOIN sp USING (vec_id) WHERE k BETWEEN s AND e GROUP BY ALL),
    {name}_d AS (SELECT c.vec_id, o, hz, best, top, avg(p) FILTER (abs(k - best) > 1 AND k BETWEEN CASE WHEN s > 3 THEN s - 3 ELSE 1 END AND least(e + 3, 63)) AS mean,
             max(ln(greatest(p, 1e-30))) FILTER (k = best - 1) AS l, max(ln(greatest(p, 1e-30))) FILTER (k = best) AS m, max(ln(greatest(p, 1e-30))) FILTER (k = best + 1) AS r
             FROM {name}_c c JOIN sp USING (vec_id) GROUP BY ALL),
    {name} AS MATERIALIZED (SELECT vec_id, o, hz, best, top, coalesce(top / greatest(mean, 1e-30), 0) AS stands,
             (best + CASE WHEN abs(l - 2 * m + r) > 2.22e-16 AND abs(0.5 * (l - r) / (l - 2 * m + r)) < 1 THEN 0.5 * (l - r) / (l - 2 * m + r) ELSE 0 END) * {STEP} AS found FROM {name}_d)"""


def _db(p: str) -> str:
    return f"CASE WHEN {p} > 1e-30 THEN 10 * log10({p}) ELSE -300 END"


def _band(hz: str) -> str:
    return " + ".join(f"CAST({hz} >= {edge} AS INT)" for edge in BAND_EDGES)


#: sp: bins; hv: a row a spectrum; hp: its partials; hb: its bands.
TRACKED = f"""sp AS MATERIALIZED (SELECT vec_id, k - 1 AS k, CAST(embedding[k] AS DOUBLE) * CAST(embedding[k] AS DOUBLE) AS p FROM embeddings, range(1, 65) AS r(k)),
    base AS (SELECT vec_id, CAST(arg_max(k, (p, -k)) FILTER (k BETWEEN 3 AND 9) * {STEP} AS DOUBLE) AS target, sum(p) FILTER (k > 0) AS total FROM sp GROUP BY vec_id),
    near_ AS (SELECT vec_id, o, target * o AS hz FROM base, range(1, 13) AS r(o) WHERE target * o < {63 * STEP * 0.98} AND {_db("total")} >= -100),
    {_peaks("rough", "near_")},
    pitched AS (SELECT vec_id, sum(top / sqrt(o) * found / o) / sum(top / sqrt(o)) AS pitch FROM rough WHERE stands >= 2.5 AND {_db("top")} >= -100 GROUP BY vec_id HAVING sum(top / sqrt(o)) > 0),
    right_ AS (SELECT vec_id, pitch FROM pitched JOIN base USING (vec_id) WHERE abs(1200 * log2(pitch / target)) <= 220),
    again AS (SELECT vec_id, o, pitch * o AS hz FROM right_, range(1, 13) AS r(o) WHERE pitch * o < {63 * STEP * 0.98}),
    {_peaks("fine", "again")},
    summed_ AS (SELECT t.vec_id, o, hz, found, stands, coalesce(sum(p), 0) AS power FROM fine t LEFT JOIN sp ON sp.vec_id = t.vec_id
              AND k BETWEEN CASE WHEN floor(found / {STEP} + 0.5) > 1 THEN floor(found / {STEP} + 0.5) - 1 ELSE 1 END AND least(floor(found / {STEP} + 0.5) + 1, 63) GROUP BY ALL),
    kept AS (SELECT vec_id, o, found, 1200 * log2(found / hz) AS cents, power FROM summed_ WHERE stands >= 2.5 AND {_db("power")} >= -100),
    sums AS (SELECT vec_id, pitch, least(sum(power), any_value(total)) AS harmonic FROM kept JOIN right_ USING (vec_id) JOIN base USING (vec_id) GROUP BY vec_id, pitch HAVING sum(power) > 0),
    hp AS MATERIALIZED (SELECT kept.* FROM kept JOIN sums USING (vec_id)),
    sides AS (SELECT vec_id, f, target * f AS hz FROM base, (VALUES (1.0::DOUBLE), (0.5), (2.0)) AS v(f) WHERE f = 1 OR (f = 0.5 AND target * f >= 20) OR (f = 2 AND target * f < {63 * STEP * 0.95})),
    spots AS (SELECT vec_id, f, o, hz * o / {STEP} AS spot FROM sides, range(1, 9) AS r(o) WHERE hz * o < {63 * STEP * 0.98}),
    scores AS (SELECT s.vec_id, f, sum(CASE WHEN k = floor(spot) THEN p * (1 - (spot - floor(spot))) ELSE p * (spot - floor(spot)) END / sqrt(o)) AS score FROM spots s JOIN sp ON sp.vec_id = s.vec_id AND k IN (floor(spot), floor(spot) + 1) GROUP BY ALL),
    turned AS (SELECT vec_id, coalesce(max(score) FILTER (f <> 1), 0) > 1.35 * coalesce(max(score) FILTER (f = 1), 0) AS fault FROM scores GROUP BY vec_id),
    hv AS MATERIALIZED (SELECT vec_id, target, pitch, harmonic, greatest(CASE WHEN total - coalesce(harmonic, 0) > 1e-9 * total THEN total - coalesce(harmonic, 0) ELSE 0 END, 1e-30) AS residual, coalesce(harmonic / greatest(total, 1e-30), 0) AS sure, harmonic IS NOT NULL AND fault AS fault
          FROM base LEFT JOIN sums USING (vec_id) LEFT JOIN turned USING (vec_id)),
    banded AS (SELECT vec_id, {_band(f"k * {STEP}")} AS band, sum(p) AS power FROM sp WHERE k > 0 GROUP BY ALL),
    taken AS (SELECT vec_id, {_band("found")} AS band, sum(power) AS power FROM hp GROUP BY ALL),
    hb AS MATERIALIZED (SELECT b.vec_id, b.band, coalesce(g.power, 0) AS power, CASE WHEN coalesce(g.power, 0) - coalesce(t.power, 0) > 1e-9 * g.power THEN g.power - coalesce(t.power, 0) ELSE 0 END AS residual
          FROM (SELECT vec_id, band FROM base, range(10) AS r(band)) b LEFT JOIN banded g USING (vec_id, band) LEFT JOIN taken t USING (vec_id, band))"""


@query(
    "harmonic_tracking",
    f"""WITH {TRACKED},
    ps AS (SELECT vec_id, count(*) AS partials, max(round(abs(cents), 6)) AS worst FROM hp GROUP BY vec_id),
    bs AS (SELECT vec_id, round(sum(residual), 9) AS left_over FROM hb GROUP BY vec_id)
    SELECT vec_id, target AS expected_hz, round(pitch, 6) AS pitch_hz, round(sure, 6) + 0.0 AS confidence, round(10 * log10(harmonic / residual), 6) AS hnr_db, round(residual, 9) AS residual_power,
           fault AS octave_fault, sure >= 0.3 AS valid, coalesce(partials, 0) AS partials, worst AS worst_cents, left_over AS residual_bands
    FROM hv LEFT JOIN ps USING (vec_id) LEFT JOIN bs USING (vec_id)""",
)
def harmonic_tracking(spark, sf_dir):
    """Pitch, partials, residual and octave faults of each spectrum."""
    rows = tracked(spark, sf_dir)
    cents = F.array_max(F.transform("partials", lambda p: F.round(F.abs(p["cents"]), 6)))
    left = F.aggregate("residual_band", F.lit(0.0), lambda a, v: a + v)
    return rows.select(
        "vec_id",
        "expected_hz",
        F.round("pitch_hz", 6).alias("pitch_hz"),
        tidy(F.col("confidence")).alias("confidence"),
        F.round("hnr_db", 6).alias("hnr_db"),
        F.round("residual_power", 9).alias("residual_power"),
        "octave_fault",
        "valid",
        F.greatest(F.coalesce(F.size("partials"), F.lit(0)), F.lit(0)).cast("long").alias("partials"),
        cents.alias("worst_cents"),
        F.round(left, 9).alias("residual_bands"),
    )
