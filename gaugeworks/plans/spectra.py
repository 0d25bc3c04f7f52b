"""Spectral queries: an embedding's squared components stand for a power spectrum of 64
bins, 187.5 Hz apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions.expr import tidy
from gaugeworks.operators import spectra as S
from gaugeworks.plans.registry import query, table

_P = """p AS (SELECT vec_id, label, unnest(embedding)::DOUBLE ** 2 AS p, unnest(range(64)) AS k FROM embeddings), f AS (SELECT *, k * 187.5::DOUBLE AS hz FROM p WHERE k > 0)"""


def spectrum(spark, sf_dir):
    power = F.transform("embedding", lambda e: e.cast("double") * e.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", power.alias("power"))


@query(
    "spectral_descriptors",
    f"""WITH {_P}, c AS (SELECT *, sum(p) OVER w AS upto, sum(p) OVER (PARTITION BY vec_id) AS total FROM f WINDOW w AS (PARTITION BY vec_id ORDER BY k)),
        m AS (SELECT vec_id, sum(hz * p) / sum(p) AS centroid FROM f GROUP BY vec_id)
        SELECT vec_id, round(max(centroid), 4) AS centroid_hz, round(sqrt(sum(p * (hz - centroid) ** 2) / sum(p)), 4) AS spread_hz, min(hz) FILTER (upto >= 0.85 * total - 1e-15) AS rolloff_hz,
               round(exp(avg(ln(greatest(p, 1e-30)))) / avg(p), 6) + 0.0 AS flatness, round(regr_slope(10 * log10(greatest(p, 1e-30)), log2(hz / 1000)), 4) + 0.0 AS slope_db_per_octave
        FROM c JOIN m USING (vec_id) GROUP BY vec_id""",
)
def spectral_descriptors(spark, sf_dir):
    return S.descriptors(spectrum(spark, sf_dir), ["vec_id"], 187.5)


@query(
    "band_levels",
    f"""WITH {_P}, b AS (SELECT vec_id, CASE WHEN hz < 60 THEN 0 WHEN hz < 120 THEN 1 WHEN hz < 250 THEN 2 WHEN hz < 500 THEN 3 WHEN hz < 1000 THEN 4 WHEN hz < 2000 THEN 5
            WHEN hz < 4000 THEN 6 WHEN hz < 8000 THEN 7 WHEN hz < 16000 THEN 8 ELSE 9 END AS band, p FROM f)
        SELECT vec_id, band, round(10 * log10(sum(p)), 6) + 0.0 AS level_db, round(10 * log10(sum(p)) - 10 * log10(sum(sum(p)) OVER (PARTITION BY vec_id)), 6) + 0.0 AS balance_db FROM b GROUP BY vec_id, band""",
)
def band_levels(spark, sf_dir):
    return S.band_levels(spectrum(spark, sf_dir), ["vec_id"], 187.5)


@query(
    "chroma",
    f"""WITH {_P}, n AS (SELECT vec_id, sqrt(p) * sqrt(440 / hz) AS w, (69 + 12 * log2(hz / 440)) AS midi FROM f WHERE hz BETWEEN 55 AND 5000),
        s AS (SELECT vec_id, CAST(floor(midi) AS BIGINT) % 12 AS pc, w * (1 - (midi - floor(midi))) AS w FROM n UNION ALL
              SELECT vec_id, CAST(floor(midi) + 1 AS BIGINT) % 12, w * (midi - floor(midi)) FROM n), t AS (SELECT vec_id, pc, sum(w) AS w FROM s GROUP BY ALL)
        SELECT vec_id, pc AS pitch_class, round(w / sqrt(sum(w * w) OVER (PARTITION BY vec_id)), 6) + 0.0 AS weight FROM t""",
)
def chroma(spark, sf_dir):
    return S.chroma(spectrum(spark, sf_dir), ["vec_id"], 187.5)


@query(
    "mode_extraction",
    f"""WITH {_P}, d AS (SELECT vec_id, k, p, 10 * log10(greatest(p, 1e-12)) AS db FROM p),
        w AS (SELECT *, lag(p) OVER w AS left_p, lead(p) OVER w AS right_p,
              (sum(db) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN 16 PRECEDING AND 16 FOLLOWING) - sum(db) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
              / nullif(count(*) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN 16 PRECEDING AND 16 FOLLOWING) - count(*) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) AS base
              FROM d WINDOW w AS (PARTITION BY vec_id ORDER BY k)),
        m AS (SELECT vec_id, k, p, round(db - base, 6) + 0.0 AS prominence_db FROM w WHERE p > left_p AND p >= right_p AND round(db - base, 6) >= 3)
        SELECT vec_id, k AS bin, k * 187.5::DOUBLE AS frequency_hz, prominence_db, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k) AS strength FROM m
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k) <= 4""",
)
def mode_extraction(spark, sf_dir):
    return S.modes(spectrum(spark, sf_dir), ["vec_id"], 187.5, 4)


@query(
    "cosine_similarity",
    """WITH a AS (SELECT vec_id, label, embedding, lag(vec_id) OVER w AS prior_id, lag(embedding) OVER w AS prior FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
       u AS (SELECT vec_id, prior_id, unnest(embedding)::DOUBLE AS x, unnest(prior)::DOUBLE AS y FROM a WHERE prior_id IS NOT NULL)
       SELECT vec_id, prior_id, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) + 0.0 AS similarity FROM u GROUP BY ALL""",
)
def cosine_similarity(spark, sf_dir):
    return S.similarity_to_prior(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding")


@query(
    "spectral_flux",
    """WITH a AS (SELECT vec_id, label, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prior FROM embeddings),
       u AS (SELECT vec_id, abs(unnest(embedding)::DOUBLE) AS x, abs(unnest(prior)::DOUBLE) AS y FROM a WHERE prior IS NOT NULL)
       SELECT vec_id, round(sum(greatest(x - y, 0)) / sum(x), 6) + 0.0 AS flux, round(sum(greatest(x - y, 0)) / sum(y), 6) + 0.0 AS flux_on_prior FROM u GROUP BY vec_id""",
)
def spectral_flux(spark, sf_dir):
    return S.flux(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding")


@query(
    "frame_cost",
    """WITH a AS (SELECT vec_id, label, embedding, lag(embedding) OVER w AS prior, lag(vec_id) OVER w AS prior_id FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
       u AS (SELECT vec_id, prior_id, unnest(embedding)::DOUBLE AS x, unnest(prior)::DOUBLE AS y FROM a WHERE prior_id IS NOT NULL),
       s AS (SELECT vec_id, prior_id, 1 - sum(abs(x) * abs(y)) / sqrt(sum(x * x) * sum(y * y)) AS chroma, abs(max(abs(x)) - max(abs(y))) AS onset,
             abs(10 * log10(avg(x * x)) - 10 * log10(avg(y * y))) / 24 AS level FROM u GROUP BY ALL)
       SELECT vec_id, prior_id, round((0.5 * chroma + 0.2 * least(onset, 1) + 0.1 * least(level, 1)) / 0.8, 6) + 0.0 AS cost FROM s""",
)
def frame_cost(spark, sf_dir):
    """Weighted mean of the evidence that both frames have: chroma, onset, level."""
    return S.frame_costs(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding")


@query(
    "mode_density",
    f"""WITH {_P}, w AS (SELECT vec_id, k, p, lag(p) OVER w AS a, lead(p) OVER w AS b FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY k))
        SELECT vec_id, count(*) FILTER (p > a AND p >= b) AS maxima, round(count(*) FILTER (p > a AND p >= b) / 12.0, 6)::DOUBLE AS body_mode_density_per_khz FROM w GROUP BY vec_id""",
)
def mode_density(spark, sf_dir):
    return S.density(spectrum(spark, sf_dir), ["vec_id"], 187.5)
