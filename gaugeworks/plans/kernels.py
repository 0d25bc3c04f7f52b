"""Queries that run numeric kernels, with SQL written from their definitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gaugeworks.operators import kernels as K
from gaugeworks.operators.alignment import align_pairs
from gaugeworks.plans.registry import query, table
from gaugeworks.plans.signals import _X, samples

RATE = 48.0


def _series(spark, sf_dir):
    return samples(spark, sf_dir).select("user_id", "n", "x")


#: Frames of 32 samples every 8, windowed, by plain sums: transform, autocorrelation, phases.
_FRAMES = f"""WITH {_X}, lasts AS (SELECT user_id, count(*) AS c FROM x GROUP BY user_id),
    fr AS (SELECT user_id, f AS frame, n - 8 * f AS j, x FROM x JOIN lasts USING (user_id), range(1000000) AS r(f) WHERE 8 * f + 32 <= c AND n >= 8 * f AND n < 8 * f + 32),
    w AS (SELECT user_id, frame, j, x * (0.5 - 0.5 * cos(2 * pi() * j / 32)) AS v,
          (x - avg(x) OVER (PARTITION BY user_id, frame)) * (0.5 - 0.5 * cos(2 * pi() * j / 32)) AS u FROM fr),
    z AS (SELECT user_id, frame, b, sum(v * cos(2 * pi() * b * j / 32)) AS re, -sum(v * sin(2 * pi() * b * j / 32)) AS im FROM w, range(17) AS r(b) GROUP BY ALL),
    mag AS (SELECT *, sqrt(re * re + im * im) AS m, atan2(im, re) AS a FROM z),
    peak AS (SELECT user_id, frame, arg_max(b, (power, -b)) AS peak_bin FROM
             (SELECT user_id, frame, b, m * m * CASE WHEN b < 16 THEN 2 ELSE 1 END AS power FROM mag WHERE b > 0) GROUP BY ALL),
    turn AS (SELECT user_id, frame, m, a - 2 * lag(a) OVER s + lag(a, 2) OVER s AS d FROM mag WINDOW s AS (PARTITION BY user_id, b ORDER BY frame)),
    phase AS (SELECT user_id, frame, CASE WHEN frame < 2 THEN 0 ELSE sum(m * abs(sin(d / 2))) / greatest(sum(m), 1e-30) END AS phase_onset FROM turn GROUP BY user_id, frame),
    r AS (SELECT l.user_id, l.frame, k, sum(l.u * h.u) AS r FROM w l JOIN w h USING (user_id, frame), range(18) AS g(k) WHERE h.j = l.j + k AND (k = 0 OR k > 2) GROUP BY ALL),
    top AS (SELECT user_id, frame, max(r) FILTER (k = 0) AS r0, arg_max(k, (r, -k)) FILTER (k BETWEEN 4 AND 16) AS k FROM r GROUP BY ALL),
    tri AS (SELECT t.user_id, t.frame, t.k, any_value(r0) AS r0, max(r) FILTER (r.k = t.k) AS y, max(r) FILTER (r.k = t.k - 1) AS y1, max(r) FILTER (r.k = t.k + 1) AS y2
            FROM top t JOIN r USING (user_id, frame) GROUP BY ALL)
    SELECT user_id, frame, peak_bin, CASE WHEN r0 > 0 AND y / r0 >= 0.3 THEN round(48 / (k + coalesce(0.5 * (y1 - y2) / nullif(y1 - 2 * y + y2, 0), 0)), 6) END AS pitch_hz,
           CASE WHEN r0 > 0 THEN round(y / r0, 6) ELSE 0 END AS confidence, round(phase_onset, 6) AS phase_onset
    FROM tri JOIN peak USING (user_id, frame) JOIN phase USING (user_id, frame)"""
#: A sample at a time: a shelf and a high pass, two state values each.
_FILTER = f"""WITH RECURSIVE {_X}, xs AS MATERIALIZED (SELECT user_id, n, x FROM x),
    shape AS (SELECT pow(10, 3.99984385397 / 40) AS g, 2 * pi() * 1681.974450955533 / 48000 AS w, 2 * pi() * 38.13547087602444 / 48000 AS v),
    root AS (SELECT g, cos(w) AS c, 2 * sqrt(g) * sin(w) / 2 * sqrt(2.0) AS r, cos(v) AS d, sin(v) / (2 * 0.5003270373) AS e FROM shape),
    q AS MATERIALIZED (SELECT g * (g + 1 + (g - 1) * c + r) / a0 AS b0, -2 * g * (g - 1 + (g + 1) * c) / a0 AS b1, g * (g + 1 + (g - 1) * c - r) / a0 AS b2,
          2 * (g - 1 - (g + 1) * c) / a0 AS a1, (g + 1 - (g - 1) * c - r) / a0 AS a2, (1 + d) / 2 / (1 + e) AS h, -2 * d / (1 + e) AS p1, (1 - e) / (1 + e) AS p2
          FROM (SELECT *, g + 1 - (g - 1) * c + r AS a0 FROM root)),
    run AS (SELECT user_id, n, u, b1 * x - a1 * u AS s1, b2 * x - a2 * u AS s2, h * u AS y, -2 * h * u - p1 * h * u AS t1, h * u - p2 * h * u AS t2
            FROM (SELECT user_id, n, x, b0 * x AS u FROM xs, q WHERE n = 0), q
            UNION ALL
            SELECT user_id, n, u, b1 * x - a1 * u + o2, b2 * x - a2 * u, h * u + o3, -2 * h * u - p1 * (h * u + o3) + o4, h * u - p2 * (h * u + o3)
            FROM (SELECT xs.user_id, xs.n, xs.x, q.b0 * xs.x + run.s1 AS u, run.s2 AS o2, run.t1 AS o3, run.t2 AS o4 FROM run JOIN xs ON xs.user_id = run.user_id AND xs.n = run.n + 1, q), q)
    SELECT user_id, round(avg(y * y), 9) AS power, round(arg_max(y, n), 9) AS last FROM run GROUP BY user_id"""
_PEAK = f"""WITH {_X}, own AS (SELECT user_id, count(*) AS c, max(abs(x)) AS sample_peak FROM x GROUP BY user_id),
    y AS (SELECT user_id, n - k AS m, ph, sum(x * sin(pi() * (ph - k)) / (pi() * (ph - k)) * sin(pi() * (ph - k) / 16) / (pi() * (ph - k) / 16)) AS y
          FROM x, range(-15, 17) AS r(k), (VALUES (0.25::DOUBLE), (0.5), (0.75)) AS p(ph) GROUP BY ALL),
    tops AS (SELECT user_id, max(abs(y)) AS top FROM y JOIN own USING (user_id) WHERE m BETWEEN -1 AND c - 1 GROUP BY user_id)
    SELECT user_id, sample_peak, round(greatest(sample_peak, top), 9) AS true_peak FROM own JOIN tops USING (user_id)"""
_VIBRATO = f"""WITH {_X}, line AS (SELECT user_id, count(*) AS c, regr_slope(x * 100, n) AS a, regr_intercept(x * 100, n) AS b FROM x GROUP BY user_id),
    y AS (SELECT user_id, n, c, x * 100 - a * n - b AS y FROM x JOIN line USING (user_id) WHERE c >= 4),
    r AS (SELECT l.user_id, k, sum(l.y * h.y) / sqrt(sum(l.y * l.y) * sum(h.y * h.y) + 1e-30) AS r
          FROM y l JOIN y h USING (user_id), range(6, 17) AS g(k) WHERE h.n = l.n + k AND k <= l.c // 2 GROUP BY ALL),
    best AS (SELECT user_id, arg_max(k, (r, -k)) AS k, max(r) AS r FROM r GROUP BY user_id),
    own AS (SELECT user_id, avg(y * y) AS p FROM y GROUP BY user_id),
    good AS (SELECT user_id, k, r, p FROM best JOIN own USING (user_id) WHERE r >= 0.25 AND p >= 1e-12)
    SELECT user_id, round(48.0 / k, 6) AS rate_hz, round(sqrt(2 * p), 6) AS depth_cents, round(1 - r, 6) AS residual FROM line LEFT JOIN good USING (user_id)"""
_DECAY = f"""WITH {_X}, e AS (SELECT user_id, n, count(*) OVER (PARTITION BY user_id) AS c,
          sum(x * exp(-n / 10.0) * x * exp(-n / 10.0)) OVER (PARTITION BY user_id ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS e FROM x),
    whole AS (SELECT user_id, e AS e0 FROM e WHERE n = 0),
    spots AS (SELECT DISTINCT user_id, c, CASE WHEN i = 63 THEN c - 1 ELSE CAST(floor(i * ((c - 1) / 63.0::DOUBLE)) AS BIGINT) END AS n FROM (SELECT DISTINCT user_id, c FROM e), range(64) AS r(i)),
    d AS (SELECT user_id, n / 48.0 AS t, 10 * log10(greatest(e / e0, 1e-30)) AS y FROM spots JOIN e USING (user_id, n) JOIN whole USING (user_id) WHERE e0 > 0),
    fit AS (SELECT user_id, regr_slope(y, t) AS slope, pow(corr(y, t), 2) AS r2 FROM d WHERE y BETWEEN -25 AND -5 GROUP BY user_id HAVING count(*) >= 4)
    SELECT user_id, CASE WHEN slope < 0 AND r2 >= 0.8 THEN round(-60 / slope, 6) END AS decay_seconds, round(r2, 6) AS r_squared FROM whole LEFT JOIN fit USING (user_id)"""
_PARTIALS = """WITH p AS (SELECT vec_id, k - 1 AS k, CAST(embedding[k] AS DOUBLE) * CAST(embedding[k] AS DOUBLE) AS power FROM embeddings, range(1, 65) AS r(k)),
    base AS (SELECT vec_id, arg_max(k, (power, -k)) AS b FROM p WHERE k BETWEEN 2 AND 9 GROUP BY vec_id),
    span AS (SELECT vec_id, o, b * o AS f, greatest(1, floor(b * o * pow(2, -35 / 1200.0))) AS low, least(62, ceil(b * o * pow(2, 35 / 1200.0))) AS high FROM base, range(1, 13) AS r(o)),
    top AS (SELECT vec_id, o, f, arg_max(k, (power, -k)) AS k, max(power) AS power FROM span JOIN p USING (vec_id) WHERE k BETWEEN low AND high GROUP BY ALL),
    tri AS (SELECT t.*, ln(greatest(t.power, 1e-30)) AS m, ln(greatest(a.power, 1e-30)) AS l, ln(greatest(b.power, 1e-30)) AS r
            FROM top t JOIN p a ON a.vec_id = t.vec_id AND a.k = t.k - 1 JOIN p b ON b.vec_id = t.vec_id AND b.k = t.k + 1),
    place AS (SELECT *, k + CASE WHEN m > greatest(l, r) THEN 0.5 * (l - r) / (l - 2 * m + r) ELSE 0 END AS x FROM tri)
    SELECT vec_id, o AS partial, round(x * 187.5, 6) AS hz, round(1200 * log2(x / f), 6) AS cents, round(power, 9) AS power FROM place"""


@query("fft_pitch", _FRAMES)
def fft_pitch(spark, sf_dir):
    """Spectral peak and autocorrelation pitch of each 32-sample frame."""

    def run(rows):
        fr = K.frames(rows["x"].to_numpy(), 32, 8)
        p = K.power_spectrum(fr)
        found = [K.pitch(f, RATE, 3.0, 12.0) for f in fr]
        return pd.DataFrame(
            {
                "user_id": rows["user_id"].iloc[0],
                "frame": np.arange(len(fr)),
                "peak_bin": p[:, 1:].argmax(1) + 1 if len(fr) else np.zeros(0, int),
                "pitch_hz": [round(f[0], 6) for f in found],
                "confidence": [round(f[1], 6) for f in found],
                "phase_onset": K.phase_onset(fr).round(6),
            }
        )

    return K.per_series(_series(spark, sf_dir), ["user_id"], ["n"], run, "user_id long, frame long, peak_bin long, pitch_hz double, confidence double, phase_onset double")


@query("k_weighting", _FILTER)
def k_weighting(spark, sf_dir):
    def run(rows):
        y = K.k_weighted(rows["x"].to_numpy(), 48000.0)
        return pd.DataFrame({"user_id": [rows["user_id"].iloc[0]], "power": [round(float((y * y).mean()), 9)], "last": [round(float(y[-1]), 9)]})

    return K.per_series(_series(spark, sf_dir), ["user_id"], ["n"], run, "user_id long, power double, last double")


@query("true_peak", _PEAK)
def true_peak(spark, sf_dir):
    def run(rows):
        x = rows["x"].to_numpy()
        return pd.DataFrame({"user_id": [rows["user_id"].iloc[0]], "sample_peak": [float(np.abs(x).max())], "true_peak": [round(K.true_peak(x), 9)]})

    return K.per_series(_series(spark, sf_dir), ["user_id"], ["n"], run, "user_id long, sample_peak double, true_peak double")


@query("vibrato", _VIBRATO)
def vibrato(spark, sf_dir):
    def run(rows):
        rate, depth, rest = K.vibrato(rows["x"].to_numpy() * 100, 1 / RATE)
        return pd.DataFrame({"user_id": [rows["user_id"].iloc[0]], "rate_hz": [rate], "depth_cents": [depth], "residual": [rest]}).round(6)

    return K.per_series(_series(spark, sf_dir), ["user_id"], ["n"], run, "user_id long, rate_hz double, depth_cents double, residual double")


@query("room_decay", _DECAY)
def room_decay(spark, sf_dir):
    def run(rows):
        x = rows["x"].to_numpy() * np.exp(-np.arange(len(rows)) / 10)
        seconds, fit = K.decay_seconds(x, RATE)
        return pd.DataFrame({"user_id": [rows["user_id"].iloc[0]], "decay_seconds": [seconds], "r_squared": [fit]}).round(6)

    return K.per_series(_series(spark, sf_dir), ["user_id"], ["n"], run, "user_id long, decay_seconds double, r_squared double")


@query("harmonic_peaks", _PARTIALS)
def harmonic_peaks(spark, sf_dir):
    """Partials of the strongest low bin of each embedding's power."""

    def run(batches):
        for rows in batches:
            out = []
            for i, e in zip(rows["vec_id"], rows["embedding"]):
                p = np.asarray(e, float) ** 2
                k = 2 + int(np.argmax(p[2:10]))
                out += [(i, order, round(hz, 6), round(cents, 6), round(power, 9)) for order, hz, cents, power in K.harmonics(p, k * 187.5, 187.5)]
            yield pd.DataFrame(out, columns=["vec_id", "partial", "hz", "cents", "power"])

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rows.mapInPandas(run, "vec_id long, partial long, hz double, cents double, power double")


def _distance(x, y):
    return np.minimum(np.abs(x[:, None] - y[None, :]), 1.0)


def _views_and_clicks(spark, sf_dir):
    pick = lambda kind: samples(spark, sf_dir).filter(F.col("event_type") == kind).select("user_id", "n", F.col("x").alias("frame"), "us")
    return pick("view"), pick("click")


@query("dtw_align")
def dtw_align(spark, sf_dir):
    """Each user's views aligned with the user's clicks, whole, a row a pair of series."""
    views, clicks = (s.drop("us") for s in _views_and_clicks(spark, sf_dir))
    out = align_pairs(views.join(clicks.select("user_id").distinct(), "user_id", "left_semi"), clicks.join(views.select("user_id").distinct(), "user_id", "left_semi"), ["user_id"], _distance)
    return out.select("user_id", "i", "j", F.round("total", 9).alias("total"))


@query("dtw_anchored")
def dtw_anchored(spark, sf_dir):
    """As dtw_align, but a click that is the first of its day must match that day's first view."""
    views, clicks = _views_and_clicks(spark, sf_dir)
    day = F.floor(F.col("us") / 86_400_000_000)
    first = lambda s, name: s.groupBy("user_id", day.alias("day")).agg(F.min("n").alias(name))
    anchors = first(views, "i").join(first(clicks, "j"), ["user_id", "day"]).select("user_id", "i", "j")
    out = align_pairs(views.drop("us"), clicks.drop("us"), ["user_id"], _distance, anchors)
    return out.select("user_id", "segment", "i", "j", F.round("total", 9).alias("total"))
