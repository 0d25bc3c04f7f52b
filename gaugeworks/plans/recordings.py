"""The audio stages on recordings made of embeddings: 32 vectors one behind the other."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions.expr import tidy
from gaugeworks.operators import analysis as A
from gaugeworks.operators import chunks as C
from gaugeworks.operators import delays as D
from gaugeworks.plans.registry import query, table
from gaugeworks.streaming.blocks import appended
from gaugeworks.streaming.frames import facts_of_parts, frame_stream, part_stream

RATE, VECTORS, WIDTH = 480, 32, 64
_FRAMES = A.Options(frame=128, hop=32)
#: Samples that a chunk owns: several a recording, so that all pass their states on.
SIZE = 512


def blocks(spark, sf_dir):
    """(source_id, channel, rate, block_id, start_frame, samples): a block a vector."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / VECTORS).alias("source"), "vec_id", F.col("embedding").cast("array<double>").alias("samples"))
    number = F.row_number().over(W.partitionBy("source").orderBy("vec_id")) - 1
    return rows.select(
        F.col("source").cast("string").alias("source_id"), F.lit(0).alias("channel"), F.lit(RATE).alias("rate"), number.cast("long").alias("block_id"), (number * WIDTH).cast("long").alias("start_frame"), "samples"
    )


_X = """v AS (SELECT vec_id // 32 AS source, row_number() OVER (PARTITION BY vec_id // 32 ORDER BY vec_id) - 1 AS b, embedding FROM embeddings),
    x AS MATERIALIZED (SELECT source, b * 64 + k - 1 AS n, CAST(embedding[k] AS DOUBLE) AS x FROM v, range(1, 65) AS r(k))"""
_DB = "CASE WHEN {p} > 1e-30 THEN 10 * log10({p}) ELSE -300 END"
_FACTS = f"""WITH RECURSIVE {_X},
    shape AS (SELECT pow(10, 3.99984385397 / 40) AS g, 2 * pi() * 0.4 AS w, 2 * pi() * 38.13547087602444 / 480 AS v),
    root AS (SELECT g, cos(w) AS c, 2 * sqrt(g) * sin(w) / 2 * sqrt(2.0) AS r, cos(v) AS d, sin(v) / (2 * 0.5003270373) AS e FROM shape),
    q AS MATERIALIZED (SELECT g * (g + 1 + (g - 1) * c + r) / a0 AS b0, -2 * g * (g - 1 + (g + 1) * c) / a0 AS b1, g * (g + 1 + (g - 1) * c - r) / a0 AS b2,
          2 * (g - 1 - (g + 1) * c) / a0 AS a1, (g + 1 - (g - 1) * c - r) / a0 AS a2, (1 + d) / 2 / (1 + e) AS h, -2 * d / (1 + e) AS p1, (1 - e) / (1 + e) AS p2
          FROM (SELECT *, g + 1 - (g - 1) * c + r AS a0 FROM root)),
    run AS (SELECT source, n, u, b1 * x - a1 * u AS s1, b2 * x - a2 * u AS s2, h * u AS y, -2 * h * u - p1 * h * u AS t1, h * u - p2 * h * u AS t2
            FROM (SELECT source, n, x, b0 * x AS u FROM x, q WHERE n = 0), q
            UNION ALL
            SELECT source, n, u, b1 * x - a1 * u + o2, b2 * x - a2 * u, h * u + o3, -2 * h * u - p1 * (h * u + o3) + o4, h * u - p2 * (h * u + o3)
            FROM (SELECT x.source, x.n, x.x, q.b0 * x.x + run.s1 AS u, run.s2 AS o2, run.t1 AS o3, run.t2 AS o4 FROM run JOIN x ON x.source = run.source AND x.n = run.n + 1, q), q),
    tenth AS (SELECT source, n // 48 AS step, avg(y * y) AS p FROM run GROUP BY ALL HAVING count(*) = 48),
    four AS (SELECT source, step, avg(p) OVER w AS p, count(*) OVER w AS c FROM tenth WINDOW w AS (PARTITION BY source ORDER BY step ROWS 3 PRECEDING)),
    loud AS (SELECT source, p, {_DB.format(p="p")} - 0.691 AS level FROM four WHERE c = 4 AND {_DB.format(p="p")} - 0.691 >= -70),
    gate AS (SELECT source, greatest(-70, {_DB.format(p="avg(p)")} - 0.691 - 10) AS gate FROM loud GROUP BY source),
    lufs AS (SELECT source, {_DB.format(p="avg(p)")} - 0.691 AS lufs FROM loud JOIN gate USING (source) WHERE level >= gate GROUP BY source),
    own AS (SELECT source, count(*) AS frames, max(abs(x)) AS peak, sqrt(avg(x * x)) AS rms, avg(x) AS dc, avg(x * x) AS energy FROM x GROUP BY source),
    between AS (SELECT source, n - k AS m, ph, sum(x * sin(pi() * (ph - k)) / (pi() * (ph - k)) * sin(pi() * (ph - k) / 16) / (pi() * (ph - k) / 16)) AS y
          FROM x, range(-15, 17) AS r(k), (VALUES (0.25::DOUBLE), (0.5), (0.75)) AS p(ph) GROUP BY ALL),
    tops AS (SELECT source, max(abs(y)) AS top FROM between JOIN own USING (source) WHERE m BETWEEN -1 AND frames - 1 GROUP BY source)
    SELECT CAST(source AS VARCHAR) AS source_id, frames, round(peak, 9) AS peak, round(rms, 9) AS rms, round(dc, 9) + 0.0 AS dc, round({_DB.format(p="peak * peak")} - {_DB.format(p="energy")}, 6) + 0.0 AS crest_db,
           round(greatest(peak, top), 9) AS true_peak, round(lufs, 6) AS integrated_lufs
    FROM own JOIN tops USING (source) LEFT JOIN lufs USING (source)"""


@query("recording_facts", _FACTS)
def recording_facts(spark, sf_dir):
    """Level, true peak and gated loudness, a chunk to a task."""
    out = A.facts(blocks(spark, sf_dir), SIZE)
    nine = {"peak", "rms", "dc", "true_peak"}
    return out.select("source_id", "frames", *[(F.round(c, 9 if c in nine else 6) + F.lit(0.0)).alias(c) for c in ("peak", "rms", "dc", "crest_db", "true_peak", "integrated_lufs")])


_TRACK = f"""WITH {_X}, lasts AS (SELECT source, count(*) AS c FROM x GROUP BY source),
    fr AS (SELECT source, f AS frame, n - 32 * f AS j, x FROM x JOIN lasts USING (source), range(61) AS r(f) WHERE 32 * f + 128 <= c AND n >= 32 * f AND n < 32 * f + 128),
    w AS MATERIALIZED (SELECT source, frame, j, x, x * (0.5 - 0.5 * cos(2 * pi() * j / 128)) AS v,
          (x - avg(x) OVER (PARTITION BY source, frame)) * (0.5 - 0.5 * cos(2 * pi() * j / 128)) AS u FROM fr),
    z AS (SELECT source, frame, b, sum(v * cos(2 * pi() * b * j / 128)) AS re, -sum(v * sin(2 * pi() * b * j / 128)) AS im FROM w, range(65) AS r(b) GROUP BY ALL),
    mag AS MATERIALIZED (SELECT *, sqrt(re * re + im * im) AS m, atan2(im, re) AS a, (re * re + im * im) / 4096 * CASE WHEN b BETWEEN 1 AND 63 THEN 2 ELSE 1 END AS p FROM z),
    turn AS (SELECT source, frame, b, m, p, a - 2 * lag(a) OVER s + lag(a, 2) OVER s AS d, sqrt(p) - lag(sqrt(p)) OVER s AS up FROM mag WINDOW s AS (PARTITION BY source, b ORDER BY frame)),
    spec AS (SELECT source, frame, greatest(sum(p) FILTER (b > 0), 1e-30) AS total, sum(p * b * 3.75) FILTER (b > 0) AS first, exp(avg(ln(greatest(p, 1e-30))) FILTER (b > 0)) / greatest(avg(p) FILTER (b > 0), 1e-30) AS flatness,
             CASE WHEN frame = 0 THEN 0 ELSE sum(greatest(up, 0)) / greatest(sum(sqrt(p)), 1e-30) END AS flux,
             CASE WHEN frame < 2 THEN 0 ELSE sum(m * abs(sin(d / 2))) / greatest(sum(m), 1e-30) END AS phase FROM turn GROUP BY source, frame),
    shape AS (SELECT source, frame, sqrt(sum(p * pow(b * 3.75 - first / total, 2)) / any_value(total)) AS spread FROM mag JOIN spec USING (source, frame) WHERE b > 0 GROUP BY ALL),
    r AS (SELECT l.source, l.frame, k, sum(l.u * h.u) AS r FROM w l JOIN w h USING (source, frame), range(14) AS g(k) WHERE h.j = l.j + k GROUP BY ALL),
    top AS (SELECT source, frame, max(r) FILTER (k = 0) AS r0, arg_max(k, (r, -k)) FILTER (k BETWEEN 2 AND 12) AS k FROM r GROUP BY ALL),
    tri AS (SELECT t.source, t.frame, t.k, any_value(r0) AS r0, max(r) FILTER (r.k = t.k) AS y, max(r) FILTER (r.k = t.k - 1) AS y1, max(r) FILTER (r.k = t.k + 1) AS y2
            FROM top t JOIN r USING (source, frame) GROUP BY ALL),
    pitch AS (SELECT source, frame, CASE WHEN r0 > 0 AND y / r0 >= 0.3 THEN 480 / (k + coalesce(0.5 * (y1 - y2) / nullif(y1 - 2 * y + y2, 0), 0)) END AS hz, CASE WHEN r0 > 0 THEN y / r0 ELSE 0 END AS sure FROM tri),
    level AS (SELECT source, frame, {_DB.format(p="avg(x * x)")} AS db FROM w GROUP BY ALL),
    step AS (SELECT *, coalesce(db - lag(db) OVER s, 0) AS rise, coalesce(abs(12 * log2(hz / lag(hz) OVER s)), 0) AS semitones
             FROM spec JOIN shape USING (source, frame) JOIN pitch USING (source, frame) JOIN level USING (source, frame) WINDOW s AS (PARTITION BY source ORDER BY frame))
    SELECT CAST(source AS VARCHAR) AS source_id, frame AS frame_index, round((frame * 32 + 64) / 480.0, 6) AS time_seconds, round(db, 6) + 0.0 AS rms_dbfs, round(hz, 6) AS pitch_hz, round(sure, 6) + 0.0 AS pitch_confidence,
           round(first / total, 6) AS centroid_hz, round(spread, 6) AS spread_hz, round(flatness, 6) AS flatness, round(flux, 6) AS flux,
           round(least(1, greatest(0, 0.4 * least(1, 2 * flux) + 0.25 * least(1, greatest(0, rise / 18)) + 0.2 * phase + 0.15 * least(1, semitones / 2))), 6) AS onset_strength
    FROM step"""


@query("recording_track", _TRACK)
def recording_track(spark, sf_dir):
    """The frame track: frames of 128 samples every 32, read over the ends of chunks."""
    return _shown(A.frame_tracks(blocks(spark, sf_dir), _FRAMES, SIZE))


def _shown(out):
    names = ["time_seconds", "rms_dbfs", "pitch_hz", "pitch_confidence", "centroid_hz", "spread_hz", "flatness", "flux", "onset_strength"]
    return out.select("source_id", "frame_index", *[tidy(F.col(c)).alias(c) for c in names])


def _stream(spark, sf_dir):
    """The same blocks as they come in; ids run on from 0, as a stream numbers nothing."""
    table_ = spark.readStream.schema("vec_id long, embedding array<float>, label int").parquet(f"{sf_dir}/embeddings.parquet*")
    return table_.select(
        F.floor(F.col("vec_id") / VECTORS).cast("string").alias("source_id"),
        F.lit(0).alias("channel"),
        F.lit(RATE).alias("rate"),
        (F.col("vec_id") % VECTORS * WIDTH).cast("long").alias("start_frame"),
        F.col("embedding").cast("array<double>").alias("samples"),
    )


@query("stream_recording_facts", f"SELECT source_id, frames, peak, rms, dc, crest_db, integrated_lufs FROM ({_FACTS})")
def stream_recording_facts(spark, sf_dir):
    """The facts of a stream of blocks, from what each batch added."""
    out = facts_of_parts(appended(part_stream(_stream(spark, sf_dir))))
    return out.select("source_id", "frames", *[(F.round(c, 9 if c in ("peak", "rms", "dc") else 6) + F.lit(0.0)).alias(c) for c in ("peak", "rms", "dc", "crest_db", "integrated_lufs")])


@query("stream_recording_track", _TRACK)
def stream_recording_track(spark, sf_dir):
    """The frame track of a stream of blocks."""
    return _shown(appended(frame_stream(_stream(spark, sf_dir), _FRAMES)))


#: A short room: an exponential decay with two echoes.
TAPS = np.exp(-np.arange(100) / 15) * (np.arange(100) % 33 == 0)


@query(
    "recording_convolution",
    f"""WITH {_X}, taps AS (SELECT k, exp(-k / 15.0) AS h FROM range(0, 100, 33) AS r(k)),
    y AS (SELECT source, n + k AS n, sum(x * h) AS y FROM x, taps GROUP BY ALL)
    SELECT CAST(source AS VARCHAR) AS source_id, n // 512 AS chunk, count(*) AS own, round(max(abs(y)), 9) AS peak, round(sum(y * y), 6) AS energy FROM y GROUP BY ALL""",
)
def recording_convolution(spark, sf_dir):
    """Every recording through a room, by overlap-save, with what each chunk owns of it."""
    wet = C.convolved(blocks(spark, sf_dir), A.SERIES, TAPS, SIZE)
    peak, energy = F.array_max(F.transform("samples", F.abs)), F.aggregate("samples", F.lit(0.0), lambda a, v: a + v * v)
    return wet.select("source_id", "chunk", F.size("samples").cast("long").alias("own"), F.round(peak, 9).alias("peak"), F.round(energy, 6).alias("energy"))


@query(
    "span_delays",
    f"""WITH {_X}, own AS (SELECT source, count(*) AS length FROM x GROUP BY source),
    anchors AS (SELECT source, k * length // least(300, length) AS n FROM own, range(300) AS r(k) WHERE k < least(300, length) AND source % 2 = 0),
    pairs AS (SELECT a.source // 2 AS span, lag, l.x AS l, r.x AS r FROM anchors a JOIN x l USING (source, n), range(-20, 21) AS g(lag) JOIN x r ON r.source = a.source + 1 AND r.n = a.n + lag),
    found AS (SELECT span, lag, count(*) AS pairs, corr(l, r) AS c FROM pairs GROUP BY span, lag HAVING count(*) >= 64 AND var_pop(l) > 0 AND var_pop(r) > 0)
    SELECT span, lag, round(c, 9) AS correlation, pairs FROM found QUALIFY row_number() OVER (PARTITION BY span ORDER BY round(abs(c), 12) DESC, abs(lag), lag) = 1""",
)
def span_delays(spark, sf_dir):
    """Delay between a recording and the next, at 300 anchors and lags up to 20."""
    rows = blocks(spark, sf_dir).withColumn("source", F.col("source_id").cast("long"))
    side = lambda k: rows.filter(F.col("source") % 2 == k).select(F.floor(F.col("source") / 2).alias("span"), "start_frame", "samples")
    out = D.delays(side(0), side(1), ["span"], 20, 300, SIZE)
    return out.select("span", F.col("lag").cast("long").alias("lag"), F.round("correlation", 9).alias("correlation"), "pairs")
