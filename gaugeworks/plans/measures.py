"""The measurement catalogue on event frames: twenty events of a user are an item."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions.shared import written
from gaugeworks.operators import harmonics as H
from gaugeworks.operators import kernels as K
from gaugeworks.operators import measures as M
from gaugeworks.plans.harmonics import TRACKED, _db, tracked
from gaugeworks.plans.registry import query, table
from gaugeworks.plans.signals import _X, samples

#: An event's frame has the spectrum of an embedding: those follow each other by id.
_FRAMES = f"""{TRACKED}, {_X},
    fr AS (SELECT user_id * 100000 + n // 20 AS item, user_id, n AS m, t, x * x AS x2, abs(x) AS top, 10 * log10(greatest(x * x, 1e-30)) AS level, 500 + abs(x) * 1000 AS centroid,
           (event_id % 10) / 10.0::DOUBLE AS flatness, abs(x) / 2 AS flux, CASE WHEN sure >= 0.3 THEN round(hv.pitch, 9) END AS pitch, target,
           coalesce(fault, false) AS fault, round({_db("harmonic")}, 9) AS harmonic, round({_db("hv.residual")}, 9) AS residual, t - 0.25 AS source_start, us, event_id, vec_id
           FROM x LEFT JOIN hv ON hv.vec_id = x.event_id % (SELECT count(*) FROM embeddings)),
    fs AS (SELECT *, min(us) OVER (PARTITION BY item) AS start_sample, max(us) OVER (PARTITION BY item) + 900000000 AS end_sample, max(residual) OVER (PARTITION BY item) AS loudest FROM fr),
    p1 AS (SELECT *, row_number() OVER w - 1 AS n, row_number() OVER (PARTITION BY item ORDER BY t DESC) - 1 AS k, round(1200 * log2(pitch / target), 9) AS cents,
           coalesce(round(abs(level - lag(level) OVER w), 9) <= 0.35 AND round(abs(centroid - lag(centroid) OVER w), 9) <= 20, false) AS steady FROM fs WINDOW w AS (PARTITION BY item ORDER BY t)),
    p2 AS (SELECT *, round(abs(cents - avg(cents) OVER (PARTITION BY item)), 6) <= 15 AS near, first_value(cents IGNORE NULLS) OVER w AS c0, last_value(cents IGNORE NULLS) OVER w AS c1
           FROM p1 WINDOW w AS (PARTITION BY item ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    rows_ AS (SELECT *, near AND lead(near) OVER w AND lead(near, 2) OVER w AS calm3, round((cents - c0) / nullif(c1 - c0, 0), 6) AS glide FROM p2 WINDOW w AS (PARTITION BY item ORDER BY t)),
    facts AS (SELECT item, round(10 * log10(greatest(avg(x2), 1e-30)), 9) AS rms, count(*) AS frames, count(cents) AS pitch_frames, min(t) AS item_start FROM rows_ GROUP BY item),
    ab AS (SELECT item, x2, (max(t) OVER i - min(t) OVER i) / 16 AS width, t - min(t) OVER i AS dt FROM fr WINDOW i AS (PARTITION BY item)),
    ac AS (SELECT item, CASE WHEN width > 0 THEN least(floor(round(dt / width, 6)), 15) ELSE 0 END AS b, round(sqrt(avg(x2)), 9) AS v, max(width) AS width FROM ab GROUP BY 1, 2),
    at_ AS (SELECT *, round(v / nullif(max(v) OVER (PARTITION BY item), 0), 9) AS rel FROM ac),
    bd AS (SELECT fr.item, t, band, round({_db("hb.power")}, 9) AS level, round({_db("hb.residual")}, 9) AS residual, rms FROM fr JOIN facts USING (item) JOIN hb USING (vec_id)),
    pt AS (SELECT fr.item, t, o AS partial, round(cents, 9) AS cents, round({_db("power")}, 9) AS level, round(power, 12) AS power, f.rms, f.pitch_frames, f.item_start
           FROM fr JOIN facts f USING (item) JOIN hp USING (vec_id)),
    pb AS (SELECT *, min(t) FILTER (level IS NOT NULL) OVER (PARTITION BY item, partial) AS born FROM pt)"""


_DB20 = "20 * log10(greatest(sqrt(avg(x2)), 1e-15))"
_MEAN = "sum({0}) / nullif(count({0}), 0)"


def _slope(y: str, only: str = "true") -> str:
    """A regression's slope by its definition."""
    there = f"FILTER ({y} IS NOT NULL AND {only})"
    return f"covar_pop({y}, t) {there} / nullif(var_pop(t) {there}, 0)"


def _pearson(a: str, b: str) -> str:
    both = f"FILTER ({a} IS NOT NULL AND {b} IS NOT NULL)"
    return f"CASE WHEN round(sqrt(var_pop({a}) {both} * var_pop({b}) {both}), 12) > 0 THEN corr({a}, {b}) {both} END"


def _spread(y: str) -> str:
    return f"CASE WHEN count({y}) > 1 THEN sqrt(var_pop({y})) END"


#: Every kind said anew for the oracle, from its definition: source, index, {kind: (unit, is a level, needs, expression)}.
_SAID = (
    (
        "rows_",
        None,
        {
            "rms_dbfs": ("dBFS", True, "signal", _DB20),
            "peak_dbfs": ("dBFS", True, "signal", "10 * log10(greatest(max(x2), 1e-30))"),
            "crest_db": ("dB", False, "signal", f"10 * log10(greatest(max(x2), 1e-30)) - {_DB20}"),
            "centroid_hz": ("Hz", False, "signal", _MEAN.format("centroid")),
            "flatness": ("ratio", False, "signal", _MEAN.format("flatness")),
            "level_slope_db_per_second": ("dB/s", False, "signal", _slope("level")),
            "centroid_slope_hz_per_second": ("Hz/s", False, "signal", _slope("centroid")),
            "transient_rate_hz": ("Hz", False, "signal", "sum(CASE WHEN flux >= 0.2 THEN 1 ELSE 0 END) * 3.6e9 / nullif(any_value(end_sample - start_sample), 0)"),
            "fixed_state_fraction": ("ratio", False, "signal", "sum(CAST(steady AS INT)) / nullif(count(*) - 1, 0)"),
            "level_modulation_spread_db": ("dB", False, "signal", _spread("level")),
            "centroid_modulation_spread_hz": ("Hz", False, "signal", _spread("centroid")),
            "pitch_hz": ("Hz", False, "pitch", _MEAN.format("pitch")),
            "tuning_offset_cents": ("cents", False, "pitch", _MEAN.format("cents")),
            "pitch_spread_cents": ("cents", False, "pitch", "sqrt(var_pop(cents))"),
            "pitch_overshoot_cents": ("cents", False, "pitch", "max(cents) - " + _MEAN.format("cents")),
            "pitch_undershoot_cents": ("cents", False, "pitch", _MEAN.format("cents") + " - min(cents)"),
            "pitch_drift_cents_per_second": ("cents/s", False, "pitch", _slope("cents")),
            "pitch_settle_seconds": ("s", False, "pitch", "list_min(list(t) FILTER (calm3)) - min(t)"),
            "octave_fault_fraction": ("ratio", False, "pitch", "count(*) FILTER (fault AND pitch IS NOT NULL) / nullif(count(pitch), 0)"),
            "glide_time_seconds": ("s", False, "pitch", "list_min(list(t) FILTER (glide >= 0.9)) - list_min(list(t) FILTER (glide >= 0.1))"),
            "portamento_linearity": (
                "ratio",
                False,
                "pitch",
                "CASE WHEN var_pop(t) FILTER (glide BETWEEN 0.1 AND 0.9) > 0 THEN CASE WHEN var_pop(cents) FILTER (glide BETWEEN 0.1 AND 0.9) > 0 THEN corr(cents, t) FILTER (glide BETWEEN 0.1 AND 0.9) ** 2 ELSE 1 END END",
            ),
            "harmonic_level_dbfs": ("dBFS", True, "signal", _MEAN.format("harmonic")),
            "residual_level_dbfs": ("dBFS", True, "signal", _MEAN.format("residual")),
            "hnr_db": ("dB", False, "signal", _MEAN.format("harmonic") + " - " + _MEAN.format("residual")),
            "harmonic_decay_db_per_second": ("dB/s", False, "signal", _slope("harmonic")),
            "pitch_level_correlation": ("ratio", False, "pitch", _pearson("cents", "level")),
            "pitch_tone_correlation": ("ratio", False, "pitch", _pearson("cents", "centroid")),
            "noise_burst_seconds": ("s", False, "signal", "min(t) FILTER (residual = loudest) - min(t)"),
            "early_damping_db_per_second": ("dB/s", False, "signal", _slope("level", "k <= 4")),
            "pitch_fall_cents": ("cents", False, "pitch", "(list(cents ORDER BY n) FILTER (cents IS NOT NULL))[-1] - (list(cents ORDER BY n) FILTER (cents IS NOT NULL))[1]"),
            "decay_db": ("dB", False, "signal", "(list(level ORDER BY n))[1] - (list(level ORDER BY n))[-1]"),
            "residual_excitation_dbfs": ("dBFS", True, "signal", "(list(residual ORDER BY n))[-1]"),
            "carryover_db": ("dB", False, "signal", "first(level ORDER BY n) - last(level ORDER BY n)"),
            "transition_pitch_change_cents": ("cents", False, "pitch", "list_avg((list(cents ORDER BY n))[-3:]) - list_avg((list(cents ORDER BY n))[1:3])"),
            "transition_tone_change_hz": ("Hz", False, "signal", "last(centroid ORDER BY n) - first(centroid ORDER BY n)"),
            "attack_delay_seconds": ("s", False, "any", "min(t) - min(source_start)"),
            "duration_seconds": ("s", False, "any", "any_value(end_sample - start_sample) / 3.6e9"),
        },
    ),
    ("before", None, {"pre_note_residual_dbfs": ("dBFS", True, "any", f"CASE WHEN count(x2) > 0 THEN {_DB20} END")}),
    (
        "at_",
        None,
        {
            **{f"rise_{p}_seconds": ("s", False, "signal", f"list_min(list(b) FILTER (rel >= {p / 100})) * any_value(width)") for p in (10, 50, 90)},
            "attack_slope_db_per_second": (
                "dB/s",
                False,
                "signal",
                "(20 * log10(0.9) - 20 * log10(0.1)) / nullif(list_min(list(b) FILTER (rel >= 0.9)) * any_value(width) - list_min(list(b) FILTER (rel >= 0.1)) * any_value(width), 0)",
            ),
            "attack_overshoot_db": ("dB", False, "signal", "20 * log10(greatest(max(v), 1e-15) / greatest(avg(v) FILTER (b IN (12, 13, 14, 15)), 1e-15))"),
        },
    ),
    (
        "bd",
        "band",
        {
            "band_level_dbfs": ("dBFS", True, "signal", _MEAN.format("level")),
            "band_balance_db": ("dB", False, "signal", "avg(level - rms)"),
            "band_slope_db_per_second": ("dB/s", False, "signal", _slope("level")),
            "band_modulation_spread_db": ("dB", False, "signal", _spread("level")),
            "residual_band_level_dbfs": ("dBFS", True, "signal", _MEAN.format("residual")),
            "residual_band_balance_db": ("dB", False, "signal", "avg(residual - rms)"),
        },
    ),
    (
        "pt",
        "partial",
        {
            "partial_frequency_error_cents": ("cents", False, "pitch", _MEAN.format("cents")),
            "partial_level_dbfs": ("dBFS", True, "pitch", _MEAN.format("level")),
            "partial_balance_db": ("dB", False, "pitch", "avg(level - rms)"),
            "partial_presence_fraction": ("ratio", False, "pitch", "sum(CASE WHEN level IS NULL THEN 0 ELSE 1 END) / nullif(any_value(pitch_frames), 0)"),
            "partial_birth_seconds": ("s", False, "pitch", "min(CASE WHEN level IS NOT NULL THEN t - item_start END)"),
            "partial_loss_seconds": ("s", False, "pitch", "max(CASE WHEN level IS NOT NULL THEN t - item_start END)"),
            "partial_level_slope_db_per_second": ("dB/s", False, "pitch", _slope("level")),
        },
    ),
    (
        "pb",
        None,
        {
            "inharmonicity_b": ("ratio", False, "pitch", "avg(CASE WHEN partial > 1 THEN (exp(ln(2) * cents / 1200) - 1) * 2 / partial ** 2 END)"),
            "odd_even_balance_db": ("dB", False, "pitch", "10 * log10(greatest(sum(power) FILTER (partial % 2 <> 0), 1e-30)) - 10 * log10(greatest(sum(power) FILTER (partial % 2 = 0), 1e-30))"),
            "harmonic_centroid": ("ratio", False, "pitch", "sum(power * partial) / nullif(sum(power), 0)"),
            "partial_onset_spread_seconds": ("s", False, "pitch", "CASE WHEN count(DISTINCT partial) > 1 THEN max(born) - min(born) END"),
        },
    ),
)


def _kinds(source: str, index: str | None, kinds: dict) -> str:
    keys = f"item, {index}" if index else "item"
    wide = ", ".join(f"CAST({text} AS DOUBLE) AS {name}" for name, (_, _, _, text) in kinds.items())
    return f"""SELECT item, kind, CAST({index or 0} AS BIGINT) AS "index", round(value, 6) + 0.0 AS value FROM
        (SELECT {keys}, unnest([{', '.join(f"'{k}'" for k in kinds)}]) AS kind, unnest([{', '.join(kinds)}]) AS value FROM (SELECT {keys}, {wide} FROM {source} GROUP BY {keys}))"""


_CATALOG = [(k, *v[:3]) for _, _, kinds in _SAID for k, v in kinds.items()] + [("partial_onset_order", "rank", False, "pitch")]
_ORACLE = f"""WITH {_FRAMES},
    before AS (SELECT f.item, c.x2 FROM facts f LEFT JOIN fr c ON c.user_id = f.item // 100000 AND c.m BETWEEN 20 * (f.item % 100000) - 3 AND 20 * (f.item % 100000) - 1),
    v0 AS ({' UNION ALL '.join(_kinds(*said) for said in _SAID)}),
    v1 AS (SELECT * FROM v0 UNION ALL SELECT item, 'partial_onset_order', "index", CAST(row_number() OVER (PARTITION BY item ORDER BY value, "index") AS DOUBLE)
           FROM v0 WHERE kind = 'partial_birth_seconds' AND value IS NOT NULL),
    cat AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{unit}', {str(level).lower()}, '{needs}')" for k, unit, level, needs in _CATALOG)}) c(kind, unit, is_level, needs)),
    v2 AS (SELECT v1.*, unit, is_level, needs, rms, frames, pitch_frames, (SELECT quantile_cont(rms, 0.5) FROM facts) AS middle,
           CASE WHEN needs <> 'any' AND rms <= -100 THEN 'BELOW_FLOOR' WHEN needs = 'pitch' AND frames < 3 THEN 'TOO_SHORT' WHEN needs = 'pitch' AND pitch_frames < 3 THEN 'NO_PITCH'
           WHEN value IS NULL OR isnan(value) THEN 'NO_DATA' ELSE 'VALID' END AS status FROM v1 JOIN cat USING (kind) JOIN facts USING (item)),
    v3 AS (SELECT *, CASE WHEN status = 'VALID' THEN value END AS val, CASE WHEN needs = 'pitch' AND pitch_frames < 0.70 * frames THEN 1 ELSE 0 END AS flags FROM v2)
    SELECT item, kind, "index", unit, 'ABSOLUTE' AS view, val AS value, status, flags FROM v3
    UNION ALL SELECT item, kind, "index", unit, 'LEVEL_RELATIVE', round(val - middle, 6) + 0.0, status, flags FROM v3 WHERE is_level"""


def frames(spark, sf_dir):
    i, x = F.col("event_id"), F.col("x")
    db = 10 * F.log10(F.greatest(x * x, F.lit(1e-30)))
    rows = samples(spark, sf_dir).withColumn("item", F.col("user_id") * 100000 + F.floor(F.col("n") / 20))
    # an item's ends are found while its user's events lie together, before the spectra come to them
    item = W.partitionBy("user_id", "item")
    rows = rows.withColumns({"start_sample": F.min("us").over(item), "end_sample": F.max("us").over(item) + 900_000_000})
    # each embedding is tracked once; an event's frame has the spectrum of one
    spectra = tracked(spark, sf_dir).withColumnRenamed("vec_id", "spectrum")
    count = table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("spectra"))
    rows = rows.crossJoin(F.broadcast(count)).withColumn("spectrum", F.when(F.col("spectra") > 0, i % F.col("spectra"))).join(spectra, "spectrum", "left")
    return rows.select(
        "item",
        "user_id",
        "event_id",
        F.col("n").alias("m"),
        "t",
        "start_sample",
        "end_sample",
        F.lit(3.6e9).alias("rate"),
        (x * x).alias("x2"),
        F.abs(x).alias("top"),
        db.alias("level"),
        (500 + F.abs(x) * 1000).alias("centroid"),
        ((i % 10) / 10).alias("flatness"),
        (F.abs(x) / 2).alias("flux"),
        F.when(F.col("valid"), F.round("pitch_hz", 9)).alias("pitch"),
        F.col("expected_hz").alias("target"),
        F.coalesce("octave_fault", F.lit(False)).alias("fault"),
        F.round(H.level(F.col("harmonic_power")), 9).alias("harmonic"),
        F.round(H.level(F.col("residual_power")), 9).alias("residual"),
        (F.col("t") - 0.25).alias("source_start"),
        (i % 13 == 0).alias("accented"),
        "partials",
        "band_power",
        "residual_band",
    )


def catalog(spark, sf_dir):
    # frames are made once, an item's together: the catalogue reads them for each of its sources
    # and sums them up by item before anything moves
    parts = F.transform("partials", lambda p: p.dropFields("hz"))
    rows = written(frames(spark, sf_dir).withColumn("partials", parts).repartition("item"))
    both = F.inline(F.transform("band_power", lambda v, b: F.struct(b.alias("band"), F.round(H.level(v), 9).alias("level"), F.round(H.level(F.get("residual_band", b)), 9).alias("residual"))))
    bands = rows.select("item", "t", both)
    partials = rows.select("item", "t", F.inline("partials")).select("item", "t", "partial", F.round("cents", 9).alias("cents"), F.round(H.level(F.col("power")), 9).alias("level"), F.round("power", 12).alias("power"))
    rows = rows.drop("partials", "band_power", "residual_band")
    # the three frames before an item are its context
    context = rows.filter("m % 20 >= 17").select((F.col("item") + 1).alias("item"), "x2")
    return M.measure(rows, bands, partials, context)


@query("measure_catalog", _ORACLE)
def measure_catalog(spark, sf_dir):
    return catalog(spark, sf_dir)


@query(
    "repeat_measures",
    f"""WITH {_FRAMES}, sh AS (SELECT item, list(v ORDER BY b) AS shape FROM at_ GROUP BY item),
        lv AS (SELECT user_id, item, min(t) AS start, 10 * log10(greatest(avg(x2), 1e-30)) AS level, bool_or(event_id % 13 = 0) AS accented FROM fr GROUP BY user_id, item),
        j AS (SELECT lv.*, shape, lag(shape) OVER w AS prior, level - lag(level) OVER w AS contrast FROM lv JOIN sh USING (item) WINDOW w AS (PARTITION BY user_id ORDER BY start, item)),
        r AS (SELECT item, CASE WHEN prior IS NOT NULL THEN list_sum(list_transform(list_zip(shape, prior), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0)))
              / sqrt(list_sum(list_transform(shape, lambda z: z * z)) * list_sum(list_transform(prior, lambda z: z * z))) END AS sim, contrast, accented FROM j)
        SELECT item, unnest(['repeated_attack_similarity', 'local_contrast_db', 'accent_size_db']) AS kind,
               unnest([round(sim, 6) + 0.0, round(contrast, 6) + 0.0, CASE WHEN accented THEN round(contrast, 6) + 0.0 END]) AS value FROM r""",
)
def repeat_measures(spark, sf_dir):
    return M.repeats(frames(spark, sf_dir), ["user_id"])


#: Whole curves (-3), their halves (-2, -1) and windows of 8 (from 0), detrended, by their best lag.
_CURVES = f"""WITH {_FRAMES},
    curve AS (SELECT user_id, item, coalesce(list(1200 * log2(pitch / target) ORDER BY t) FILTER (pitch IS NOT NULL), []) AS v FROM fr GROUP BY user_id, item),
    cut AS (SELECT item, -3 AS seg, v FROM curve UNION ALL SELECT item, -2, v[1 : len(v) // 2] FROM curve UNION ALL SELECT item, -1, v[len(v) // 2 + 1 : len(v)] FROM curve
            UNION ALL SELECT item, k, v[k + 1 : k + 8] FROM curve, range(20) AS g(k) WHERE k + 8 <= len(v)),
    points AS (SELECT item, seg, len(v) AS c, unnest(v) AS y, generate_subscripts(v, 1) - 1 AS i FROM cut WHERE len(v) >= 6),
    line AS (SELECT item, seg, regr_slope(y, i) AS a, regr_intercept(y, i) AS b FROM points GROUP BY item, seg),
    rest AS (SELECT item, seg, c, i, y - a * i - b AS y FROM points JOIN line USING (item, seg)),
    lags AS (SELECT l.item, l.seg, k, sum(l.y * h.y) / sqrt(sum(l.y * l.y) * sum(h.y * h.y) + 1e-30) AS r
             FROM rest l JOIN rest h USING (item, seg), range(3, 9) AS g(k) WHERE h.i = l.i + k AND k <= l.c // 2 GROUP BY l.item, l.seg, k),
    best AS (SELECT item, seg, arg_max(k, (r, -k)) AS k, max(r) AS r FROM lags GROUP BY item, seg),
    found AS (SELECT item, seg, 1 / (k * 0.04::DOUBLE) AS rate, sqrt(2 * p) AS depth, 1 - r AS left_over
              FROM best JOIN (SELECT item, seg, avg(y * y) AS p FROM rest GROUP BY item, seg) USING (item, seg) WHERE r >= 0.25 AND p >= 1e-12),
    whole AS (SELECT * FROM found WHERE seg = -3), one AS (SELECT * FROM found WHERE seg = -2), two AS (SELECT * FROM found WHERE seg = -1),
    first_ AS (SELECT item, min(seg) AS k FROM found WHERE seg >= 0 GROUP BY item),
    even AS (SELECT user_id, item, CASE WHEN len(v) >= 3 THEN list_transform(range(64), lambda i: v[CAST(floor(i * (len(v) - 1) / 63.0) AS INT) + 1]
                 + (v[least(CAST(floor(i * (len(v) - 1) / 63.0) AS INT) + 2, len(v))] - v[CAST(floor(i * (len(v) - 1) / 63.0) AS INT) + 1])
                 * (i * (len(v) - 1) / 63.0 - floor(i * (len(v) - 1) / 63.0))) END AS e FROM curve),
    pair AS (SELECT item, e, last_value(e IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM even),
    alike AS (SELECT item, corr(a, b) AS r FROM (SELECT item, unnest(e) AS a, unnest(prior) AS b FROM pair WHERE e IS NOT NULL AND prior IS NOT NULL) GROUP BY item HAVING var_pop(a) > 1e-18 AND var_pop(b) > 1e-18)
    SELECT c.item, unnest(['vibrato_delay_seconds', 'vibrato_rate_hz', 'vibrato_depth_cents', 'vibrato_waveform_residual_ratio', 'vibrato_rate_drift_hz_per_second',
                           'vibrato_depth_drift_cents_per_second', 'repeated_pitch_curve_similarity']) AS kind,
           unnest([round(first_.k * 0.04::DOUBLE, 6), round(whole.rate, 6), round(whole.depth, 6), round(whole.left_over, 6), round((two.rate - one.rate) / (len(v) * 0.04::DOUBLE), 6),
                   round((two.depth - one.depth) / (len(v) * 0.04::DOUBLE), 6), round(alike.r, 6)]) AS value
    FROM curve c LEFT JOIN whole USING (item) LEFT JOIN one USING (item) LEFT JOIN two USING (item) LEFT JOIN first_ USING (item) LEFT JOIN alike USING (item)"""


@query("vibrato_measures", _CURVES)
def vibrato_measures(spark, sf_dir):
    """Delay, rate, depth, residual and drifts of each item's pitch curve; likeness of the
    curve to that of the prior item of the user."""

    def run(rows):
        out, prior = [], None
        for item, g in rows.groupby("item", sort=True):
            cents = (1200 * np.log2(g["pitch"] / g["target"])).dropna().to_numpy()
            rate, depth, rest = K.vibrato(cents, 0.04)
            half = len(cents) // 2
            first, second = K.vibrato(cents[:half], 0.04), K.vibrato(cents[half:], 0.04)
            span = max(len(cents) * 0.04, 1e-9)
            # windows behind the first that has a vibrato are not looked at
            window = next((k for k in range(0, max(len(cents) - 7, 0)) if not np.isnan(K.vibrato(cents[k : k + 8], 0.04)[0])), None)
            curve = K.resample(cents, 64) if len(cents) >= 3 else None
            alike = np.nan
            if curve is not None and prior is not None and curve.std() > 0 and prior.std() > 0:
                alike = float(np.corrcoef(curve, prior)[0, 1])
            prior = curve if curve is not None else prior
            values = {
                "vibrato_delay_seconds": window * 0.04 if window is not None else np.nan,
                "vibrato_rate_hz": rate,
                "vibrato_depth_cents": depth,
                "vibrato_waveform_residual_ratio": rest,
                "vibrato_rate_drift_hz_per_second": (second[0] - first[0]) / span,
                "vibrato_depth_drift_cents_per_second": (second[1] - first[1]) / span,
                "repeated_pitch_curve_similarity": alike,
            }
            out += [(item, kind, None if np.isnan(v) else round(v, 6)) for kind, v in values.items()]
        return pd.DataFrame(out, columns=["item", "kind", "value"])

    rows = frames(spark, sf_dir).select("user_id", "item", "t", "pitch", "target")
    return K.per_series(rows, ["user_id"], ["item", "t"], run, "item long, kind string, value double")
