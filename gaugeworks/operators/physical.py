"""Physical checks: one catalogue of kinds, each an aggregate over samples, paired samples
or spectrum bins, compared between a reference and a model.

samples: side, case, n, x, prev, of, clipped, again. pairs: case, r, m (aligned samples).
bins: side, case, k, p, hz, peak (strongest bin), and the powers at the tones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.expr import LN_1000, tidy

#: By what a kind's difference is divided for a finding's score.
DELTA_SCALES = {
    "element_trait_delta": 2.0,
    "element_gain_only_score": 1.0,
    "element_carryover_db": 12.0,
    "body_mode_prominence_db": 12.0,
    "joint_residual_db": 20.0,
    "shared_gain_db": 6.0,
    "intermodulation_ratio": 0.25,
    "sum_tone_db": 20.0,
    "difference_tone_db": 20.0,
    "render_rms_error_db": 12.0,
    "render_max_error_dbfs": 12.0,
    "render_spectral_distance_db": 12.0,
    "render_correlation": 0.20,
    "render_lag_samples": 32.0,
    "render_pitch_delta_cents": 25.0,
    "render_attack_delta_seconds": 0.05,
    "render_decay_delta_seconds": 0.05,
}
#: Kinds whose difference counts against the reference, and its least size there.
RELATIVE = {"element_distinctness_ratio": 0.25, "body_mode_bandwidth_hz": 1e-9, "body_mode_q": 1e-9, "body_mode_decay_seconds": 1e-9, "body_mode_density_per_khz": 1e-9}
#: Faults, by the model's value alone: what is taken off, and the scale.
FAULTS = {
    "dc_offset": (0.0, 0.01),
    "dc_drift": (0.0, 0.01),
    "clip_fraction": (0.0, 0.001),
    "hard_bound_fraction": (0.0, 0.001),
    "repeated_block_fraction": (0.0, 0.10),
    "stuck_state_fraction": (0.0, 0.10),
    "max_step_dbfs": (-12.0, 12.0),
    "runaway_slope_db_per_second": (0.0, 6.0),
    "return_level_dbfs": (-60.0, 60.0),
    "denormal_fraction": (0.0, 1e-6),
}
SIGNLESS = ("dc_offset", "dc_drift")
#: Least score of a finding, of a warning, of a critical one; cents that a mode may be off.
REVIEW, WARNING, CRITICAL, MODE_CENTS = 0.20, 0.40, 0.80, 20.0
#: Samples a second.
RATE = 48.0
SCAN_KINDS = (
    ("dc_offset", "avg(x)"),
    ("dc_drift", "avg(x) FILTER (WHERE n >= of - greatest(floor(of * 0.1), 1)) - avg(x) FILTER (WHERE n < greatest(floor(of * 0.1), 1))"),
    ("clip_fraction", "avg(CASE WHEN clipped THEN 1.0e0 ELSE 0.0e0 END)"),
    ("hard_bound_fraction", "avg(CASE WHEN abs(x) >= 1 THEN 1.0e0 ELSE 0.0e0 END)"),
    ("repeated_block_fraction", "avg(again) FILTER (WHERE again IS NOT NULL)"),
    ("stuck_state_fraction", "avg(CASE WHEN x = prev AND x <> 0 THEN 1.0e0 ELSE 0.0e0 END)"),
    ("max_step_dbfs", "20 * log10(greatest(max(abs(x - prev)), 1e-15))"),
    ("runaway_slope_db_per_second", f"regr_slope(10 * log10(greatest(x * x, 1e-30)), n / {RATE}D)"),
    ("return_level_dbfs", "10 * log10(greatest(avg(x * x) FILTER (WHERE n >= of - greatest(floor(of * 0.1), 1)), 1e-30))"),
    ("denormal_fraction", "avg(CASE WHEN x <> 0 AND abs(x) < 2.2250738585072014e-308 THEN 1.0e0 ELSE 0.0e0 END)"),
)
SPECTRUM_KINDS = (
    ("high_band_ratio", "sum(p) FILTER (WHERE k >= bins * 0.8) / nullif(sum(p), 0)"),
    ("subharmonic_ratio", "max(p) FILTER (WHERE k BETWEEN 1 AND floor(peak / 2)) / nullif(max(p), 0)"),
    ("fixed_tone_prominence_db", "10 * log10(greatest(max(p), 1e-30) / greatest((sum(p) - max(p)) / nullif(max(bins) - 1, 0), 1e-30))"),
    ("intermodulation_ratio", "sqrt(coalesce(sum(p) FILTER (WHERE k = 2 * f1 - f2 OR k = 2 * f2 - f1), 0) / nullif(sum(p) FILTER (WHERE k = f1 OR k = f2), 0))"),
    ("sum_tone_db", "10 * log10(greatest(coalesce(max(p) FILTER (WHERE k = f1 + f2), 0), 1e-30) / nullif(sum(p) FILTER (WHERE k = f1 OR k = f2), 0))"),
    ("difference_tone_db", "10 * log10(greatest(coalesce(max(p) FILTER (WHERE k = abs(f1 - f2)), 0), 1e-30) / nullif(sum(p) FILTER (WHERE k = f1 OR k = f2), 0))"),
)
PAIR_KINDS = (
    ("render_rms_error_db", "10 * log10(greatest(sum((m - r) * (m - r)) / CASE WHEN sum(r * r) > 0 THEN sum(r * r) ELSE count(*) END, 1e-30))"),
    ("render_max_error_dbfs", "20 * log10(greatest(max(abs(m - r)), 1e-15))"),
)
#: Kinds that are named but never measured.
NEVER = ("element_pitch_only_score", "body_mode_pan", "beating_depth_ratio", "beating_rate_hz", "roughness_ratio", "pitch_pull_cents")


def _long(df: DataFrame, keys: list[str], kinds: tuple) -> DataFrame:
    wide = df.groupBy(*keys).agg(*[F.expr(text).cast("double").alias(name) for name, text in kinds])
    return wide.unpivot(keys, [k[0] for k in kinds], "kind", "value").withColumn("value", tidy(F.col("value")))


def compare(long: DataFrame, scope: str) -> DataFrame:
    """(side, case, kind, value) to checks: reference, model, their difference."""
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("value")))
    rows = long.groupBy("case", "kind").agg(side("reference").alias("reference_value"), side("model").alias("model_value"))
    return _check(rows.withColumn("delta", tidy(F.col("model_value") - F.col("reference_value"))), scope)


def _check(rows: DataFrame, scope: str) -> DataFrame:
    known = F.when(F.col("delta").isNull(), "UNAVAILABLE").otherwise("AVAILABLE")
    return rows.select(F.lit(scope).alias("scope"), "case", "kind", "reference_value", "model_value", "delta", known.alias("availability"))


def scans(samples: DataFrame) -> DataFrame:
    return compare(_long(samples, ["side", "case"], SCAN_KINDS), "scan")


def spectrum_checks(bins: DataFrame) -> DataFrame:
    return compare(_long(bins, ["side", "case"], SPECTRUM_KINDS), "spectrum")


def render_checks(pairs: DataFrame, lags: DataFrame, edges: DataFrame, bins: DataFrame) -> DataFrame:
    """What rendering changes, baseline to variant, on either side, and how the model's
    change differs from the reference's.

    pairs: side, case, r, m (baseline and variant, aligned at their best lag). lags: side,
    case, lag, correlation. edges: side, case, role, first, last (seconds at which a tenth
    of the peak is first and last reached). bins: side, case, role, k, p, hz.
    """
    found = _long(pairs, ["side", "case"], PAIR_KINDS)
    row = lambda df, kind, value: df.select("side", "case", F.lit(kind).alias("kind"), tidy(value.cast("double")).alias("value"))
    found = found.unionByName(row(lags, "render_lag_samples", F.col("lag"))).unionByName(row(lags, "render_correlation", F.col("correlation")))
    role = lambda which, c: F.max(F.when(F.col("role") == which, F.col(c)))
    ends = edges.withColumn("lasts", F.col("last") - F.col("first")).groupBy("side", "case").agg(
        (role("variant", "first") - role("baseline", "first")).alias("attack"), (role("variant", "lasts") - role("baseline", "lasts")).alias("decay")
    )
    found = found.unionByName(row(ends, "render_attack_delta_seconds", F.col("attack"))).unionByName(row(ends, "render_decay_delta_seconds", F.col("decay")))
    both = bins.filter("k >= 1").groupBy("side", "case", "k").agg(role("baseline", "p").alias("r"), role("variant", "p").alias("m")).filter("r > 0 and m > 0")
    far = both.groupBy("side", "case").agg(F.sqrt(F.avg(F.pow(10 * F.log10(F.col("m") / F.col("r")), F.lit(2)))).alias("far"))
    top = bins.groupBy("side", "case", "role").agg(F.max_by("hz", F.struct("p", -F.col("k"))).alias("hz")).groupBy("side", "case").agg(role("baseline", "hz").alias("r"), role("variant", "hz").alias("m"))
    found = found.unionByName(row(far, "render_spectral_distance_db", F.col("far"))).unionByName(row(top.filter("r > 0 and m > 0"), "render_pitch_delta_cents", 1200 * F.log2(F.col("m") / F.col("r"))))
    known = F.col("reference_value").isNotNull() | F.col("model_value").isNotNull()
    return compare(found, "render").withColumn("availability", F.when(known, "AVAILABLE").otherwise("UNAVAILABLE"))


def never(cases: DataFrame) -> DataFrame:
    """The kinds that are declared and always unavailable, for each case."""
    none = F.lit(None).cast("double")
    rows = cases.select("case", F.explode(F.array(*[F.lit(k) for k in NEVER])).alias("kind"))
    return _check(rows.select("case", "kind", none.alias("reference_value"), none.alias("model_value"), none.alias("delta")), "declared")


def element_checks(distances: DataFrame, levels: DataFrame, carryovers: DataFrame) -> DataFrame:
    """Distinctness and gain-only score of each pair of elements (left_element,
    right_element, reference_distance, model_distance) that both sides have, with levels
    (side, element, db), and the carryover, the median over transitions (side, db)."""
    side = lambda s, c="db": F.max(F.when(F.col("side") == s, F.col(c)))
    level = levels.groupBy("element").agg(side("reference").alias("r"), side("model").alias("m"))
    named = lambda end: level.select(F.col("element").alias(f"{end}_element"), F.col("r").alias(f"{end}_r"), F.col("m").alias(f"{end}_m"))
    pairs = distances.filter("reference_distance is not null and model_distance is not null")
    pairs = pairs.join(named("left"), "left_element", "left").join(named("right"), "right_element", "left").withColumn("case", F.concat_ws("|", "left_element", "right_element"))
    score = lambda s, distance: F.least(F.lit(1.0), F.abs(F.col(f"right_{s}") - F.col(f"left_{s}")) / 6) / (1 + F.col(distance))
    # least() passes over nulls: a score needs the four levels
    leveled = pairs.filter("left_r is not null and left_m is not null and right_r is not null and right_m is not null")
    value = lambda df, kind, r, m: df.select("case", F.lit(kind).alias("kind"), tidy(r).alias("reference_value"), tidy(m).alias("model_value"))
    rows = value(pairs, "element_distinctness_ratio", F.col("reference_distance"), F.col("model_distance"))
    rows = rows.unionByName(value(leveled, "element_gain_only_score", score("r", "reference_distance"), score("m", "model_distance")))
    middle = carryovers.groupBy("side").agg(F.percentile("db", 0.5).alias("db")).agg(side("reference").alias("r"), side("model").alias("m"))
    rows = rows.unionByName(value(middle.withColumn("case", F.lit("")), "element_carryover_db", F.col("r"), F.col("m")))
    return _check(rows.withColumn("delta", tidy(F.col("model_value") - F.col("reference_value"))), "element")


def shift_checks(lags: DataFrame, peaks: DataFrame) -> DataFrame:
    """Best lag (case, lag) of the model behind the reference, and cents between their
    strongest frequencies (side, case, hz), which must be above 0 on both sides."""
    none = F.lit(None).cast("double")
    side = lambda s: F.max(F.when((F.col("side") == s) & (F.col("hz") > 0), F.col("hz")))
    cents = peaks.groupBy("case").agg(tidy(1200 * F.log2(side("model") / side("reference"))).alias("delta"))
    rows = lags.select("case", F.lit("render_lag_samples").alias("kind"), F.col("lag").cast("double").alias("delta"))
    rows = rows.unionByName(cents.select("case", F.lit("render_pitch_delta_cents").alias("kind"), "delta"))
    return _check(rows.withColumn("reference_value", none).withColumn("model_value", none), "render")


def _raw_score():
    """A check's score before it is bounded; null for kinds that are never findings."""
    kind, delta, r, m = F.col("kind"), F.abs("delta"), F.col("reference_value"), F.col("model_value")
    out = F.lit(None).cast("double")
    for name, scale in DELTA_SCALES.items():
        out = F.when(kind == name, delta / scale).otherwise(out)
    for name, least in RELATIVE.items():
        out = F.when(kind == name, delta / F.greatest(F.abs(r), F.lit(least))).otherwise(out)
    for name, (off, scale) in FAULTS.items():
        v = F.coalesce(m, r)
        v = F.abs(v) if name in SIGNLESS else v - off
        out = F.when(kind == name, F.greatest(v, F.lit(0.0)) / scale).otherwise(out)
    # a mode counts from a fixed number of cents on, and then at least as the least finding
    cents = F.when((r > 0) & (m > 0), F.abs(1200 * F.log2(m / F.when(r > 0, r))))
    out = F.when(kind == "body_mode_frequency_hz", F.when(F.round(cents, 6) >= MODE_CENTS, F.greatest(cents / 100, F.lit(REVIEW)))).otherwise(out)
    return F.when(kind == "body_mode_distance_cents", F.abs(F.coalesce(m, F.col("delta"))) / 100).otherwise(out)


def findings(checks: DataFrame) -> DataFrame:
    """The checks that reach the review threshold, with class, severity, code and score, the
    gravest first; ties by scope, case and kind."""
    from gaugeworks.operators.profiles import ranked

    # least() passes over nulls, and a kind without a score is no finding
    raw = F.col("raw")
    rows = checks.filter("availability = 'AVAILABLE'").withColumn("raw", _raw_score()).filter(raw.isNotNull() & ~F.isnan(raw))
    rows = rows.withColumn("score", tidy(F.least(raw + 1e-9, F.lit(1.0)))).drop("raw").filter(F.col("score") >= REVIEW)
    fault = F.col("kind").isin(*FAULTS)
    rows = rows.withColumn("class", F.when(fault, "FAULT").otherwise("GAP")).withColumn("code", F.when(fault, "numeric-fault").otherwise("physical-gap"))
    rows = rows.withColumn("severity", F.when(F.col("score") >= CRITICAL, "CRITICAL").when(F.col("score") >= WARNING, "WARNING").otherwise("INFO"))
    return ranked(rows, [F.desc("score"), "scope", "case", "kind"], "score", "finding")


def mode_facts(modes: DataFrame, step: float) -> DataFrame:
    """Bandwidth at half power, Q, decay and distance of paired modes (case, strength, side,
    hz, p, left, right): the width comes from the neighbours' powers."""
    slope = lambda c: F.when(F.col("p") > F.col(c), F.least(F.lit(1.0), F.col("p") / 2 / (F.col("p") - F.col(c)))).otherwise(1.0)
    width = (slope("left") + slope("right")) * step
    rows = modes.withColumn("bandwidth", width)
    wide = rows.select(
        "side",
        "case",
        F.col("hz").alias("body_mode_frequency_hz"),
        F.col("bandwidth").alias("body_mode_bandwidth_hz"),
        (F.col("hz") / F.col("bandwidth")).alias("body_mode_q"),
        F.col("prominence").alias("body_mode_prominence_db"),
        (F.lit(LN_1000) / (F.pi() * F.col("bandwidth"))).alias("body_mode_decay_seconds"),
    )
    names = [c for c in wide.columns if c.startswith("body_")]
    long = wide.unpivot(["side", "case"], names, "kind", "value").withColumn("value", tidy(F.col("value")))
    checks = compare(long, "mode")
    f = wide.groupBy("case").pivot("side", ["reference", "model"]).agg(F.max("body_mode_frequency_hz"))
    none = F.lit(None).cast("double")
    apart = f.select("case", F.lit("body_mode_distance_cents").alias("kind"), none.alias("reference_value"), none.alias("model_value"), tidy(1200 * F.log2(F.col("model") / F.col("reference"))).alias("delta"))
    return checks.unionByName(_check(apart, "mode"))
