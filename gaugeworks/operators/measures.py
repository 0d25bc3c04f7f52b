"""The measurement catalogue: what is measured of each item, as rows.

A kind is an aggregate over the item's frames, bands, partials or attack bins, written as
an SQL expression over their columns; every item gets a row for each kind, with a value or
with the status that says why there is none.

frames: item, t, x2 (mean square), top (peak), level, centroid, flatness, flux, pitch,
target, fault, harmonic, residual, start_sample, end_sample, rate (of the item) and, from
``prepare``, cents, n, k (rank from the end), steady, calm3.
bands: item, t, band, level, residual. partials: item, t, partial, cents, level, power.
context: item, x2 of what stands before the item. Every divisor that data can make zero is
guarded, and gives no value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions.expr import tidy

_RMS = "10 * log10(greatest(avg(x2), 1e-30))"
_SECONDS = "max(end_sample - start_sample) * 1.0e0 / nullif(max(rate), 0)"


def _corr(a: str, b: str) -> str:
    """Pearson's r over rows that have both; null where either is constant."""
    both = f"FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    return f"covar_pop({a}, {b}) {both} / nullif(round(stddev_pop({a}) {both} * stddev_pop({b}) {both}, 12), 0)"


#: Kind, unit, whether it is a level, what it needs, expression.
FRAME_KINDS = (
    ("rms_dbfs", "dBFS", True, "signal", _RMS),
    ("peak_dbfs", "dBFS", True, "signal", "20 * log10(greatest(max(top), 1e-15))"),
    ("crest_db", "dB", False, "signal", f"20 * log10(greatest(max(top), 1e-15)) - {_RMS}"),
    ("centroid_hz", "Hz", False, "signal", "avg(centroid)"),
    ("flatness", "ratio", False, "signal", "avg(flatness)"),
    ("level_slope_db_per_second", "dB/s", False, "signal", "regr_slope(level, t)"),
    ("centroid_slope_hz_per_second", "Hz/s", False, "signal", "regr_slope(centroid, t)"),
    ("transient_rate_hz", "Hz", False, "signal", f"count(*) FILTER (WHERE flux >= 0.20) / nullif({_SECONDS}, 0)"),
    ("fixed_state_fraction", "ratio", False, "signal", "count(*) FILTER (WHERE steady) * 1.0e0 / nullif(count(*) - 1, 0)"),
    ("level_modulation_spread_db", "dB", False, "signal", "CASE WHEN count(level) >= 2 THEN stddev_pop(level) END"),
    ("centroid_modulation_spread_hz", "Hz", False, "signal", "CASE WHEN count(centroid) >= 2 THEN stddev_pop(centroid) END"),
    ("pitch_hz", "Hz", False, "pitch", "avg(pitch)"),
    ("tuning_offset_cents", "cents", False, "pitch", "avg(cents)"),
    ("pitch_spread_cents", "cents", False, "pitch", "stddev_pop(cents)"),
    ("pitch_overshoot_cents", "cents", False, "pitch", "max(cents) - avg(cents)"),
    ("pitch_undershoot_cents", "cents", False, "pitch", "avg(cents) - min(cents)"),
    ("pitch_drift_cents_per_second", "cents/s", False, "pitch", "regr_slope(cents, t)"),
    ("pitch_settle_seconds", "s", False, "pitch", "min(t) FILTER (WHERE calm3) - min(t)"),
    ("octave_fault_fraction", "ratio", False, "pitch", "avg(CASE WHEN fault THEN 1.0e0 ELSE 0.0e0 END) FILTER (WHERE pitch IS NOT NULL)"),
    ("glide_time_seconds", "s", False, "pitch", "min(t) FILTER (WHERE glide >= 0.9) - min(t) FILTER (WHERE glide >= 0.1)"),
    ("portamento_linearity", "ratio", False, "pitch", "regr_r2(cents, t) FILTER (WHERE glide BETWEEN 0.1 AND 0.9)"),
    ("harmonic_level_dbfs", "dBFS", True, "signal", "avg(harmonic)"),
    ("residual_level_dbfs", "dBFS", True, "signal", "avg(residual)"),
    ("hnr_db", "dB", False, "signal", "avg(harmonic - residual)"),
    ("harmonic_decay_db_per_second", "dB/s", False, "signal", "regr_slope(harmonic, t)"),
    ("pitch_level_correlation", "ratio", False, "pitch", _corr("cents", "level")),
    ("pitch_tone_correlation", "ratio", False, "pitch", _corr("cents", "centroid")),
    ("noise_burst_seconds", "s", False, "signal", "min_by(t, struct(-residual, n)) - min(t)"),
    ("early_damping_db_per_second", "dB/s", False, "signal", "regr_slope(level, t) FILTER (WHERE k < 5)"),
    ("pitch_fall_cents", "cents", False, "pitch", "max_by(cents, n) FILTER (WHERE cents IS NOT NULL) - min_by(cents, n) FILTER (WHERE cents IS NOT NULL)"),
    ("decay_db", "dB", False, "signal", "min_by(level, n) - max_by(level, n)"),
    ("residual_excitation_dbfs", "dBFS", True, "signal", "max_by(residual, n)"),
    ("carryover_db", "dB", False, "signal", "min_by(level, n) - max_by(level, n)"),
    ("transition_pitch_change_cents", "cents", False, "pitch", "avg(cents) FILTER (WHERE k < 3) - avg(cents) FILTER (WHERE n < 3)"),
    ("transition_tone_change_hz", "Hz", False, "signal", "max_by(centroid, n) - min_by(centroid, n)"),
    ("attack_delay_seconds", "s", False, "any", "min(t) - min(source_start)"),
    ("duration_seconds", "s", False, "any", _SECONDS),
)
CONTEXT_KINDS = (("pre_note_residual_dbfs", "dBFS", True, "any", _RMS),)
ATTACK_KINDS = (
    ("rise_10_seconds", "s", False, "signal", "min(b) FILTER (WHERE rel >= 0.1) * max(width)"),
    ("rise_50_seconds", "s", False, "signal", "min(b) FILTER (WHERE rel >= 0.5) * max(width)"),
    ("rise_90_seconds", "s", False, "signal", "min(b) FILTER (WHERE rel >= 0.9) * max(width)"),
    ("attack_slope_db_per_second", "dB/s", False, "signal", "20 * log10(9.0e0) / nullif((min(b) FILTER (WHERE rel >= 0.9) - min(b) FILTER (WHERE rel >= 0.1)) * max(width), 0)"),
    ("attack_overshoot_db", "dB", False, "signal", "20 * log10(greatest(max(v), 1e-15)) - 20 * log10(greatest(avg(v) FILTER (WHERE b >= 12), 1e-15))"),
)
BAND_KINDS = (
    ("band_level_dbfs", "dBFS", True, "signal", "avg(level)"),
    ("band_balance_db", "dB", False, "signal", "avg(level)"),
    ("band_slope_db_per_second", "dB/s", False, "signal", "regr_slope(level, t)"),
    ("band_modulation_spread_db", "dB", False, "signal", "CASE WHEN count(level) >= 2 THEN stddev_pop(level) END"),
    ("residual_band_level_dbfs", "dBFS", True, "signal", "avg(residual)"),
    ("residual_band_balance_db", "dB", False, "signal", "avg(residual)"),
)
PARTIAL_KINDS = (
    ("partial_frequency_error_cents", "cents", False, "pitch", "avg(cents)"),
    ("partial_level_dbfs", "dBFS", True, "pitch", "avg(level)"),
    ("partial_balance_db", "dB", False, "pitch", "avg(level)"),
    ("partial_presence_fraction", "ratio", False, "pitch", "count(level) * 1.0e0"),
    ("partial_birth_seconds", "s", False, "pitch", "min(t) FILTER (WHERE level IS NOT NULL)"),
    ("partial_loss_seconds", "s", False, "pitch", "max(t) FILTER (WHERE level IS NOT NULL)"),
    ("partial_level_slope_db_per_second", "dB/s", False, "pitch", "regr_slope(level, t)"),
)
#: Kinds whose aggregate is then set against a fact of its item.
AGAINST = {
    "band_balance_db": "band_balance_db - rms",
    "residual_band_balance_db": "residual_band_balance_db - rms",
    "partial_balance_db": "partial_balance_db - rms",
    "partial_presence_fraction": "partial_presence_fraction / nullif(pitch_frames, 0)",
    "partial_birth_seconds": "partial_birth_seconds - item_start",
    "partial_loss_seconds": "partial_loss_seconds - item_start",
}
#: What each partial adds to the kinds of all of an item's.
PARTIAL_SUMS = (
    ("born", "min(t) FILTER (WHERE level IS NOT NULL)"),
    ("power_", "sum(power)"),
    ("bend", "sum(2 * (pow(2.0e0, cents / 1200) - 1) / (partial * partial)) FILTER (WHERE partial > 1)"),
    ("bends", "count(cents) FILTER (WHERE partial > 1)"),
)
HARMONIC_KINDS = (
    ("inharmonicity_b", "ratio", False, "pitch", "sum(bend) / nullif(sum(bends), 0)"),
    ("odd_even_balance_db", "dB", False, "pitch", "10 * log10(greatest(sum(power_) FILTER (WHERE partial % 2 = 1), 1e-30) / greatest(sum(power_) FILTER (WHERE partial % 2 = 0), 1e-30))"),
    ("harmonic_centroid", "ratio", False, "pitch", "sum(power_ * partial) / nullif(sum(power_), 0)"),
    ("partial_onset_spread_seconds", "s", False, "pitch", "CASE WHEN count(*) >= 2 THEN max(born) - min(born) END"),
)
#: What every row of an item must know of it.
FACTS = (("rms", f"round({_RMS}, 9)"), ("frames", "count(*)"), ("pitch_frames", "count(cents)"), ("item_start", "min(t)"))
#: Attack bins, least pitch frames, pitch coverage below which a flag is set.
ATTACK_BINS, LEAST_PITCH, COVERAGE, INCOMPLETE = 16, 3, 0.70, 1
#: What is steady, and how near the mean three calm points in a row are.
STEADY_DB, STEADY_HZ, CALM_CENTS = 0.35, 20.0, 15.0


def _cents() -> F.Column:
    return F.round(1200 * F.log2(F.col("pitch") / F.col("target")), 9)


def prepare(frames: DataFrame) -> DataFrame:
    """Adds what a frame's neighbours and its item tell about it."""
    item, w = W.partitionBy("item"), W.partitionBy("item").orderBy("t")
    rows = frames.withColumn("n", F.row_number().over(w) - 1).withColumn("k", F.row_number().over(item.orderBy(F.desc("t"))) - 1)
    rows = rows.withColumn("cents", _cents())
    step = lambda c, most: F.round(F.abs(F.col(c) - F.lag(c).over(w)), 9) <= most
    rows = rows.withColumn("steady", step("level", STEADY_DB) & step("centroid", STEADY_HZ))
    near = F.round(F.abs(F.col("cents") - F.avg("cents").over(item)), 6) <= CALM_CENTS
    rows = rows.withColumn("near", near)
    rows = rows.withColumn("calm3", F.col("near") & F.lead("near").over(w) & F.lead("near", 2).over(w))
    # share of the way from the first pitch to the last
    first, last = F.first("cents", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.last("cents", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return rows.withColumn("glide", F.round((F.col("cents") - first) / F.when(last != first, last - first), 6))


def _wide(df: DataFrame, keys: list[str], kinds: tuple, more: tuple = ()) -> DataFrame:
    """One aggregation for all kinds; ``more`` (name, expression) ride along."""
    return df.groupBy(*keys).agg(*[F.expr(k[-1]).cast("double").alias(k[0]) for k in kinds], *[(F.expr(e) if isinstance(e, str) else e).alias(name) for name, e in more])


_OF_ITEM = ["item", "rms", "frames", "pitch_frames"]


def _value(kind: str) -> F.Column:
    return tidy(F.expr(AGAINST.get(kind, kind)).cast("double"))


def _rows(kinds: tuple, index: F.Column) -> list[F.Column]:
    """A row for each kind of a wide row."""
    return [F.struct(F.lit(k[0]).alias("kind"), index.cast("long").alias("index"), _value(k[0]).alias("value")) for k in kinds]


def attack_bins(frames: DataFrame) -> DataFrame:
    """(item, b, v, rel, width): root mean squares of sixteen equal parts of each item."""
    item = W.partitionBy("item")
    width = (F.max("t").over(item) - F.min("t").over(item)) / ATTACK_BINS
    place = F.least(F.floor(F.round((F.col("t") - F.min("t").over(item)) / width, 6)), F.lit(ATTACK_BINS - 1))
    bins = frames.select("item", "x2", width.alias("width"), F.when(width > 0, place).otherwise(0).alias("b"))
    bins = bins.groupBy("item", "b").agg(F.round(F.sqrt(F.avg("x2")), 9).alias("v"), F.max("width").alias("width"))
    top = F.max("v").over(item)
    return bins.withColumn("rel", F.round(F.col("v") / F.when(top > 0, top), 9))


def measure(frames: DataFrame, bands: DataFrame, partials: DataFrame, context: DataFrame, floor_db: float = -100.0) -> DataFrame:
    """(item, kind, index, unit, view, value, status, flags) of the whole catalogue.

    A level kind has a second row, LEVEL_RELATIVE, against the median level of all items.
    """
    rows = prepare(frames)
    facts = frames.withColumn("cents", _cents()).groupBy("item").agg(*[F.expr(text).alias(name) for name, text in FACTS])
    none = F.lit(0)
    long = lambda df, kinds, index: df.select(*_OF_ITEM, F.inline(F.array(*_rows(kinds, index))))
    # what is long is never moved: facts meet aggregates, and these become rows where they lie
    found = long(_wide(rows, ["item"], FRAME_KINDS, FACTS), FRAME_KINDS, none)
    found = found.unionByName(long(_wide(attack_bins(frames), ["item"], ATTACK_KINDS).join(facts, "item"), ATTACK_KINDS, none))
    # an item with nothing before it has its row as well
    before = context.groupBy("item").agg(F.expr(f"CASE WHEN count(x2) > 0 THEN {_RMS} END").alias(CONTEXT_KINDS[0][0]))
    found = found.unionByName(long(facts.join(before, "item", "left"), CONTEXT_KINDS, none))
    found = found.unionByName(long(_wide(bands, ["item", "band"], BAND_KINDS).join(facts, "item"), BAND_KINDS, F.col("band")))
    return _finish(found.unionByName(_of_partials(partials, facts)), facts, floor_db)


def _of_partials(partials: DataFrame, facts: DataFrame) -> DataFrame:
    """The kinds of each partial, the order of their births, and the kinds of all of an item's."""
    there = _wide(partials, ["item", "partial"], PARTIAL_KINDS, PARTIAL_SUMS).join(facts, "item")
    birth = _value("partial_birth_seconds")
    part = F.struct(birth.isNull().alias("never"), birth.alias("birth"), F.col("partial").cast("long").alias("partial"), *[_value(k[0]).alias(k[0]) for k in PARTIAL_KINDS])
    # with the item's facts as keys: an item's rows lie together already
    there = _wide(there, _OF_ITEM, HARMONIC_KINDS, (("parts", F.sort_array(F.collect_list(part))),))
    row = lambda kind, index, value: F.struct(F.lit(kind).alias("kind"), index.alias("index"), value.alias("value"))
    order = lambda p, k: F.when(~p["never"], row("partial_onset_order", p["partial"], (k + 1).cast("double")))
    each = F.transform("parts", lambda p, k: F.array(*[row(name, p["partial"], p[name]) for name, *_ in PARTIAL_KINDS], order(p, k)))
    return there.select(*_OF_ITEM, F.inline(F.filter(F.concat(F.array(*_rows(HARMONIC_KINDS, F.lit(0))), F.flatten(each)), lambda r: r.isNotNull())))


def _finish(found: DataFrame, facts: DataFrame, floor_db: float) -> DataFrame:
    spark = found.sparkSession
    every = [*FRAME_KINDS, *CONTEXT_KINDS, *ATTACK_KINDS, *BAND_KINDS, *PARTIAL_KINDS, *HARMONIC_KINDS, ("partial_onset_order", "rank", False, "pitch", "")]
    catalog = spark.createDataFrame([k[:4] for k in every], "kind string, unit string, is_level boolean, needs string")
    middle = facts.agg(F.percentile("rms", 0.5).alias("middle"))
    rows = found.filter("item is not null").join(F.broadcast(catalog), "kind").crossJoin(F.broadcast(middle))
    quiet = F.col("rms") <= floor_db
    status = (
        F.when((F.col("needs") != "any") & quiet, "BELOW_FLOOR")
        .when((F.col("needs") == "pitch") & (F.col("frames") < LEAST_PITCH), "TOO_SHORT")
        .when((F.col("needs") == "pitch") & (F.col("pitch_frames") < LEAST_PITCH), "NO_PITCH")
        .when(F.col("value").isNull() | F.isnan("value"), "NO_DATA")
        .otherwise("VALID")
    )
    rows = rows.withColumn("status", status).withColumn("value", F.when(F.col("status") == "VALID", F.col("value")))
    short = (F.col("needs") == "pitch") & (F.col("pitch_frames") < COVERAGE * F.col("frames"))
    rows = rows.withColumn("flags", F.when(short, INCOMPLETE).otherwise(0))
    views = F.filter(
        F.array(
            F.struct(F.lit("ABSOLUTE").alias("view"), F.col("value").alias("value")),
            F.when(F.col("is_level"), F.struct(F.lit("LEVEL_RELATIVE").alias("view"), tidy(F.col("value") - F.col("middle")).alias("value"))),
        ),
        lambda v: v.isNotNull(),
    )
    return rows.select("item", "kind", "index", "unit", F.inline(views), "status", "flags")


def repeats(frames: DataFrame, part: list[str]) -> DataFrame:
    """(item, kind, value): likeness of each item's attack and pitch curve to those of the
    prior item of its part, and its level against that one's."""
    shape = F.transform(F.sort_array(F.collect_list(F.struct("b", "v"))), lambda s: s["v"])
    attacks = attack_bins(frames).groupBy("item").agg(shape.alias("shape"))
    level = frames.groupBy(*part, "item").agg(F.min("t").alias("start"), (10 * F.log10(F.greatest(F.avg("x2"), F.lit(1e-30)))).alias("level"), F.max("accented").alias("accented"))
    w = W.partitionBy(*part).orderBy("start", "item")
    rows = level.join(attacks, "item").withColumn("prior", F.lag("shape").over(w)).withColumn("contrast", F.col("level") - F.lag("level").over(w))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot("shape", "shape") * dot("prior", "prior"))
    likeness = dot("shape", "prior") / F.when(size > 0, size)
    wide = rows.select(
        "item",
        tidy(likeness).alias("repeated_attack_similarity"),
        tidy(F.col("contrast")).alias("local_contrast_db"),
        tidy(F.when(F.col("accented"), F.col("contrast"))).alias("accent_size_db"),
    )
    return wide.unpivot(["item"], ["repeated_attack_similarity", "local_contrast_db", "accent_size_db"], "kind", "value")
