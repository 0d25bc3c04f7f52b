"""Operators on ordered series: one window or group by series, no global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions.expr import amplitude_db, loudness, power_db, rounded, tidy
from gaugeworks.functions.stats import correlation


def numbered(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``n``: the row's place in its series, from 0."""
    return df.withColumn("n", (F.row_number().over(W.partitionBy(*key).orderBy(*order)) - 1).cast("long"))


def level_facts(df: DataFrame, key: list[str], bound: float) -> DataFrame:
    """Of samples (key, n, x): peak, rms, mean, crest, sign changes (zeros skipped), clips."""
    w = W.partitionBy(*key).orderBy("n")
    sign = F.when(F.col("x") != 0, F.signum("x"))
    before = F.last(sign, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("turn", F.when(sign != before, 1).otherwise(0))
    peak, rms = F.max(F.abs("x")), F.sqrt(F.avg(F.col("x") * F.col("x")))
    return marked.groupBy(*key).agg(
        F.count(F.lit(1)).alias("samples"),
        tidy(peak).alias("peak"),
        tidy(rms).alias("rms"),
        tidy(F.avg("x")).alias("dc"),
        tidy(amplitude_db(peak) - amplitude_db(rms)).alias("crest_db"),
        F.sum("turn").cast("long").alias("zero_crossings"),
        F.sum(F.when(F.abs("x") >= bound, 1).otherwise(0)).cast("long").alias("clipped"),
    )


def moving_loudness(df: DataFrame, key: list[str]) -> DataFrame:
    """Of steps (key, n, p): momentary loudness over four steps at each, short-term over
    thirty at every tenth."""
    w = W.partitionBy(*key).orderBy("n")
    momentary, short = w.rowsBetween(-3, 0), w.rowsBetween(-29, 0)
    return (
        df.withColumn("momentary_power", F.when(F.col("n") >= 3, F.avg("p").over(momentary)))
        .withColumn("short_power", F.when((F.col("n") >= 29) & ((F.col("n") - 29) % 10 == 0), F.avg("p").over(short)))
        .withColumn("momentary_lufs", tidy(F.when(F.col("momentary_power").isNotNull(), loudness(F.col("momentary_power")))))
        .withColumn("short_lufs", tidy(F.when(F.col("short_power").isNotNull(), loudness(F.col("short_power")))))
    )


def _bin(lufs: Column) -> Column:
    """Centre of the 0.1 LU wide histogram bin, 1601 of them from -120."""
    k = F.least(F.greatest(F.floor((lufs + 120) / 0.1), F.lit(0)), F.lit(1600))
    return F.round(F.lit(-120.0) + (k + 0.5) * 0.1, 6)


def gated_loudness(moving: DataFrame, key: list[str]) -> DataFrame:
    """Integrated loudness behind the absolute gate at -70 and the relative one 10 below;
    loudness range between the bins of rank 10 and 95 per cent of short-term values."""
    bins = moving.withColumn("m_bin", _bin(F.col("momentary_lufs"))).withColumn("s_bin", _bin(F.col("short_lufs")))
    mean_above = lambda gate: F.avg(F.when(F.col("m_bin") >= gate, F.col("momentary_power")))
    first = bins.groupBy(*key).agg(mean_above(F.lit(-70.0)).alias("p"))
    gates = first.select(*key, tidy(F.greatest(F.lit(-70.0), loudness(F.col("p")) - 10)).alias("gate"))
    second = bins.join(gates, key).groupBy(*key).agg(tidy(loudness(mean_above(F.col("gate")))).alias("integrated_lufs"))
    floor = second.select(*key, "integrated_lufs", F.greatest(F.lit(-70.0), F.coalesce(F.col("integrated_lufs") - 20, F.lit(-70.0))).alias("range_gate"))
    w = W.partitionBy(*key)
    counts = bins.filter("s_bin is not null").join(floor, key).filter("s_bin >= range_gate").groupBy(*key, "s_bin").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumn("upto", F.sum("c").over(w.orderBy("s_bin"))).withColumn("n", F.sum("c").over(w))
    at = lambda share: F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * share), F.col("s_bin")))
    spread = counts.groupBy(*key).agg(F.max("n").alias("n"), (at(F.lit(95)/100) - at(F.lit(10)/100)).alias("span"))
    spread = spread.select(*key, tidy(F.when(F.col("n") >= 2, F.col("span"))).alias("loudness_range_lu"))
    return second.join(spread, key, "left")


def activity(df: DataFrame, key: list[str], block: int, silence_db: float) -> DataFrame:
    """Share of silent blocks of (key, n, x), and the first and last block that isn't."""
    blocks = df.groupBy(*key, F.floor(F.col("n") / block).alias("b")).agg(F.avg(F.col("x") * F.col("x")).alias("p"))
    silent = tidy(power_db(F.col("p"))) < silence_db
    return blocks.groupBy(*key).agg(
        F.count(F.lit(1)).alias("blocks"),
        tidy(F.avg(F.when(silent, 1.0).otherwise(0.0))).alias("silence_fraction"),
        F.min(F.when(~silent, F.col("b"))).alias("first_active"),
        F.max(F.when(~silent, F.col("b"))).alias("last_active"),
    )


def change_scan(df: DataFrame, key: list[str], block: int) -> DataFrame:
    """Stuck samples, largest step, repeated blocks, drift and return level of (key, n, x)."""
    w = W.partitionBy(*key).orderBy("n")
    count = F.count(F.lit(1)).over(W.partitionBy(*key))
    rows = df.withColumn("prev", F.lag("x").over(w)).withColumn("of", count)
    tenth = F.floor(F.col("of") / 10)
    early, late = F.col("n") < tenth, F.col("n") >= F.col("of") - tenth
    facts = rows.groupBy(*key).agg(
        tidy(F.sum(F.when((F.col("x") == F.col("prev")) & (F.col("x") != 0), 1).otherwise(0)) / F.count(F.lit(1))).alias("stuck_fraction"),
        tidy(amplitude_db(F.max(F.abs(F.col("x") - F.col("prev"))))).alias("max_step_db"),
        tidy(F.avg(F.when(late, F.col("x"))) - F.avg(F.when(early, F.col("x")))).alias("dc_drift"),
        tidy(amplitude_db(F.sqrt(F.avg(F.when(late, F.col("x") * F.col("x")))))).alias("return_level_db"),
    )
    shape = df.groupBy(*key, F.floor(F.col("n") / block).alias("b")).agg(
        F.count(F.lit(1)).alias("c"), F.max(F.abs("x")).alias("top"), F.sort_array(F.collect_list(F.struct("n", "x")))["x"].alias("xs")
    )
    whole = shape.filter((F.col("c") == block) & (F.col("top") > 0))
    whole = whole.withColumn("again", F.when(F.col("xs") == F.lag("xs").over(W.partitionBy(*key).orderBy("b")), 1).otherwise(0))
    repeats = whole.groupBy(*key).agg(tidy(F.avg(F.col("again").cast("double"))).alias("repeated_block_fraction"))
    return facts.join(repeats, key, "left")


def slopes(df: DataFrame, key: list[str]) -> DataFrame:
    """Of (key, t, y): regression slope, spread, and change from first to last value."""
    return df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("points"),
        tidy(F.regr_slope("y", "t")).alias("slope"),
        tidy(F.stddev_pop("y")).alias("spread"),
        tidy(F.max_by("y", "n") - F.min_by("y", "n")).alias("fall"),
        tidy(F.regr_r2("y", "t")).alias("r_squared"),
    )


def islands(df: DataFrame, key: list[str], order: list[str], on: Column) -> DataFrame:
    """``island``: number of the run of rows in which ``on`` is constant."""
    w = W.partitionBy(*key).orderBy(*order)
    turn = F.when(on == F.lag(on).over(w), 0).otherwise(1)
    return df.withColumn("_turn", turn).withColumn("island", F.sum("_turn").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_turn")


def overlaps(spans: DataFrame, key: list[str], least: int = 2) -> DataFrame:
    """Maximal regions in which ``least`` spans (key, start, end) overlap at once. Spans are
    half open: at one time ends come before starts."""
    points = spans.select(*key, F.inline(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step")))))
    points = points.groupBy(*key, "at").agg(F.sum("step").alias("step"))
    w = W.partitionBy(*key).orderBy("at")
    points = points.withColumn("depth", F.sum("step").over(w)).withColumn("until", F.lead("at").over(w))
    runs = islands(points, key, ["at"], F.col("depth") >= least).filter(F.col("depth") >= least)
    return runs.groupBy(*key, "island").agg(F.min("at").alias("region_start"), F.max("until").alias("region_end"), F.max("depth").cast("long").alias("depth")).drop("island")


def lagged_correlation(df: DataFrame, key: list[str], reach: int, a: str = "a", b: str = "b") -> DataFrame:
    """(key, lag, pairs, correlation) of a at n with b at n + lag. Rows meet by equal
    (key, n) after each is dealt to its lags, so the join's size is rows times lags."""
    left = df.filter(F.col(a).isNotNull()).select(*key, F.col("n"), F.col(a).alias("_a"))
    right = df.filter(F.col(b).isNotNull()).select(*key, F.explode(F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long"))).alias("lag"), F.col("n").alias("m"), F.col(b).alias("_b"))
    right = right.select(*key, "lag", (F.col("m") - F.col("lag")).alias("n"), "_b")
    return left.join(right, [*key, "n"]).groupBy(*key, "lag").agg(F.count(F.lit(1)).alias("pairs"), tidy(correlation("_a", "_b")).alias("correlation"))


def best_lag(lags: DataFrame, key: list[str], total: str, least: int = 3) -> DataFrame:
    """The lag of the largest abs(correlation) times overlap; ties: smaller, then positive."""
    score = rounded(F.abs("correlation") * F.col("pairs") / F.col(total), 6)
    w = W.partitionBy(*key).orderBy(F.desc("score"), F.abs("lag"), F.desc("lag"))
    usable = lags.filter((F.col("pairs") >= least) & F.col("correlation").isNotNull() & ~F.isnan("correlation")).withColumn("score", score)
    return usable.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def tempo_spans(points: DataFrame, key: list[str]) -> DataFrame:
    """(key, beat, bpm) to spans with the seconds at which each begins."""
    w = W.partitionBy(*key).orderBy("beat")
    lasts = (F.lead("beat").over(w) - F.col("beat")) * 60 / F.col("bpm")
    before = W.partitionBy(*key).orderBy("beat").rowsBetween(W.unboundedPreceding, -1)
    return (
        points.withColumn("until", F.lead("beat").over(w))
        .withColumn("_lasts", lasts)
        .withColumn("seconds", F.coalesce(F.sum("_lasts").over(before), F.lit(0.0)))
        .drop("_lasts")
    )


def interval_join(points: DataFrame, spans: DataFrame, key: list[str], at: str, start: str, end: str, width: float) -> DataFrame:
    """Points with the spans that hold them (start <= at < end). Spans are dealt to buckets
    of ``width``, so this is an equi join; an open end is bounded by the last point.

    A width near the usual span keeps a span in few buckets and a bucket to few spans.
    """
    last = points.groupBy(*key).agg(F.max(at).alias("_last")) if key else points.agg(F.max(at).alias("_last"))
    bounded = spans.join(last, key) if key else spans.crossJoin(F.broadcast(last))
    top = F.least(F.coalesce(F.col(end), F.col("_last")), F.col("_last"))
    low, high = F.floor(F.col(start) / width), F.floor(top / width)
    dealt = bounded.filter(high >= low).withColumn("_bucket", F.explode(F.sequence(low, high))).drop("_last")
    inside = (F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    return points.withColumn("_bucket", F.floor(F.col(at) / width)).join(dealt, [*key, "_bucket"]).filter(inside).drop("_bucket")


def sliding_rms(df: DataFrame, key: list[str], hop: int, hops: int = 2, x: str = "x") -> DataFrame:
    """(key, frame, rms, level_db) of windows of ``hops`` hops, one every ``hop`` samples;
    only whole windows. Hops are summed first, so samples move once and as sums."""
    parts = df.groupBy(*key, F.floor(F.col("n") / hop).alias("frame")).agg(F.sum(F.col(x) * F.col(x)).alias("s"), F.count(x).alias("c"))
    w = W.partitionBy(*key).orderBy("frame").rangeBetween(0, hops - 1)
    rows = parts.withColumn("power", F.sum("s").over(w) / F.lit(hop * hops)).withColumn("c", F.sum("c").over(w)).filter(F.col("c") == hop * hops)
    return rows.select(*key, "frame", tidy(F.sqrt("power")).alias("rms"), tidy(power_db(F.col("power"))).alias("level_db"))


#: Least pitch confidence for a tuning; for a glide, its least range in semitones, the step against its
#: direction that is let pass, and the least share of steps in it.
TUNING_CONFIDENCE, GLIDE_RANGE, GLIDE_SLIP, GLIDE_SHARE = 0.35, 0.5, 0.05, 0.65


def tuning_offset(df: DataFrame, key: list[str], silence: float) -> DataFrame:
    """(key, offset_cents, confidence): the circular mean, by pitch confidence, of how far
    pitches (pitch_hz, confidence, level) lie from the nearest semitone."""
    midi = 69 + 12 * F.log2(F.col("pitch_hz") / 440)
    turn = 2 * F.pi() * (midi - F.floor(midi + 0.5))
    usable = (F.col("pitch_hz") > 0) & (F.col("confidence") >= TUNING_CONFIDENCE) & (F.col("level") >= silence)
    weight = F.col("confidence")
    sums = df.filter(usable).groupBy(*key).agg(F.sum(weight * F.cos(turn)).alias("x"), F.sum(weight * F.sin(turn)).alias("y"), F.sum(weight).alias("w"))
    length = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return sums.select(*key, tidy(100 * F.atan2("y", "x") / (2 * F.pi())).alias("offset_cents"), tidy(F.least(length / F.col("w"), F.lit(1.0))).alias("confidence"))


def pitch_continuity(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """(key, points, confidence, glide): whether the confident pitches (midi, rising: the
    next note is higher) between two notes move from one to the other: three or more, over
    half a semitone or more, most steps in the direction."""
    w = W.partitionBy(*key).orderBy(order)
    change = F.round(F.col("midi") - F.lag("midi").over(w), 9)
    directed = F.when(F.col("rising"), F.col("change") >= -GLIDE_SLIP).otherwise(F.col("change") <= GLIDE_SLIP)
    rows = df.withColumn("change", change).withColumn("directed", F.when(F.col("change").isNotNull(), directed))
    found = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("points"), (F.max("midi") - F.min("midi")).alias("range"), F.count(F.when(F.col("directed"), 1)).alias("steps"))
    enough = (F.col("points") >= 3) & (F.round("range", 9) >= GLIDE_RANGE)
    share = F.when(enough, F.col("steps") / F.when(F.col("points") > 1, F.col("points") - 1)).otherwise(0.0)
    return found.select(*key, "points", tidy(share).alias("confidence"), (F.round(share, 9) >= GLIDE_SHARE).alias("glide"))
