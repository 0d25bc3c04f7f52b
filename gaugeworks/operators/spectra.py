"""Spectra held as arrays: descriptors, bands, chroma, modes and similarities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions.expr import band, cosine, power_db, tidy


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, v: s + v)


def _bins(df: DataFrame, key: list[str], step: float) -> DataFrame:
    """Long form without the constant bin: key, k, p, hz."""
    return df.select(*key, F.posexplode("power").alias("k", "p")).filter("k > 0").withColumn("hz", F.col("k") * step)


def descriptors(df: DataFrame, key: list[str], step: float) -> DataFrame:
    """Centroid, spread, 85 per cent rolloff, flatness and slope per octave.

    Sums run over each row's own array; nothing is shuffled but the slope's regression,
    which array functions give as well.
    """
    p = F.slice("power", 2, 1 << 20)
    hz = F.transform(F.sequence(F.lit(1), F.size("power") - 1), lambda k: k * step)
    rows = df.select(*key, p.alias("p"), hz.alias("hz"), _sum(p).alias("total"))
    rows = rows.withColumn("centroid", _sum(F.zip_with("p", "hz", lambda a, f: a * f)) / F.col("total"))
    db = F.transform("p", lambda v: 10 * F.log10(F.greatest(v, F.lit(1e-30))))
    octave = F.transform("hz", lambda f: F.log2(f / 1000))
    rows = rows.withColumn("db", db).withColumn("oct", octave).withColumn("n", F.size("p"))
    mean = lambda c: _sum(F.col(c)) / F.col("n")
    rows = rows.withColumn("mx", mean("oct")).withColumn("my", mean("db"))
    slope = _sum(F.zip_with("oct", "db", lambda x, y: (x - F.col("mx")) * (y - F.col("my")))) / _sum(F.transform("oct", lambda x: (x - F.col("mx")) * (x - F.col("mx"))))
    spread = F.sqrt(_sum(F.zip_with("p", "hz", lambda a, f: a * (f - F.col("centroid")) * (f - F.col("centroid")))) / F.col("total"))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k"))
    reach = F.aggregate("p", start, lambda acc, v: F.struct((acc["s"] + v).alias("s"), F.when(acc["s"] >= 0.85 * F.col("total") - 1e-15, acc["k"]).otherwise(acc["k"] + 1).alias("k")))
    flat = F.exp(_sum(F.transform("p", lambda v: F.ln(F.greatest(v, F.lit(1e-30))))) / F.col("n")) / (F.col("total") / F.col("n"))
    return rows.select(
        *key,
        F.round("centroid", 4).alias("centroid_hz"),
        F.round(spread, 4).alias("spread_hz"),
        (reach["k"] * step).alias("rolloff_hz"),
        tidy(flat).alias("flatness"),
        tidy(slope, 4).alias("slope_db_per_octave"),
    )


def band_levels(df: DataFrame, key: list[str], step: float) -> DataFrame:
    bands = _bins(df, key, step).groupBy(*key, band(F.col("hz")).alias("band")).agg(F.sum("p").alias("p"))
    total = F.sum("p").over(W.partitionBy(*key))
    return bands.select(*key, "band", tidy(power_db(F.col("p"))).alias("level_db"), tidy(power_db(F.col("p")) - power_db(total)).alias("balance_db"))


def chroma(df: DataFrame, key: list[str], step: float) -> DataFrame:
    """Magnitude by pitch class, split linearly between neighbours, to unit length."""
    bins = _bins(df, key, step).filter("hz between 55 and 5000")
    midi = 69 + 12 * F.log2(F.col("hz") / 440)
    bins = bins.select(*key, midi.alias("midi"), (F.sqrt("p") * F.sqrt(440 / F.col("hz"))).alias("w"))
    low = F.floor("midi")
    part = F.col("midi") - low
    two = F.array(F.struct((low % 12).alias("pitch_class"), (F.col("w") * (1 - part)).alias("w")), F.struct(((low + 1) % 12).alias("pitch_class"), (F.col("w") * part).alias("w")))
    sums = bins.select(*key, F.inline(two)).groupBy(*key, "pitch_class").agg(F.sum("w").alias("w"))
    return sums.select(*key, "pitch_class", tidy(F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(*key)))).alias("weight"))


def modes(df: DataFrame, key: list[str], step: float, most: int) -> DataFrame:
    """The strongest local maxima that stand 3 dB over the mean of the bins around."""
    bins = df.select(*key, F.posexplode("power").alias("k", "p")).withColumn("db", 10 * F.log10(F.greatest("p", F.lit(1e-12))))
    w = W.partitionBy(*key).orderBy("k")
    wide, near = w.rowsBetween(-16, 16), w.rowsBetween(-2, 2)
    others = F.count(F.lit(1)).over(wide) - F.count(F.lit(1)).over(near)
    base = (F.sum("db").over(wide) - F.sum("db").over(near)) / F.when(others != 0, others)
    rows = bins.select(*key, "k", "p", tidy(F.col("db") - base).alias("prominence_db"), F.lag("p").over(w).alias("a"), F.lead("p").over(w).alias("b"))
    tops = rows.filter("p > a and p >= b and prominence_db >= 3")
    strength = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("p"), "k"))
    return tops.withColumn("strength", strength).filter(F.col("strength") <= most).select(*key, F.col("k").cast("long").alias("bin"), (F.col("k") * step).alias("frequency_hz"), "prominence_db", F.col("strength").cast("long").alias("strength"))


def _with_prior(df: DataFrame, part: list[str], order: str, vector: str) -> DataFrame:
    w = W.partitionBy(*part).orderBy(order)
    return df.withColumn("prior", F.lag(vector).over(w)).withColumn("prior_id", F.lag(order).over(w)).filter("prior_id is not null")


def similarity_to_prior(df: DataFrame, part: list[str], order: str, vector: str) -> DataFrame:
    return _with_prior(df, part, order, vector).select(order, "prior_id", tidy(cosine(F.col(vector), F.col("prior"))).alias("similarity"))


def _magnitudes(c: str) -> Column:
    return F.transform(c, lambda v: F.abs(v.cast("double")))


def flux(df: DataFrame, part: list[str], order: str, vector: str) -> DataFrame:
    """Rise of magnitudes over the prior frame, against this frame's sum and the prior's."""
    rows = _with_prior(df, part, order, vector).select(order, _magnitudes(vector).alias("x"), _magnitudes("prior").alias("y"))
    rise = _sum(F.zip_with("x", "y", lambda a, b: F.greatest(a - b, F.lit(0.0))))
    share = lambda c: tidy(rise / F.when(_sum(F.col(c)) > 0, _sum(F.col(c))))
    return rows.select(order, share("x").alias("flux"), share("y").alias("flux_on_prior"))


def frame_costs(df: DataFrame, part: list[str], order: str, vector: str) -> DataFrame:
    rows = _with_prior(df, part, order, vector).select(order, "prior_id", _magnitudes(vector).alias("x"), _magnitudes("prior").alias("y"))
    level = lambda c: 10 * F.log10(F.greatest(_sum(F.transform(c, lambda v: v * v)) / F.size(c), F.lit(1e-30)))
    onset = F.abs(F.array_max("x") - F.array_max("y"))
    cost = 0.5 * (1 - cosine(F.col("x"), F.col("y"))) + 0.2 * F.least(onset, F.lit(1.0)) + 0.1 * F.least(F.abs(level("x") - level("y")) / 24, F.lit(1.0))
    return rows.select(order, "prior_id", tidy(cost / 0.8).alias("cost"))


def density(df: DataFrame, key: list[str], step: float) -> DataFrame:
    """Local maxima of each spectrum, and their number per kHz of its range."""
    inner = F.transform(F.sequence(F.lit(2), F.size("power") - 1), lambda k: F.slice("power", k - 1, F.lit(3)))
    tops = F.size(F.filter(inner, lambda t: (t[1] > t[0]) & (t[1] >= t[2]))).cast("long")
    return df.select(*key, tops.alias("maxima"), tidy(tops / (F.size("power") * step / 1000)).alias("body_mode_density_per_khz"))
