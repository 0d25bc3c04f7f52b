"""Held-out splits, deterministic samples and the correction fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions import expr as E
from gaugeworks.functions.expr import tidy
from gaugeworks.functions.stats import saturate

#: Spans kept, spans a fit and a view need, limits in dB, and the grids.
TRAIN_KEPT, CHECK_KEPT, LEAST_TRAIN, LEAST_CHECK = 64, 16, 8, 2
GAIN_LIMIT, STEP_LIMIT, MAKEUP_LIMIT, SURVIVES = 6.0, 3.0, 12.0, 0.20
THRESHOLDS = tuple(-48.0 + k for k in range(43))
RATIOS = (1.0, 1.25, 1.5, 2.0, 3.0, 4.0, 6.0, 10.0, 20.0)


def split(df: DataFrame, key: str) -> DataFrame:
    """``split``: check where the SHA-256 of the key behind its first colon is 0 modulo 5."""
    return df.withColumn("split", F.when(E.sha_mod5(E.part_after_colon(F.col(key))) == 0, "check").otherwise("train"))


def sample(df: DataFrame, family: list[str], key: str, train: int = TRAIN_KEPT, check: int = CHECK_KEPT) -> DataFrame:
    """The first of each family and split by the key's digest; ranks stop early per task."""
    w = W.partitionBy(*family, "split").orderBy(F.sha2(key, 256), key)
    ranked = df.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= max(train, check))
    return ranked.filter(F.col("rank") <= F.when(F.col("split") == "train", train).otherwise(check))


def eq_gains(train: DataFrame) -> DataFrame:
    """(node, spans, raw_db, gain_db): the median of reference less model at each node,
    within limits, no further from the node below than a step."""
    raw = E.clamp(F.round(F.percentile(F.col("ref") - F.col("model"), 0.5), 6), -GAIN_LIMIT, GAIN_LIMIT)
    nodes = train.groupBy("node").agg(F.count(F.lit(1)).alias("spans"), raw.alias("raw_db")).filter(F.col("spans") >= LEAST_TRAIN)
    # a handful of nodes: the fold runs over one array
    row = nodes.agg(F.sort_array(F.collect_list(F.struct("node", "spans", "raw_db"))).alias("all"))
    near = lambda done, x: F.when(F.size(done) == 0, x["raw_db"]).otherwise(F.greatest(F.element_at(done, -1) - STEP_LIMIT, F.least(F.element_at(done, -1) + STEP_LIMIT, x["raw_db"])))
    empty = F.array().cast("array<double>")
    gains = F.aggregate("all", empty, lambda done, x: F.concat(done, F.array(near(done, x))))
    return row.select("all", gains.alias("gain")).select(F.inline(F.arrays_zip("all", "gain"))).select(F.col("all.node").cast("long").alias("node"), "all.spans", tidy(F.col("all.raw_db")).alias("raw_db"), tidy(F.col("gain")).alias("gain_db"))


def dynamics(points: DataFrame) -> DataFrame:
    """The compressor (threshold, ratio, makeup_db, sse) that leaves least squared error;
    ties: the first of the grid. ``points`` (ref, model) are a bounded sample."""
    numbers = lambda v: F.array(*[F.lit(float(x)) for x in v])
    grid = points.select("ref", "model", F.explode(numbers(THRESHOLDS)).alias("threshold")).select("*", F.explode(numbers(RATIOS)).alias("ratio"))
    model, threshold = F.col("model"), F.col("threshold")
    squeezed = F.when(model <= threshold, model).otherwise(threshold + (model - threshold) / F.col("ratio"))
    residuals = grid.select("threshold", "ratio", (F.col("ref") - squeezed).alias("residual"))
    makeup = residuals.groupBy("threshold", "ratio").agg(E.clamp(F.percentile("residual", 0.5), -MAKEUP_LIMIT, MAKEUP_LIMIT).alias("makeup"), F.collect_list("residual").alias("r"))
    error = F.aggregate("r", F.lit(0.0), lambda s, x: s + (x - F.col("makeup")) * (x - F.col("makeup")))
    return makeup.select("threshold", "ratio", tidy(F.col("makeup")).alias("makeup_db"), F.round(error, 6).alias("sse")).orderBy("sse", "threshold", "ratio").limit(1)


def dynamics_interval(points: DataFrame) -> DataFrame:
    """(fit, spans, estimate, q05, q95) of the compressor: the fit of all ``points`` (span,
    ref, model), and the spread of the fits that each leave one span out (jack-knife),
    widened to include it. ``points`` are a bounded sample of LEAST_TRAIN spans or more."""
    numbers = lambda v: F.array(*[F.lit(float(x)) for x in v])
    none = points.select(F.lit(None).cast(points.schema["span"].dataType).alias("out"))
    outs = points.select(F.col("span").alias("out")).distinct().unionByName(none.limit(1))
    kept = points.join(F.broadcast(outs), F.col("out").isNull() | (F.col("out") != F.col("span")))
    sets = kept.groupBy("out").agg(F.collect_list(F.struct("ref", "model")).alias("all"), F.countDistinct("span").alias("spans"))
    grid = sets.select("out", "spans", "all", F.explode(numbers(THRESHOLDS)).alias("threshold")).select("*", F.explode(numbers(RATIOS)).alias("ratio"))
    squeezed = lambda x, t: F.when(x <= t, x).otherwise(t + (x - t) / F.col("ratio"))
    rows = grid.select("out", "spans", "threshold", "ratio", F.array_sort(F.transform("all", lambda p: p["ref"] - squeezed(p["model"], F.col("threshold")))).alias("r"))
    half = lambda k: F.element_at("r", k.cast("int"))
    n = F.size("r")
    makeup = E.clamp((half(F.floor((n + 1) / 2)) + half(F.floor(n / 2) + 1)) / 2, -MAKEUP_LIMIT, MAKEUP_LIMIT)
    rows = rows.withColumn("makeup", makeup)
    error = F.aggregate("r", F.lit(0.0), lambda s, x: s + (x - F.col("makeup")) * (x - F.col("makeup")))
    best = rows.groupBy("out").agg(F.min(F.struct(F.round(error, 6).alias("sse"), "threshold", "ratio", "makeup", "spans")).alias("b")).select("out", "b.*")
    left, base = best.filter("out is not null"), best.filter("out is null").select("spans", *[F.col(c).alias(f"_{c}") for c in ("threshold", "ratio", "makeup")])
    sorts = [F.array_sort(F.collect_list(c)).alias(c) for c in ("threshold", "ratio")]
    ends = left.agg(F.count(F.lit(1)).alias("n"), *sorts, F.percentile("makeup", F.array(F.lit(0.05), F.lit(0.95))).alias("makeup")).filter(F.col("n") >= LEAST_TRAIN)
    at = lambda c, k: F.element_at(c, (k + 1).cast("int"))
    low, high = F.floor((F.col("n") - 1) * 0.05), F.ceil((F.col("n") - 1) * 0.95)
    fit = lambda name, c, lo, hi: F.struct(F.lit(name).alias("fit"), tidy(F.col(f"_{c}")).alias("estimate"), tidy(F.least(lo, F.col(f"_{c}"))).alias("q05"), tidy(F.greatest(hi, F.col(f"_{c}"))).alias("q95"))
    fits = [fit(c, c, at(c, low), at(c, high)) for c in ("threshold", "ratio")] + [fit("makeup_db", "makeup", F.col("makeup")[0], F.col("makeup")[1])]
    return ends.crossJoin(base).select("spans", F.explode(F.array(*fits)).alias("f")).select("f.fit", "spans", "f.estimate", "f.q05", "f.q95")


#: Limits of the stereo corrections.
BALANCE_LIMIT, WIDTH_LIMIT, DELAY_SECONDS = 12.0, 4.0, 0.002


def stereo(train: DataFrame, rate: float) -> DataFrame:
    """(scope, kind, spans, estimate, q05, q95): medians of delay_samples, balance_db,
    width_ratio and correlation over spans (span, kind, ref, model), of either side and of
    the correction, within limits; and the polarity, the sign of the median correlation."""
    ref, model, kind = F.col("ref"), F.col("model"), F.col("kind")
    both = train.filter("ref is not null and model is not null")
    sign = lambda c: F.when(F.percentile(c, 0.5) < 0, -1.0).otherwise(1.0)
    signs = both.filter(kind == "correlation").agg(F.count(F.lit(1)).alias("spans"), sign("ref").alias("reference"), sign("model").alias("model_"))
    signs = signs.withColumn("enough", F.col("spans") >= LEAST_TRAIN).withColumn("polarity", F.when(F.col("enough"), F.col("reference") * F.col("model_")).otherwise(1.0))
    reach = float(int(DELAY_SECONDS * rate))
    # the quotient's smallest divisor is the smallest normal number
    ratio = E.clamp(F.when(model > 2.2250738585072014e-308, F.try_divide(ref, model)).otherwise(WIDTH_LIMIT), 1 / WIDTH_LIMIT, WIDTH_LIMIT)
    change = (
        F.when(kind == "width_ratio", ratio)
        .when(kind == "correlation", E.clamp(ref - F.col("polarity") * model, -1.0, 1.0))
        .when(kind == "delay_samples", E.clamp(ref - model, -reach, reach))
        .otherwise(E.clamp(ref - model, -BALANCE_LIMIT, BALANCE_LIMIT))
    )
    sides = [("reference", ref), ("model", model), ("correction", change)]
    long = both.crossJoin(F.broadcast(signs.select("polarity"))).select("kind", F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), v.alias("v")) for s, v in sides])).alias("s")).select("kind", "s.*")
    q = F.percentile("v", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    rows = long.groupBy("scope", "kind").agg(F.count(F.lit(1)).alias("spans"), q.alias("q")).filter(F.col("spans") >= LEAST_TRAIN)
    q = F.col("q")
    rows = rows.select("scope", "kind", "spans", tidy(q[1]).alias("estimate"), tidy(F.least(q[0], q[1])).alias("q05"), tidy(F.greatest(q[2], q[1])).alias("q95"))
    none = F.lit(None).cast("double")
    polar = [F.struct(F.lit(s).alias("scope"), F.col(c).alias("estimate")) for s, c in (("reference", "reference"), ("model", "model_"), ("correction", "polarity"))]
    signs = signs.filter("enough").select("spans", F.explode(F.array(*polar)).alias("p"))
    return rows.unionByName(signs.select("p.scope", F.lit("polarity").alias("kind"), "spans", "p.estimate", none.alias("q05"), none.alias("q95")))


def views(rows: DataFrame, gains: DataFrame) -> DataFrame:
    """Gap of each (split, view, node): as it is, with the gain taken off the reference,
    with it put on the model. A gap survives where the check split shows it in both the raw
    and the corrected view."""
    fitted = rows.join(gains, "node", "left")
    ref, model, gain = F.col("ref"), F.col("model"), F.col("gain_db")
    v = lambda name, r, m: F.struct(F.lit(name).alias("view"), r.alias("r"), m.alias("m"))
    long = fitted.select("split", "node", F.explode(F.array(v("RAW", ref, model), v("DRY_LIKE", ref - gain, model), v("ROOM_MATCHED", ref, model + gain))).alias("v")).select("split", "node", "v.*")
    delta = F.col("m") - F.col("r")
    stats = long.filter(delta.isNotNull()).groupBy("split", "view", "node").agg(F.count(F.lit(1)).alias("spans"), F.avg(delta).alias("d"), F.stddev_pop(delta).alias("sd"))
    enough = F.col("spans") >= LEAST_CHECK
    score = F.when(F.col("sd") > 0, saturate(F.abs("d") / F.col("sd"))).otherwise(F.when(F.col("d") == 0, 0.0).otherwise(1.0))
    stats = stats.select("split", "view", "node", "spans", tidy(F.when(enough, F.col("d"))).alias("delta_db"), tidy(F.when(enough, score)).alias("gap_score"))
    raw = F.max(F.when(F.col("view") == "RAW", F.col("gap_score"))).over(W.partitionBy("split", "node"))
    survives = (F.col("gap_score") >= SURVIVES) & (raw >= SURVIVES) & (F.col("split") == "check") & (F.col("view") != "RAW")
    return stats.withColumn("survives", F.coalesce(survives, F.lit(False)))
