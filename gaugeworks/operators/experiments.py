"""Experiment plans, and what responses tell about parameters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions.expr import tidy
from gaugeworks.functions.stats import correlation

#: Fixed value: a change of means up to this is flat.
FLAT = 1e-6
#: Fixed values of the splitmix64 generator.
GAMMA, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def grid_plan(spark: SparkSession, levels: dict[str, list[float]], baseline: dict[str, float]) -> DataFrame:
    """(point, one column a parameter): every combination; the baseline is point 1, the
    others follow in the order of the levels, the last parameter fastest."""
    df = spark.range(1).select(F.lit(0).alias("_"))
    order = []
    for name, values in levels.items():
        choice = F.posexplode(F.array(*[F.lit(float(v)) for v in values])).alias(f"_{name}", name)
        df = df.select("*", choice)
        order.append(f"_{name}")
    home = [F.col(n) == F.lit(float(v)) for n, v in baseline.items()]
    away = ~home[0] if len(home) == 1 else ~_all(home)
    return df.withColumn("point", F.row_number().over(W.orderBy(away, *order)).cast("long")).select("point", *levels)


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def one_at_a_time_plan(spark: SparkSession, levels: dict[str, list[float]], baseline: dict[str, float]) -> DataFrame:
    """The baseline as point 1, then each other level of each parameter by itself."""
    rows = [(1, *[float(baseline[n]) for n in levels])]
    for name, values in levels.items():
        for v in values:
            if v != baseline[name]:
                rows.append((len(rows) + 1, *[float(v if n == name else baseline[n]) for n in levels]))
    return spark.createDataFrame(rows, "point long, " + ", ".join(f"{n} double" for n in levels))


def splitmix_units(seed: int, draws: np.ndarray) -> np.ndarray:
    """The generator's draws, numbered from 1, as 53-bit fractions: the state after n draws
    is the seed and n gammas, so each is computed by itself."""
    u = np.uint64
    with np.errstate(over="ignore"):
        z = u(seed & (2**64 - 1)) + draws.astype(np.uint64) * u(GAMMA)
        z = (z ^ (z >> u(30))) * u(MIX_A)
        z = (z ^ (z >> u(27))) * u(MIX_B)
        z = z ^ (z >> u(31))
    return (z >> u(11)).astype(np.float64) * 2.0**-53


def random_plan(spark: SparkSession, ranges: dict[str, tuple[float, float]], baseline: dict[str, float], seed: int, count: int) -> DataFrame:
    """The baseline as point 1, then ``count`` points uniform in the ranges."""
    names, low = list(ranges), np.array([r[0] for r in ranges.values()])
    width = np.array([r[1] - r[0] for r in ranges.values()])
    home = [float(baseline[n]) for n in names]

    def draw(batches):
        for batch in batches:
            point = batch.column(0).to_numpy() + 1
            n = (point - 2)[:, None] * len(names) + np.arange(1, len(names) + 1)
            values = low + width * splitmix_units(seed, np.maximum(n, 1))
            values[point == 1] = home
            yield pa.RecordBatch.from_arrays([pa.array(point), *[pa.array(c) for c in values.T.copy()]], names=["point", *names])

    return spark.range(count + 1).mapInArrow(draw, "point long, " + ", ".join(f"{n} double" for n in names))


def _cells(obs: DataFrame, point: list[str], response: str, replicates: int | None) -> DataFrame:
    """(point, case, cell, weight, replicates): a cell that misses a replicate has no mean."""
    n, whole = F.count(response), F.count(F.lit(1))
    complete = (n == whole) if replicates is None else (n == whole) & (n == replicates)
    return obs.groupBy(*point, "case").agg(F.when(complete, F.avg(response)).alias("cell"), F.max("weight").alias("weight"), n.alias("replicates"))


def _with_cases(cells: DataFrame) -> DataFrame:
    """``of``, the number of cases that any point has, on each cell."""
    return cells.crossJoin(F.broadcast(cells.agg(F.count_distinct("case").alias("of"))))


def candidates(obs: DataFrame, point: list[str], response: str = "y", replicates: int | None = None) -> DataFrame:
    """Per point: the weighted mean over cases of the mean over replicates. ``obs`` has
    case, weight and the response; a point that misses a case, or a replicate of one
    (a null response, or another number than ``replicates``), has no mean."""
    mean = F.sum(F.col("weight") * F.col("cell")) / F.sum("weight")
    return _with_cases(_cells(obs, point, response, replicates)).groupBy(*point).agg(
        F.sum("replicates").cast("long").alias("replicates"), F.when((F.count("cell") == F.max("of")) & (F.sum("weight") > 0), mean).alias("mean_gap")
    )


def harm(obs: DataFrame, point: list[str], at_baseline: Column, response: str = "y", replicates: int | None = None) -> DataFrame:
    """Per point the largest rise of a case's mean over the baseline's; none where a case
    misses at the point or at the baseline."""
    cells = _with_cases(_cells(obs, point, response, replicates))
    base = cells.filter(at_baseline).select("case", F.col("cell").alias("home"))
    rise = F.col("cell") - F.col("home")
    return cells.join(base, "case", "left").groupBy(*point).agg(tidy(F.when(F.count(rise) == F.max("of"), F.max(rise))).alias("worst_harm"))


def sensitivity(points: DataFrame, parameters: list[str], scale: dict[str, float] | None = None) -> DataFrame:
    """(parameter, points, slope, pearson, r_squared) of mean_gap over each parameter; null
    where either does not vary."""
    scale = scale or {}
    long = points.unpivot(["mean_gap"], [(F.col(p).cast("double") / float(scale.get(p, 1.0))).alias(p) for p in parameters], "parameter", "x")
    r = correlation("x", "mean_gap")
    varies = (F.stddev_pop("x") > 1e-12) & (F.stddev_pop("mean_gap") > 1e-12)
    when = lambda v: tidy(F.when(varies, v))
    return long.groupBy("parameter").agg(
        F.count("mean_gap").alias("points"), when(F.regr_slope("mean_gap", "x")).alias("slope"), when(r).alias("pearson"), when(r * r).alias("r_squared")
    )


def monotonicity(points: DataFrame, parameter: str) -> DataFrame:
    """The direction of the means over rising levels."""
    means = points.groupBy(parameter).agg(F.avg("mean_gap").alias("m"))
    step = means.withColumn("step", F.round(F.col("m") - F.lag("m").over(W.orderBy(parameter)), 9))
    up, down = F.bool_or(F.col("step") > FLAT), F.bool_or(F.col("step") < -FLAT)
    up, down = F.coalesce(up, F.lit(False)), F.coalesce(down, F.lit(False))
    kind = F.when(F.count(F.lit(1)) == 0, "NONE").when(~up & ~down, "FLAT").when(up & ~down, "INCREASING").when(down & ~up, "DECREASING").otherwise("MIXED")
    return step.agg(kind.alias("monotonicity"), F.count(F.lit(1)).alias("levels")).select(F.lit(parameter).alias("parameter"), "levels", "monotonicity")


def main_effect(points: DataFrame, parameter: str) -> DataFrame:
    """Share of the variance of mean_gap that lies between the parameter's levels; no points
    and no share where no point has a mean."""
    level = points.groupBy(parameter).agg(F.sum("mean_gap").alias("s"), F.sum(F.col("mean_gap") * F.col("mean_gap")).alias("ss"), F.count("mean_gap").alias("n"))
    row = level.agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    total = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    between = F.col("b") - F.col("s") * F.col("s") / F.col("n")
    return row.select(F.lit(parameter).alias("parameter"), F.when(F.col("n") > 0, F.col("n")).alias("points"), tidy(F.when(total > 1e-12, between / total)).alias("effect"))


def interaction(points: DataFrame, left: str, right: str) -> DataFrame:
    """Share of the variance that neither parameter's level means explain by themselves."""
    y, n = F.avg("mean_gap"), F.count("mean_gap")
    cell = points.groupBy(left, right).agg(y.alias("c"), n.alias("n"), F.var_pop("mean_gap").alias("v"))
    a = points.groupBy(left).agg(y.alias("a"))
    b = points.groupBy(right).agg(y.alias("b"))
    grand = points.agg(y.alias("g"), F.var_pop("mean_gap").alias("total"), n.alias("points"))
    rows = cell.join(a, left).join(b, right).crossJoin(F.broadcast(grand))
    apart = F.col("c") - F.col("a") - F.col("b") + F.col("g")
    return rows.agg(F.max("points").alias("points"), tidy(F.when(F.max("total") > 1e-12, F.sum(F.col("n") * apart * apart) / F.max("points") / F.max("total"))).alias("effect")).select(
        F.lit(left).alias("left"), F.lit(right).alias("right"), "points", "effect"
    )


def replicate_noise(obs: DataFrame, cell: list[str], response: str = "y") -> DataFrame:
    """Root mean square of replicates about their cell's mean, over cells with two or more."""
    cells = obs.groupBy(*cell).agg(F.count(response).alias("n"), F.var_pop(response).alias("v")).filter("n >= 2")
    return cells.agg(F.sum("n").cast("long").alias("replicates"), tidy(F.sqrt(F.sum(F.col("n") * F.col("v")) / F.sum("n"))).alias("noise"))
