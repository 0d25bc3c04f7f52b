"""Distribution statistics and the gap scores that everything ranks by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeworks.functions.expr import clamp

#: The quantiles of a distribution, by linear interpolation.
QUANTILES = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}
#: Interquartile range of a unit normal; case value that counts as an occurrence.
NORMAL_IQR, OCCURS = 1.349, 1.0 / 12.0


#: Names of the statistics of a distribution.
STATISTICS = ("total_count", "valid_count", "missing_count", "minimum", *QUANTILES, "maximum", "mean", "population_sd", "confidence")


def correlation(a: str, b: str) -> Column:
    """Pearson's r over rows that have both; null where either is constant."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    # rounded, it only tells constants: as a divisor it would move the last digits of quiet series
    return F.covar_pop(x, y) / F.when(F.round(spread, 12) != 0, spread)


def saturate(x: Column) -> Column:
    return x / (1 + x)


def profile_gap(r: str = "r_", m: str = "m_") -> dict[str, Column]:
    """The gap of a model's statistics (prefix ``m``) from a reference's (``r``). Null
    where a side is missing or has no valid value."""
    c = lambda side, name: F.col(side + name)
    d = {name: c(m, name) - c(r, name) for name in ("mean", "q05", "q25", "q50", "q75", "q95")}
    quantile_distance = sum((F.abs(d[q]) for q in QUANTILES), F.lit(0.0)) / len(QUANTILES)
    n1, n2 = c(r, "valid_count"), c(m, "valid_count")
    pooled = F.sqrt((n1 * c(r, "population_sd") ** 2 + n2 * c(m, "population_sd") ** 2) / (n1 + n2))
    shift = d["mean"] / pooled
    exact = F.when(d["mean"] == 0, 0.0).otherwise(1.0)
    mean_part = F.when(pooled > 0, saturate(F.abs(shift))).otherwise(exact)
    spread = (c(r, "q75") - c(r, "q25") + c(m, "q75") - c(m, "q25")) / (2 * NORMAL_IQR)
    scale = F.greatest(pooled, spread)
    quantile_part = F.when(scale > 0, saturate(quantile_distance / scale)).otherwise(F.when(quantile_distance == 0, 0.0).otherwise(1.0))
    coverage = F.least(n1 / c(r, "total_count"), n2 / c(m, "total_count"))
    usable = (n1 > 0) & (n2 > 0)
    when = lambda x: F.when(usable, x)
    return {
        "mean_delta": when(d["mean"]),
        "median_delta": when(d["q50"]),
        "quantile_distance": when(quantile_distance),
        "standardized_mean_shift": when(F.when(pooled > 0, shift)),
        "valid_coverage": when(coverage),
        "gap_score": when(coverage * (mean_part + quantile_part) / 2),
    }


def candidate_score(size: Column, audibility: Column, occurrence: Column, confidence: Column) -> Column:
    return clamp(F.abs(size), 0.0, 1.0) * audibility * occurrence * confidence
