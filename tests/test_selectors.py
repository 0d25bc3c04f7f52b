"""Selector groups: parts by all labels together, put together for each group."""

import math

import numpy as np

from gaugeworks.operators import profiles as P

ROWS = [("x", "p", 1e6, 1.0), ("x", "q", 1e6 + 1, 0.5), ("y", "p", 1e6 + 3, 1.0), (None, "p", 1e6 + 7, 0.25), ("y", None, None, 1.0), ("y", "p", None, 0.5), ("z", "", None, 1.0)]


def observations(spark):
    return spark.createDataFrame([("k", *r) for r in ROWS], "kind string, a string, b string, value double, confidence double")


def test_statistics_of_selectors_against_numpy(spark):
    got = {(r["selector"], r["group_value"]): r for r in P.selector_distributions(observations(spark), ["kind"], ["a", "b"]).collect()}
    groups = {("ALL", ""): ROWS} | {(c, g): [r for r in ROWS if r[i] == g] for i, c in enumerate("ab") for g in {r[i] for r in ROWS} - {None, ""}}
    assert set(got) == set(groups)
    for key, rows in groups.items():
        r, v = got[key], np.array([x[2] for x in rows if x[2] is not None])
        assert (r["total_count"], r["valid_count"], r["missing_count"]) == (len(rows), len(v), len(rows) - len(v))
        assert math.isclose(r["confidence"], sum(x[3] for x in rows if x[2] is not None) / len(rows))
        want = [v.min(), v.max(), v.mean(), v.std(), *np.quantile(v, [0.05, 0.25, 0.5, 0.75, 0.95])] if len(v) else [None] * 9
        have = [r[c] for c in ("minimum", "maximum", "mean", "population_sd", "q05", "q25", "q50", "q75", "q95")]
        assert have == want if not len(v) else np.allclose(have, want, rtol=1e-12, atol=1e-9)


def test_only_parts_are_dealt_to_selectors(spark):
    stats = P.selector_distributions(observations(spark), ["kind"], ["a", "b"])
    plan = [line.lstrip(" :+-") for line in stats._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    dealt = [k for k, line in enumerate(plan) if line.startswith("Expand") and "spark_grouping_id" in line]
    below = [next(line.split()[0] for line in plan[k + 1 :] if not line.startswith(("Project", "Filter"))) for k in dealt]
    assert dealt and set(below) == {"Aggregate"}
