"""Every query against its DuckDB oracle, and properties of the scores."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gaugeworks.operators import experiments, fits, measures, physical
from gaugeworks.operators import profiles as P
from gaugeworks.plans.catalog import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


def canon(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, list | tuple):
        return tuple(canon(x) for x in v)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_oracle(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    rows = sorted(tuple(canon(r[c]) for c in columns) for r in df.collect())
    assert rows == sorted(tuple(map(canon, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_kernel_queries_run(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_entry_and_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_comparing_a_set_with_itself_has_no_gap(spark):
    obs = spark.range(40).selectExpr("id % 3 AS g", "'k' AS kind", "CAST(id * id % 17 AS DOUBLE) AS value", "1.0D AS confidence")
    stats = P.distributions(obs, ["g", "kind"])
    rows = P.rank_gaps(P.gaps(stats, stats, ["g", "kind"]), ["g", "kind"]).collect()
    assert {r["gap_score"] for r in rows} == {0.0}
    assert sorted(r["rank"] for r in rows) == [1, 2, 3]


def test_unmatched_groups_are_kept_without_rank(spark):
    obs = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None)], "g string, value double").selectExpr("*", "1.0D AS confidence")
    stats = P.distributions(obs, ["g"])
    rows = {r["g"]: r for r in P.rank_gaps(P.gaps(stats.filter("g = 'a'"), stats, ["g"]), ["g"]).collect()}
    assert rows["a"]["rank"] == 1 and rows["b"]["rank"] == 0 and rows["b"]["gap_score"] is None


def test_counts_add_up(spark):
    for r in QUERIES["profile_statistics"](spark, DIR).collect():
        assert r["total_count"] == r["valid_count"] + r["missing_count"]


def test_element_and_shift_checks_in_closed_form(spark):
    far = spark.createDataFrame([("a", "b", 1.0, 3.0), ("a", "c", 1.0, None)], "left_element string, right_element string, reference_distance double, model_distance double")
    level = spark.createDataFrame([(s, e, d) for s, e, d in (("reference", "a", -20.0), ("reference", "b", -17.0), ("model", "a", -30.0), ("model", "b", -10.0))], "side string, element string, db double")
    carry = spark.createDataFrame([("reference", 1.0), ("reference", 4.0), ("reference", 90.0), ("model", -2.0)], "side string, db double")
    rows = {(r["case"], r["kind"]): (r["reference_value"], r["model_value"], r["delta"]) for r in physical.element_checks(far, level, carry).collect()}
    assert rows == {("a|b", "element_distinctness_ratio"): (1.0, 3.0, 2.0), ("a|b", "element_gain_only_score"): (0.25, 0.25, 0.0), ("", "element_carryover_db"): (4.0, -2.0, -6.0)}
    lone = physical.element_checks(far.filter("false"), level, carry.filter("side = 'model'")).collect()
    assert [(r["kind"], r["delta"], r["availability"]) for r in lone] == [("element_carryover_db", None, "UNAVAILABLE")]
    lags = spark.createDataFrame([("p", -3), ("q", None)], "case string, lag long")
    peaks = spark.createDataFrame([("reference", "p", 200.0), ("model", "p", 400.0), ("reference", "q", 0.0), ("model", "q", 100.0)], "side string, case string, hz double")
    rows = {(r["case"], r["kind"]): r["delta"] for r in physical.shift_checks(lags, peaks).collect()}
    assert rows == {("p", "render_lag_samples"): -3.0, ("q", "render_lag_samples"): None, ("p", "render_pitch_delta_cents"): 1200.0, ("q", "render_pitch_delta_cents"): None}


def test_dynamics_interval_and_stereo_in_closed_form(spark):
    squeezed = lambda x: x if x <= -30 else -30 + (x + 30) / 4
    points = spark.createDataFrame([(k, squeezed(-60.0 + 3 * k) + 5, -60.0 + 3 * k) for k in range(20)], "span long, ref double, model double")
    rows = {r["fit"]: (r["estimate"], r["q05"], r["q95"]) for r in fits.dynamics_interval(points).collect()}
    assert rows == {"threshold": (-30.0,) * 3, "ratio": (4.0,) * 3, "makeup_db": (5.0,) * 3}
    assert fits.dynamics_interval(points.filter("span < 7")).count() == 0
    spans = [(k, kind, r, m) for k in range(9) for kind, r, m in (("delay_samples", 500.0, 1.0), ("balance_db", 1.0, 3.0), ("width_ratio", 1.0, 0.0), ("correlation", 0.5, -0.25))]
    spans = spark.createDataFrame(spans, "span long, kind string, ref double, model double")
    rows = {(r["scope"], r["kind"]): r["estimate"] for r in fits.stereo(spans, 48000.0).collect()}
    assert {k: v for k, v in rows.items() if k[0] == "correction"} == {("correction", k): v for k, v in (("delay_samples", 96.0), ("balance_db", -2.0), ("width_ratio", 4.0), ("correlation", 0.25), ("polarity", -1.0))}
    assert rows["model", "polarity"] == -1.0 and rows["reference", "polarity"] == 1.0 and len(rows) == 15
    assert fits.stereo(spans.filter("span < 7"), 48000.0).count() == 0


def test_measures_where_every_divisor_is_zero(spark):
    """A silent item of one frame without a pitch: rows with a status, never an error."""
    frame = (1, 0.0, 0.0, 0.0, -300.0, 0.0, 0.0, 0.0, None, 440.0, False, -300.0, -300.0, 0.0, 5, 5, 48000.0)
    names = "item long, t double, x2 double, top double, level double, centroid double, flatness double, flux double, pitch double, target double, fault boolean, harmonic double, residual double, source_start double, start_sample long, end_sample long, rate double"
    frames = spark.createDataFrame([frame], names)
    bands = frames.selectExpr("item", "t", "0L AS band", "level", "residual")
    partials = frames.selectExpr("item", "t", "1L AS partial", "CAST(NULL AS DOUBLE) AS cents", "CAST(NULL AS DOUBLE) AS level", "0.0D AS power")
    rows = {(r["kind"], r["view"]): (r["value"], r["status"]) for r in measures.measure(frames, bands, partials, frames.select("item", "x2").filter("false")).collect()}
    assert rows["rms_dbfs", "ABSOLUTE"] == (None, "BELOW_FLOOR") and rows["partial_presence_fraction", "ABSOLUTE"][0] is None
    assert rows["duration_seconds", "ABSOLUTE"] == (0.0, "VALID") and rows["pre_note_residual_dbfs", "ABSOLUTE"] == (None, "NO_DATA")
    assert {k for k, (v, s) in rows.items() if s == "VALID"} == {("duration_seconds", "ABSOLUTE"), ("attack_delay_seconds", "ABSOLUTE")}


def test_findings_scores_by_kind(spark):
    checks = [
        ("a", "dc_offset", 0.0, -0.005, 0.005, "FAULT", "WARNING", 0.5),
        ("b", "max_step_dbfs", -30.0, -6.0, 24.0, "FAULT", "WARNING", 0.5),
        ("c", "body_mode_frequency_hz", 100.0, 101.3, 1.3, "GAP", "INFO", 0.22361),
        ("d", "body_mode_frequency_hz", 100.0, 101.0, 1.0, None, None, None),
        ("e", "element_distinctness_ratio", 0.1, 0.3, 0.2, "GAP", "CRITICAL", 0.8),
        ("f", "render_lag_samples", 0.0, 40.0, 40.0, "GAP", "CRITICAL", 1.0),
        ("g", "high_band_ratio", 0.0, 1.0, 1.0, None, None, None),
        ("h", "clip_fraction", 0.0, 0.0001, 0.0001, None, None, None),
    ]
    rows = spark.createDataFrame([("s", c, k, r, m, d, "AVAILABLE") for c, k, r, m, d, *_ in checks], "scope string, case string, kind string, reference_value double, model_value double, delta double, availability string")
    got = {r["case"]: (r["class"], r["severity"], round(r["score"], 5)) for r in physical.findings(rows).collect()}
    assert got == {c: (cl, sev, score) for c, *_, cl, sev, score in checks if cl}


def test_points_that_miss_a_case_or_replicate_have_no_mean(spark):
    rows = [(1, "a", 1.0, 2.0), (1, "b", 3.0, 6.0), (2, "a", 1.0, 4.0), (3, "a", 1.0, 4.0), (3, "b", 3.0, None), (3, "b", 3.0, 1.0)]
    obs = spark.createDataFrame(rows, "p int, case string, weight double, y double")
    assert {r["p"]: r["mean_gap"] for r in experiments.candidates(obs, ["p"]).collect()} == {1: 5.0, 2: None, 3: None}
    assert {r["p"]: r["mean_gap"] for r in experiments.candidates(obs, ["p"], replicates=2).collect()} == {1: None, 2: None, 3: None}
    harm = {r["p"]: r["worst_harm"] for r in experiments.harm(obs, ["p"], F.col("p") == 1).collect()}
    assert harm == {1: 0.0, 2: None, 3: None}
