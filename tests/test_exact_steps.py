"""Steps whose last bits decide a result, against their SQL."""

import random
import shutil

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gaugeworks.operators import experiments
from gaugeworks.operators import kernels as K
from gaugeworks.plans import measures
from gaugeworks.plans.catalog import ORACLES, QUERIES


def differs(spark, folder, name, digits=5):
    """Rows that only one of the query and its SQL has; SQL adds in the table's order."""
    con = duckdb.connect()
    con.execute("SET threads=1")
    for path in folder.iterdir():
        con.execute(f"CREATE VIEW {path.name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    show = lambda row: tuple(round(v, digits) + 0.0 if isinstance(v, float) else str(v) for v in row)
    got = QUERIES[name](spark, str(folder))
    return set(map(show, want.fetchall())) ^ {show([r[c] for c in columns]) for r in got.collect()}


def events(folder, rows, files):
    """Rows (user, value), a second apart, in so many files."""
    (folder / "events.parquet").mkdir()
    each = -(-len(rows) // files)
    for part in range(files):
        ids = range(part * each, min(len(rows), (part + 1) * each))
        table = {
            "event_id": pa.array(ids, pa.int64()),
            "ts": pa.array([1704067200000000 + 1000000 * i for i in ids], pa.timestamp("us")),
            "user_id": pa.array([rows[i][0] for i in ids], pa.int64()),
            "event_type": [("view", "click", "purchase", "error")[i % 4] for i in ids],
            "value": [rows[i][1] for i in ids],
        }
        pq.write_table(pa.table(table), folder / "events.parquet" / f"{part}.parquet")
    return folder


@pytest.fixture(scope="module")
def halves(tmp_path_factory):
    """Users whose mean lies at half a thousandth, a value just 5 above it, in two files."""
    rng, rows = random.Random(7), []
    for user in range(60):
        cents = [rng.randrange(1, 10000) for _ in range(78)] + [5500]
        cents.append(400004 - sum(cents))
        rng.shuffle(cents)
        rows += [(k, user, c / 100) for k, c in enumerate(cents)]
    return events(tmp_path_factory.mktemp("halves"), [r[1:] for r in sorted(rows)], 2)


@pytest.fixture(scope="module")
def thousandths(tmp_path_factory):
    """Users whose samples are odd numbers of thousandths about a mean of 50, and 16 vectors."""
    rng, folder = random.Random(3), tmp_path_factory.mktemp("thousandths")
    apart = [k + 0.5 for k in range(40)]
    rows = [(user, 50 + sign * a) for user in range(5) for a in rng.sample(apart, 40) for sign in (1, -1)]
    rng.shuffle(rows)
    vectors = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(16)]
    table = {"vec_id": pa.array(range(16), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([k % 2 for k in range(16)], pa.int32())}
    pq.write_table(pa.table(table), folder / "embeddings.parquet")
    return events(folder, rows, 1)


@pytest.fixture(scope="module")
def quiet(tmp_path_factory, thousandths):
    """Users whose samples are hardly ever more than a hundredth, so that their spread is small."""
    rng, folder = random.Random(11), tmp_path_factory.mktemp("quiet")
    rows = [(user, 50 + rng.choice((0, 0, 0, 1, -1)) + rng.choice((0, 0.01))) for user in range(150) for _ in range(64)]
    rng.shuffle(rows)
    shutil.copy(thousandths / "embeddings.parquet", folder)
    return events(folder, rows, 1)


def test_slopes_about_means_at_a_half(spark, halves):
    assert not differs(spark, halves, "level_slopes")


def test_change_scan_of_values_at_a_half(spark, halves):
    assert not differs(spark, halves, "change_scan")


def test_main_effect_without_a_mean_has_no_points(spark):
    points = spark.createDataFrame([(1, None), (1, None), (2, None)], "size int, mean_gap double")
    assert [(r["points"], r["effect"]) for r in experiments.main_effect(points, "size").collect()] == [(None, None)]


def test_physical_checks_of_odd_thousandths(spark, thousandths):
    assert not differs(spark, thousandths, "physical_checks")


def test_physical_findings_of_odd_thousandths(spark, thousandths):
    assert not differs(spark, thousandths, "physical_findings")


def test_physical_findings_of_quiet_samples(spark, quiet):
    assert not differs(spark, quiet, "physical_findings", 6)


def test_lag_scores_of_quiet_samples(spark, quiet):
    assert not differs(spark, quiet, "delay_estimate", 6)


def test_a_vibrato_is_sought_only_up_to_its_first_window(spark, monkeypatch):
    seen, kernel = [], K.vibrato
    monkeypatch.setattr(K, "vibrato", lambda cents, step: seen.append(len(cents)) or kernel(cents, step))
    monkeypatch.setattr(K, "per_series", lambda rows, key, order, run, schema: run)
    run = measures.vibrato_measures(spark, "/root/testdata/sf0.001")
    t = np.arange(20)
    out = run(pd.DataFrame({"user_id": 1, "item": 1, "t": t * 0.04, "pitch": 440 * 2 ** (np.sin(2 * np.pi * t / 4 + 0.5) / 24), "target": 440.0}))
    assert seen == [20, 10, 10, 8] and out["value"].iloc[0] == 0.0
