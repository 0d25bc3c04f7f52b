"""The training-data queries that SQL can express, on whole tables."""

import os

import duckdb
import pytest

from gaugeworks.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_oracle(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DIR):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{file}'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    df = QUERIES[name](spark, DIR)
    assert sorted(columns) == sorted(df.columns)
    canon = lambda row: tuple(str(round(v, 6) + 0.0 if isinstance(v, float) else v) for v in row)
    assert sorted(canon([r[c] for c in columns]) for r in df.collect()) == sorted(map(canon, want.fetchall()))
