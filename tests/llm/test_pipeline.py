"""The pipeline's stages on a small table that holds what each must act on."""

from collections import Counter

import pytest

import corpus_pipeline as pipeline
from gaugeworks.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    near = docs.limit(5).selectExpr("doc_id + 100000 AS doc_id", "concat(text, ' and some more') AS text", "lang", "source", "n_chars")
    docs = docs.union(docs.limit(3)).union(near).union(spark.createDataFrame([(None, None, None, None, None), (99999, "12 34", "en", "src0", 5)], docs.schema))
    out = [docs]
    for _, stage in pipeline.STAGES:
        out.append(pipeline.settle(stage(spark, out[-1], DIR)))
    return out


def test_stages_shrink_mix_and_pack(stages):
    docs, spoken, unique, apart, mixed, packed = stages
    assert all(s.columns == docs.columns for s in stages[:-1])
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(spoken) == ids(docs.filter("doc_id is not null and doc_id <> 99999"))
    texts = [r["text"] for r in unique.collect()]
    assert len({" ".join(t.split()) for t in texts}) == len(texts) and max(ids(unique).values()) == 1
    assert not any(i >= 100000 for i, t in ((r["doc_id"], r["text"]) for r in apart.collect()) if len(t) > 400)
    assert apart.exceptAll(unique).count() == 0 and unique.count() > apart.count() > 100
    assert max(ids(mixed).values()) <= 2 and set(ids(mixed)) <= set(ids(apart))
    rows = packed.toPandas()
    assert rows.groupby("sequence_id").length.sum().max() <= 1024
    assert Counter(rows[rows.start == 0].doc_id) == ids(mixed)


def test_run_is_registered_and_repeats(spark):
    a, b = (sorted(map(tuple, pipeline.run(spark, DIR).collect())) for _ in range(2))
    assert a == b and len(a) > 100
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
