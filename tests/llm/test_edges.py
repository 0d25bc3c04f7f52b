"""Every operator and stage on clashing columns, nulls, null ids in bulk, ties and empty tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugeworks.llm import embedding_join, exact_dedup, html_text, language, licenses, mixing, near_dedup, packing, pseudonyms, url_filter

#: Names that operators use inside or that results have.
CLASHES = (
    "_key _KEY2 key row salt bucket low me none n _n at _at _of _size words start first second again bands sketch root recipe norm chunk draw place id "
    "_host _path _keep _id _text _salt a.b `q` kept size seq c0 grp data weight length rank position lang2"
).split()
WORDS = "the of and to in is was for on are with as at be this have from".split()
TEXT = " ".join(WORDS * 4)
DOCS = [(1, TEXT, "en", "a"), (2, TEXT, "en", "a"), (2, TEXT, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, "der die und das ist " * 9, "de", "b"), (None, None, None, None)]
DOCS += [(None, TEXT + " end", "en", "a")] * 60 + [(7, f"text {k} of one id in bulk " + TEXT, "de", "b") for k in range(40)]


def documents(spark, rows=DOCS, clashes=True):
    df = spark.createDataFrame([(i, t, l, s, 0) for i, t, l, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)]) if clashes else df


PASSING = {
    "identify": lambda df: language.identify(df, language.train_model(df)),
    "identify_kept": lambda df: language.identify(df, language.train_model(df), keep_only=True),
    "mask": lambda df: pseudonyms.mask_personal_data(df, "key"),
    "keep_first": exact_dedup.keep_first,
    "keep_near_first": near_dedup.keep_near_first,
    "mixed_documents": mixing.mixed_documents,
}
DIGESTS = {
    "exact_dedup": exact_dedup.exact_dedup,
    "near_dedup": near_dedup.near_dedup,
    "mix": mixing.mix,
    "pack": packing.pack,
    "scan_licenses": licenses.scan_licenses,
}
STAGES = {f"stage_{name}": lambda df, stage=stage: stage(df.sparkSession, df, "") for name, stage in corpus_pipeline.STAGES}


def bag(df, names):
    at = [df.columns.index(c) for c in names]
    return Counter(repr([r[k] for k in at]) for r in df.collect())


@pytest.mark.parametrize("name", [*PASSING, *(n for n in STAGES if n != "stage_best_fit_packing")])
def test_rows_pass_with_all_their_columns(spark, name):
    run = {**PASSING, **STAGES}[name]
    wide, narrow = documents(spark), documents(spark, clashes=False)
    out = run(wide)
    assert [c for c in wide.columns if c not in out.columns] == []
    plain = run(narrow)
    assert bag(out, plain.columns) == bag(plain, plain.columns)
    assert bag(out, CLASHES).keys() <= {repr(list(range(len(CLASHES))))}


@pytest.mark.parametrize("name", [*DIGESTS, "stage_best_fit_packing"])
def test_digests_ignore_other_columns(spark, name):
    run = {**DIGESTS, **STAGES}[name]
    # which copy of a repeated id a row number stands for may differ, so it is left out
    names = {"mix": ["size", "source_size", "target"], "pack": ["doc_id", "piece", "start", "length", "ids_crc32"]}
    one, two = run(documents(spark)), run(documents(spark, clashes=False))
    cols = names.get("pack" if name == "stage_best_fit_packing" else name, two.columns)
    assert one.columns == two.columns and bag(one, cols) == bag(two, cols)
    assert one.count() >= len(DOCS)


@pytest.mark.parametrize("name", [*PASSING, *DIGESTS, *STAGES])
def test_empty_tables(spark, name):
    df = documents(spark).filter("false")
    out = {**PASSING, **DIGESTS, **STAGES}[name](df)
    assert out.count() == 0 and out.columns


def test_one_of_each_group_stays(spark):
    for keep in (exact_dedup.keep_first, near_dedup.keep_near_first):
        texts = Counter(r["text"] for r in keep(documents(spark)).select("text").collect())
        assert texts[TEXT] == 1 and (texts[TEXT + " end"] == 1 or keep is near_dedup.keep_near_first)
    rows = exact_dedup.exact_dedup(documents(spark)).collect()
    assert sum(r["kept"] for r in rows if r["doc_id"] is None) == 1
    assert next(r for r in rows if r["doc_id"] is None and r["group_size"] == 60)["keep_id"] is None


def test_pages_and_vectors(spark):
    extra = [F.lit(k).alias(c) for k, c in enumerate([*CLASHES, "host", "verdict", "fp"])]
    pages = spark.createDataFrame([(None, None, None), (1, "http://x.com/de/", "<p>"), (1, "http://x.com/de/", "<p>"), (None, "", "")], "page_id long, url string, html string")
    judged = url_filter.judge_urls(pages.select("*", *extra))
    assert bag(judged, ["page_id", "host", "path", "rule", "verdict"]) == bag(url_filter.judge_urls(pages), ["page_id", "host", "path", "rule", "verdict"])
    assert html_text.extract_text(pages.select("*", *extra)).count() == 4
    vectors = spark.createDataFrame([(None, None, None), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (3, [0.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    for df in (vectors, vectors.select("*", *extra)):
        got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_join.near_vectors(df).collect())
        assert got == {(None, 0, None): 1, (1, 2, 1): 2, (None, 2, 1): 1, (3, 0, 3): 1}
    for run, df in ((url_filter.judge_urls, pages), (html_text.extract_text, pages), (embedding_join.near_vectors, vectors)):
        assert run(df.filter("false")).count() == 0
