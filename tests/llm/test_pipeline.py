"""Queries against their check SQL, and the pipeline stage by stage."""

import check
import pytest

import corpus_pipeline
from sourceweave.llm import decontaminate, minhash, queries
from sourceweave.session import staged

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    assert check.compare(queries.QUERIES[name](spark, SF), check.connect(SF), queries.SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_other_queries_give_their_rows(spark, name):
    table = "pages" if name.startswith("op7") else "documents"
    rows, n = queries.QUERIES[name](spark, SF).count(), spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert rows >= n if name.startswith("op3") else rows > 0 if name.startswith("op5") else rows == n


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, SF), "stage")
        seen[name] = (docs, out)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = out
    before, after = seen["line dedup"]
    assert before.count() == after.count()
    before, after = seen["MinHash near-dedup"]
    assert after.count() == minhash.near_groups(before, minhash.Rule()).select("component_id").distinct().count()
    before, after = seen["benchmark decontamination"]
    leaked = {r.doc_id for r in decontaminate.leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - leaked
    assert docs.where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_stages_take_odd_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "a", 0, "x"), (None, "some words " * 30, "en", "a", 1, "x"), (3, "w " * 5000, "en", "a", 1, "x")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() <= len(data)
