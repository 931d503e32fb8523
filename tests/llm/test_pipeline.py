"""The pipeline and the catalogue of the training-data queries."""

import corpus_pipeline
from llm.cases import rows, table
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracelode.llm import jaccard
from tracelode.llm.queries import QUERIES
from tracelode.session import materialize

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    names = entry.queries()
    assert {name.split("_")[0] for name in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(QUERIES) <= set(names) and "pipeline" in names


def test_stages_pass_on_whole_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, before, FOLDER))
        assert after.columns == docs.columns, name
        assert after.join(before, "doc_id", "left_anti").count() == 0 and after.count() <= before.count()
        if name == "near copies":
            found = jaccard.jaccard_components(before)
            assert after.count() == found.select("component_id").distinct().count()
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, FOLDER)
    assert {r["doc_id"] for r in last.select("doc_id").distinct().collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}


def test_stages_take_odd_and_empty_tables(spark):
    for data in (rows(), []):
        docs = table(spark, data)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = materialize(stage(spark, docs, FOLDER))
            assert out.columns == docs.columns
            docs = out
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() > 0) == bool(data)


def test_columns_of_any_name_are_kept(spark):
    """Names that the stages use inside, or used before."""
    clashes = ["_items", "items", "_class", "_doc", "_cls", "stays", "own_cls", "stays_doc", "stays_cls", "_text", "_extra", "_hash", "span_doc", "span_hash", "own_hash", "learned"]
    docs = table(spark)
    wide = docs.select("*", *(F.lit(k).alias(name) for k, name in enumerate(clashes)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, wide, FOLDER))
        assert out.columns == wide.columns, name
        plain = stage(spark, docs, FOLDER)
        assert sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, plain.select("doc_id", "text").collect())), name
        assert all(row[len(docs.columns) :] == tuple(range(len(clashes))) for row in out.collect()), name
