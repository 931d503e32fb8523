"""Registered queries of the training-data operators: each runs one operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelode.llm import contamination, context_tree, jaccard, language, merkle, packing, pages, private, runs, suffixes, tokens, topk, toxicity
from tracelode.llm.frames import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned outside the held-out fold."""
    docs = load(spark, folder, "documents", "doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, load(spark, folder, "labels", "doc_id", "toxic")))


@query
def op2_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without repeated strings."""
    return suffixes.remove_repeats(load(spark, folder, "documents", "doc_id", "text"))


@query
def op3_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items in every document."""
    return contamination.find_contaminated(load(spark, folder, "documents", "doc_id", "text"), load(spark, folder, "benchmark", "item_id", "text"))


@query
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document."""
    return tokens.count_tokens(load(spark, folder, "documents", "doc_id", "text"))


@query
def op5_html_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return pages.extract(load(spark, folder, "pages", "page_id", "url", "html"))


@query
def op6_private_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    return private.find_private(load(spark, folder, "documents", "doc_id", "text"))


@query
def op7_ball_tree_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    return topk.top_k(load(spark, folder, "embeddings", "vec_id", "embedding"))


@query
def op8_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under shingle similarity."""
    return jaccard.jaccard_components(load(spark, folder, "documents", "doc_id", "text"))


@query
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned outside the held-out fold."""
    docs = load(spark, folder, "documents", "doc_id", "text", "lang")
    return language.predict(docs, language.fit(docs))


@query
def op10_harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of the packed training sequences."""
    return packing.pack(load(spark, folder, "documents", "doc_id", "text"))


@query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of repeated words in every document."""
    return runs.find_runs(load(spark, folder, "documents", "doc_id", "text"))


@query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Proof of every document in the manifest of the table."""
    return merkle.proofs(load(spark, folder, "documents", *merkle.FIELDS))


ORACLES["op13_merkle_manifest"] = merkle.sql()


@query
def op12_suffix_tree_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Language model score of every document, learned outside the held-out fold."""
    return context_tree.score_documents(load(spark, folder, "documents", "doc_id", "text"))
