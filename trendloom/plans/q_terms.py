"""Registered term-statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.functions.text import clean_text, ngrams_range, tokenize
from trendloom.operators import terms
from trendloom.operators.target import partition_report, target_partition
from trendloom.plans import trending
from trendloom.plans.catalog import register
from trendloom.sources import derived
from trendloom.sources.tables import table

# fixed parameters of the registered queries (FIXTURES.md)
TARGET = "purchase"
THRESHOLD = 0.5


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def _baseline(spark, sf):
    conv = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), "text")
    return terms.baseline_from_texts(conv, "msg_id", "text")


@register("clean_text")
def q_clean_text(spark, sf):
    return _docs(spark, sf).select("doc_id", clean_text("text").alias("clean"))


@register("tokens")
def q_tokens(spark, sf):
    toks = tokenize(clean_text("text"))
    return _docs(spark, sf).select("doc_id", F.size(toks).cast("long").alias("n_tokens"),
                                   F.array_join(toks, " ").alias("tokens"))


@register("vocabulary")
def q_vocabulary(spark, sf):
    return terms.vocabulary(_docs(spark, sf))


@register("term_document_counts")
def q_term_document_counts(spark, sf):
    return terms.term_document_counts(_docs(spark, sf))


@register("term_counts")
def q_term_counts(spark, sf):
    return terms.term_counts(_docs(spark, sf))


@register("total_words")
def q_total_words(spark, sf):
    return terms.total_words(terms.term_counts(_docs(spark, sf)))


@register("term_frequency")
def q_term_frequency(spark, sf):
    return terms.term_frequency(_docs(spark, sf))


@register("frequent_terms")
def q_frequent_terms(spark, sf):
    return trending.frequent_job(_docs(spark, sf), derived.confidences(spark, sf), TARGET, THRESHOLD)


@register("target_partition")
def q_target_partition(spark, sf):
    return target_partition(_docs(spark, sf), derived.confidences(spark, sf), TARGET, THRESHOLD).select("doc_id")


@register("partition_report")
def q_partition_report(spark, sf):
    return partition_report(_docs(spark, sf).select("doc_id"), derived.confidences(spark, sf),
                            TARGET, THRESHOLD)


@register("baseline_terms")
def q_baseline_terms(spark, sf):
    return _baseline(spark, sf)


@register("relative_terms")
def q_relative_terms(spark, sf):
    """All terms of the whole corpus with their relative frequency (no
    target partition, no threshold, no limit)."""
    tf = terms.term_frequency(_docs(spark, sf))
    return terms.relative_frequency(tf, _baseline(spark, sf), None).select("term", "n", "rel")


@register("trending_terms")
def q_trending_terms(spark, sf):
    """Flagship (X5)."""
    return trending.trending_job(_docs(spark, sf), derived.confidences(spark, sf),
                                 _baseline(spark, sf), TARGET, THRESHOLD)


@register("ngrams")
def q_ngrams(spark, sf):
    toks = _docs(spark, sf).select("doc_id", tokenize(clean_text("text")).alias("_tok"))
    grams = ngrams_range("_tok", 1, 3)
    return toks.select("doc_id", F.size(grams).cast("long").alias("n_grams"),
                       F.array_join(grams, "|").alias("grams"))


@register("idf_grams")
def q_idf_grams(spark, sf):
    return (terms.idf_grams(_docs(spark, sf), counted=spark.read.parquet(f"{sf}/documents.parquet"))
            .select("term", "df", F.round("idf", 6).alias("idf")))


@register("tfidf_terms")
def q_tfidf_terms(spark, sf):
    return trending.tfidf_job(_docs(spark, sf), derived.confidences(spark, sf), TARGET, THRESHOLD)
