"""Trend-term jobs (X5-X7) over collected texts.

Flagship shape, one Spark job graph, no collect:

    confidences --label = target, confidence > t--> image ids --left semi--+
    texts ---------------------------------------------------------------+-> clean/tokenize
      -> explode -> stop words (InSet) -> partial/final count by term
      -> scalar subquery total -> tf -> n > 10 -> join baseline on term
      -> rel = tf / baseline -> TakeOrderedAndProject(400)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.functions.stopwords import ENGLISH_STOP_WORDS
from trendloom.operators import terms
from trendloom.operators.target import target_partition

DEFAULT_TARGET = "aeroplane"


def trending_job(texts: DataFrame, confidences: DataFrame, baseline: DataFrame,
                 target: str = DEFAULT_TARGET, threshold: float = 0.5, n: int | None = 400,
                 min_count: int | None = 10, key: str = "doc_id", text_col: str = "text",
                 stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """Relative-frequency trend terms of the target partition."""
    part = target_partition(texts.select(key, text_col), confidences, target, threshold, key)
    out = terms.trending_terms(part, baseline, n, min_count, key, text_col, stop_words)
    return out.select("rank", "term", "n", "rel")


def frequent_job(texts: DataFrame, confidences: DataFrame, target: str = DEFAULT_TARGET,
                 threshold: float = 0.5, n: int = 40, key: str = "doc_id",
                 text_col: str = "text", stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    part = target_partition(texts.select(key, text_col), confidences, target, threshold, key)
    return terms.frequent_terms(part, n, key, text_col, stop_words).select("rank", "term", "n", "tf")


def tfidf_job(texts: DataFrame, confidences: DataFrame, target: str = DEFAULT_TARGET,
              threshold: float = 0.5, n: int = 400, key: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    part = target_partition(texts.select(key, text_col), confidences, target, threshold, key)
    return (terms.tfidf_terms(part, n, 3, key, text_col)
            .select("rank", "term", "df", F.round("idf", 6).alias("idf")))
