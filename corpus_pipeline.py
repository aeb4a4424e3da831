"""The corpus pipeline: five stages over ``documents``, each written as Parquet
in the shared checkpoint folder and read again by the next.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last
return the columns that they got.  They drop what their operator rejects:
toxic documents, those that fail a quality rule, all but one document of each
group of near duplicates, and those with a passage of the benchmark.  The last
stage gives the SentencePiece ids of what is left and whether they decode to the
text.  An empty table passes through all stages; extra columns are
carried along; rows with null texts are empty documents, which the quality rules
reject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import dart_minhash, decontaminate, quality_rules, sp_transducer, toxicity
from trendloom.llm.common import read, stored

#: SQL cannot train the first stage's model; the tests hold each stage against
#: a plain version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(docs, model, F.col("text")) < toxicity.THRESHOLD)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return docs.where(quality_rules.keep_mask(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dart_minhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sp_transducer.encoded_and_checked(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
