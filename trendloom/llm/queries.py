"""Registered queries of this package and their DuckDB SQL, where SQL can
express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trendloom.llm import (
    collocations, context_mixing, conversation_repair, dart_minhash, decontaminate, elias_fano, factorization, license_scan, packing,
    quality_rules, sp_transducer, token_counts, toxicity,
)
from trendloom.llm.common import read
from trendloom.session import scratch_path


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), scratch_path(spark, "token-cache"))


def op4_factorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorization.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.classes(read(spark, sf_dir, "documents"))


def op6_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    elias_fano.write_ids(read(spark, sf_dir, "documents"), path)
    return elias_fano.read_documents(spark, path)


def op7_sp_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_transducer.round_trip(read(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.audits(conversation_repair.damaged(read(spark, sf_dir, "conversations")))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_rows(packing.pack(read(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_context_mixing, op3_token_counts, op4_factorization, op5_dart_minhash, op6_elias_fano,
    op7_sp_transducer, op8_license_scan, op9_decontaminate, op10_toxicity, op11_collocations,
    op12_conversation_repair, op13_packing)}

ORACLE = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "op8_license_scan": license_scan.oracle_sql(),
    "op9_decontaminate": decontaminate.ORACLE_SQL,
    "op11_collocations": collocations.ORACLE_SQL,
    "op12_conversation_repair": conversation_repair.ORACLE_SQL,
}
