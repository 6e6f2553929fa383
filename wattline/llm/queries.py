"""The registered queries of the numbered operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from wattline.llm import decontaminate, extraction, langid, neighbours, packing, quality, rotation, simhash, spelling, substring, suffixes, toxicity, trie
from wattline.llm.base import QUERIES, SQL, query, table


@query("op1_suffix_dedup", suffixes.SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


@query("op2_benchmark_decontamination", decontaminate.SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_embedding_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.digest(table(spark, sf_dir, "embeddings"))


@query("op4_chat_perspectives", rotation.SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotation.digest(table(spark, sf_dir, "conversations"))


@query("op5_simhash_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_substring_dedup", substring.SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents"))


@query("op11_spelling_variants", spelling.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.digest(table(spark, sf_dir, "documents"))


@query("op12_main_text", extraction.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(table(spark, sf_dir, "pages"))


@query("op13_conversation_trie", trie.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.digest(table(spark, sf_dir, "conversations"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def registered_queries():
    return dict(QUERIES)


def registered_sql():
    return dict(SQL) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
