"""The numbered queries: each operator over its whole table, with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewlake.llm import bpe, dialogues, idfiles, jaccard, langid, mixing, neardup, packing, phrases, pii, quality, secrets, warc
from reviewlake.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op2_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents")).drop("reason")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op6_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_report(table(spark, sf_dir, "documents"))


def op7_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(table(spark, sf_dir, "pages"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_report(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.token_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogues.repair_report(table(spark, sf_dir, "conversations"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_embedding_near_dup, op3_quality_rules, op4_token_counts, op5_language_id, op6_private_data, op7_warc_records, op8_jaccard_join, op9_secret_scan, op10_best_fit_packing, op11_token_id_files, op12_conversation_repair, op13_phrase_collocations)}

ORACLE = {"op1_mix_sources": mixing.SQL, "op2_embedding_near_dup": neardup.SQL, "op3_quality_rules": quality.SQL, "op8_jaccard_join": jaccard.SQL, "op12_conversation_repair": dialogues.SQL, "op13_phrase_collocations": phrases.SQL}
