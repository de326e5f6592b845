"""The document operators as queries over whole tables, with SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from demandloom.llm.language import identify
from demandloom.llm.lines import find_repeated_lines
from demandloom.llm.merkle import manifest
from demandloom.llm.mixing import mix
from demandloom.llm.near import near_duplicates
from demandloom.llm.negatives import hard_negatives
from demandloom.llm.packing import pack_documents
from demandloom.llm.pseudonyms import replace_personal_data
from demandloom.llm.quality import quality
from demandloom.llm.repeats import remove_repeats
from demandloom.llm.secrets import find_secrets
from demandloom.llm.spots import fingerprint
from demandloom.llm.sql import ORACLES
from demandloom.llm.warc import archived_pages


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_documents(spark, sf_dir))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), width=4)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_documents(spark, sf_dir))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(_documents(spark, sf_dir))


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_personal_data(_documents(spark, sf_dir))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeated_lines(_documents(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir))


def op11_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(_documents(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_language_id": op3_language_id,
    "op4_secret_scan": op4_secret_scan,
    "op5_fingerprints": op5_fingerprints,
    "op6_pseudonyms": op6_pseudonyms,
    "op7_repeated_passages": op7_repeated_passages,
    "op8_source_mixing": op8_source_mixing,
    "op9_line_dedup": op9_line_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_warc_index": op11_warc_index,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_hard_negatives": op13_hard_negatives,
}

__all__ = ["ORACLES", "QUERIES"]
