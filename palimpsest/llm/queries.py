"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, edit_embedding, langid, licenses, lm_scoring, oracle, packing, quotes, simhash, token_store, toxicity
from palimpsest.llm.shared import documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_store.store_folder(spark)
    manifest = token_store.write(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_store.read(spark, folder, manifest).drop("ids")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(documents(spark, sf_dir, "doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(_table(spark, sf_dir, "conversations"))


def op5_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.fingerprint(documents(spark, sf_dir, "doc_id", "text"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(documents(spark, sf_dir, "doc_id", "text"), _table(spark, sf_dir, "labels"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir, "doc_id", "text"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op10_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _table(spark, sf_dir, "labels").filter(F.col("quality") == 1).select("doc_id")
    return lm_scoring.score(documents(spark, sf_dir, "doc_id", "text"), targets)


QUERIES = (
    op1_best_fit_packing, op2_token_store, op3_decontamination, op4_quotation_linking, op5_edit_embedding,
    op6_toxicity, op7_license_scan, op8_simhash, op9_language_id, op10_cross_entropy_difference,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_quotation_linking": oracle.quotation_linking(), "op7_license_scan": oracle.license_scan()}
