"""The thin queries of the training-data operators, one for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import tables
from . import ann, chat, decontaminate, html_text, lexical, merkle, neardup, packing, pii, secrets, sql, sstable, swappack, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.spread(tables.table(spark, sf_dir, name))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op4_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.read(sstable.write(_table(spark, sf_dir, "documents")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), spark.conf.get("quillspark.pii.key", pii.DEFAULT_KEY))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(_table(spark, sf_dir, "conversations"))


def op11_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swappack.pack(_table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_secrets": op2_secrets,
    "op3_html_text": op3_html_text,
    "op4_token_tables": op4_token_tables,
    "op5_decontaminate": op5_decontaminate,
    "op6_toxicity": op6_toxicity,
    "op7_pseudonyms": op7_pseudonyms,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_nearest": op9_nearest,
    "op10_chat": op10_chat,
    "op11_swap_packing": op11_swap_packing,
    "op12_ranked_search": op12_ranked_search,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLES = {
    "op2_secrets": sql.SECRETS,
    "op3_html_text": sql.PAGES,
    "op5_decontaminate": sql.CONTAMINATION,
    "op8_near_duplicates": sql.NEAR,
    "op12_ranked_search": sql.RANKED,
    "op13_merkle_manifest": sql.MERKLE,
}
