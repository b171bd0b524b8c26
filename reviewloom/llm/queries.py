"""The text problems as queries over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reviewloom.llm import leakage, packing, residue
from reviewloom.llm.pii import operator as pii
from reviewloom.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    silver = table(spark, sf_dir, "silver_feedback")
    return pii.mentions(silver, "review_text", ["review_id"]).select("review_id", "pii_type", "start_at").distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    silver = table(spark, sf_dir, "silver_feedback").select("review_id", "event_hash", "review_text")
    return pii.redact(silver, "review_text").select("review_id", "event_hash", "redacted")


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    leaks = leakage.find_leaks(documents, table(spark, sf_dir, "eval_items"))
    return leakage.without_leaks(documents.select("doc_id", "source", "n_chars"), leaks)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars", "boxes")
    return residue.without_residue(documents, residue.find_residue(documents)).drop("text", "boxes")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p4_found, p4_redacted, p7_packed, p8_found, p8_clean, p9_found, p9_clean)}
ORACLE: dict[str, str] = {}
