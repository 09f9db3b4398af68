"""Queries p6 to p8 over the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.leaks import leaks
from tidemark.llm.pieces import split_corpus
from tidemark.llm.tokens import encode_corpus
from tidemark.plans.tables import table


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p7_passages(spark: SparkSession, d: str) -> DataFrame:
    """Every leaked passage with its place in the item and in the document's text."""
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_corpus(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p6_ids, p7_found, p7_passages, p8_pieces)}
SQL: dict[str, str] = {}
