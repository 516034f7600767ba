"""Queries of problem 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm import spam
from papyrine.sources.tables import table


def p10_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page with the figures of its curve."""
    return spam.spam(table(spark, d, "documents", "doc_id", "text", "lang"), "doc_id", "text", "lang", table(spark, d, "lang_codes")).withColumnRenamed("key", "doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_pages(spark, d).where("spam").select("doc_id")


QUERIES = {"p10_found": p10_found, "p10_pages": p10_pages}
SQL: dict[str, str] = {}
