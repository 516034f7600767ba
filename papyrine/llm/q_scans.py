"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm import scans as op
from papyrine.sources.tables import table

RECORD = ["record_table", "document_id", "record_id"]


def texts(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "text_blocks", F.lit("text_blocks").alias("record_table"), "document_id", F.col("block_id").alias("record_id"), "text")
    docs = table(spark, d, "documents", F.lit("documents").alias("record_table"), F.coalesce("paper_id", F.lit("")).alias("document_id"), F.col("doc_id").cast("string").alias("record_id"), "text")
    return blocks.unionByName(docs).where("text is not null")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = texts(spark, d)
    return op.examined(rows, RECORD, "text", op.model(rows.select("text"))).where(F.size("findings") > 0).select(*RECORD).distinct()


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Repaired text and kinds of noise of every record."""
    rows = texts(spark, d)
    return op.examined(rows, RECORD, "text", op.model(rows.select("text")), repair=True)


QUERIES = {"p6_found": p6_found, "p6_repaired": p6_repaired}
SQL: dict[str, str] = {}
