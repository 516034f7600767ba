"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm import sentences as op
from papyrine.sources.tables import table

KEYS = ["record_table", "document_id", "record_id", "field"]


def fields(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "graph_text_blocks", "document_id", "block_id", "paragraph_id", "text").where("paragraph_id is not null")
    a = blocks.select(F.lit("graph_text_blocks").alias("record_table"), "document_id", F.col("block_id").alias("record_id"), F.lit("text").alias("field"), "text")
    requests = table(spark, d, "context_requests", "document_id", "formula_id", "previous_sentence", "current_sentence")
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("previous_sentence", "current_sentence")]))
    b = requests.select(F.lit("context_requests").alias("record_table"), "document_id", F.col("formula_id").alias("record_id"), both.alias("f")).select("record_table", "document_id", "record_id", "f.field", "f.text")
    return a.unionByName(b).where("text is not null")


def p7_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = fields(spark, d)
    return op.sentences(rows, KEYS, "text", op.fit(rows.select("text")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_sentences(spark, d).select(*KEYS, "char_end")


QUERIES = {"p7_found": p7_found, "p7_sentences": p7_sentences}
SQL: dict[str, str] = {}
