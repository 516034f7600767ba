"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm import language as op
from papyrine.operators.common import broadcast_if_small
from papyrine.sources.tables import table

RECORD = ["record_table", "document_id", "record_id"]


def _wrong(df: DataFrame, label: str, codes: DataFrame) -> DataFrame:
    """df with ``wrong``: the label is missing, or means another language than the text's."""
    t, own = op.spelled(F.col(label), codes, "labelled")
    x = df.withColumn("labelled_key", own).join(broadcast_if_small(t, op.SPELLINGS), "labelled_key", "left")
    missing = F.col("labelled_key").isNull() | F.lower("labelled_key").isin("", "unknown", "und")
    return x.withColumn("wrong", missing | F.coalesce(F.col("labelled") != F.col("language"), F.lit(True)) & (F.col("language") != "und"))


def p5_languages(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of each record (segment_no 0) and of each foreign line, with the label's fault."""
    codes = table(spark, d, "lang_codes")
    docs = table(spark, d, "documents", "doc_id", "paper_id", "text", "lang")
    model = op.fit(docs, "doc_id", "text", "lang", codes)
    keys = ["record_table", "document_id", "record_id", "label"]
    rows = docs.select(F.lit("documents").alias("record_table"), F.coalesce("paper_id", F.lit("")).alias("document_id"), F.col("doc_id").cast("string").alias("record_id"), F.col("lang").alias("label"), "text")
    own = _wrong(op.judged(rows.where("text is not null"), keys, "text", model, True), "label", codes)
    zero = lambda x: F.array(F.struct(F.lit(0).alias("segment_no"), "language", "confidence"))
    whole = own.select(*RECORD, "wrong", F.explode(F.concat(zero(0), "foreign")).alias("s")).select(*RECORD, "s.*", F.when(F.col("s.segment_no") == 0, F.col("wrong")).otherwise(F.lit(True)).alias("case"))

    requests = table(spark, d, "context_requests", "document_id", "formula_id", "previous_sentence", "current_sentence", "next_sentence", "lang_label")
    said = requests.select(F.lit("context_requests").alias("record_table"), "document_id", F.col("formula_id").alias("record_id"), F.col("lang_label").alias("label"), F.concat_ws("\n", "previous_sentence", "current_sentence", "next_sentence").alias("text"))
    asked = _wrong(op.judged(said, keys, "text", model, False), "label", codes).select(*RECORD, F.lit(0).alias("segment_no"), "language", "confidence", F.col("wrong").alias("case"))

    blocks = table(spark, d, "graph_text_blocks", "document_id", "block_id", "text").where("text is not null")
    parts = op.judged(blocks, ["document_id", "block_id"], "text", model, False).select("document_id", "block_id", "confidence", F.explode("by_language").alias("language", "n"))
    # A block delivered twice counts once; the rest is a sum for each paper and language.
    parts = parts.groupBy("document_id", "block_id", "language").agg(F.max("n").alias("n"), F.max("confidence").alias("c"))
    sums = parts.groupBy("document_id", "language").agg(F.sum("n").alias("n"), F.sum(F.col("c") * F.col("n")).alias("c"))
    papers = sums.groupBy("document_id").agg(F.max(F.struct("n", "language", "c")).alias("b"), F.sum("n").alias("all"))
    papers = papers.select("document_id", F.col("b.language").alias("language"), (F.col("b.c") / F.col("all")).alias("confidence"))
    labels = F.explode(F.array(*[F.struct(F.lit(c).alias("record_id"), F.col(c).alias("label")) for c in ("lang_label", "resolved_ocr_lang")])).alias("x")
    profiles = table(spark, d, "paper_profiles", "document_id", "lang_label", "resolved_ocr_lang").select("document_id", labels).select("document_id", "x.*")
    named = _wrong(profiles.join(papers, "document_id"), "label", codes).select(F.lit("paper_profiles").alias("record_table"), "document_id", "record_id", F.lit(0).alias("segment_no"), "language", "confidence", F.col("wrong").alias("case"))
    return whole.unionByName(asked).unionByName(named)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_languages(spark, d).where("case").select(*RECORD, "segment_no").distinct()


QUERIES = {"p5_found": p5_found, "p5_languages": p5_languages}
SQL: dict[str, str] = {}
