"""Queries of problem 3: deeply nested records to flat tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.operators import nested as op
from papyrine.sources.tables import table


def _spans(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "text_blocks", "document_id", F.col("block_id").alias("record_id"), F.transform("text_lines", lambda x: F.when(x.isNotNull(), F.struct(F.transform(x["spans"], lambda s: F.when(s.isNotNull(), F.struct(F.lit(1)))).alias("spans")))).alias("text_lines"))
    return op.flat_spans(rows, ["document_id", "record_id"], "text_lines", "spans").select("document_id", "record_id", "outer_pos", "inner_pos")


def _definitions(spark: SparkSession, d: str, columns: dict | None = None, schema: str = "") -> DataFrame:
    rows = table(spark, d, "mg_metavertices", "document_id", F.col("metavertex_id").alias("record_id"), "attributes")
    return op.flat_json(rows, ["document_id", "record_id"], "attributes", "evidence", "definitions", columns or {}, schema, op.tables_of(rows, "attributes"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    both = _spans(spark, d).withColumn("record_table", F.lit("text_blocks")).unionByName(_definitions(spark, d).withColumn("record_table", F.lit("mg_metavertices")))
    return both.select("record_table", "document_id", "record_id", "outer_pos", "inner_pos").distinct()


def p3_spans(spark: SparkSession, d: str) -> DataFrame:
    """The table of spans with the columns of line and span inlined."""
    rows = table(spark, d, "text_blocks", "document_id", "block_id", "text_lines")
    flat = op.flat_spans(rows, ["document_id", "block_id"], "text_lines", "spans")
    box = [F.col(f"span.bbox.{c}").alias(f"span_{c}") for c in ("x0", "y0", "x1", "y1")]
    return flat.select("document_id", "block_id", F.col("outer_pos").alias("line_pos"), F.col("inner_pos").alias("span_pos"), F.col("line.text").alias("line_text"), F.col("span.text").alias("span_text"), F.col("span.font").alias("font"), F.col("span.size").alias("font_size"), *box).distinct()


def p3_definitions(spark: SparkSession, d: str) -> DataFrame:
    """The table of definitions; singleton members of evidence and definition are inlined, repeated ones are in p3_members."""
    text = lambda x: x if isinstance(x, str) or x is None else json.dumps(x)
    columns = {
        "block_id": lambda e, x: text(e.get("block_id")),
        "marker": lambda e, x: text(e.get("marker")),
        "symbol": lambda e, x: text(x.get("symbol")),
        "definition_text": lambda e, x: text(x.get("definition_text")),
        "section_id": lambda e, x: text((((x.get("scope") or {}) if isinstance(x.get("scope"), dict) else {}).get("section") or {}).get("id")),
        "scope": lambda e, x: text(x.get("scope")),
    }
    flat = _definitions(spark, d, columns, "block_id string, marker string, symbol string, definition_text string, section_id string, scope string")
    return flat.select("document_id", F.col("record_id").alias("metavertex_id"), F.col("outer_pos").alias("evidence_pos"), F.col("inner_pos").alias("definition_pos"), *columns).distinct()


def p3_lines(spark: SparkSession, d: str) -> DataFrame:
    """The table of lines, those without spans or text included, with the columns of the line inlined."""
    flat = op.flat_lines(table(spark, d, "text_blocks", "document_id", "block_id", "text_lines"), ["document_id", "block_id"], "text_lines")
    box = [F.col(f"line.bbox.{c}").alias(f"line_{c}") for c in ("x0", "y0", "x1", "y1")]
    return flat.select("document_id", "block_id", "line_pos", F.col("line.text").alias("line_text"), *box).distinct()


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    """The tables below evidence: every member that the mapping gives a table, with positions at each level and inlined columns."""
    rows = table(spark, d, "mg_metavertices", "document_id", "metavertex_id", "attributes")
    return op.flat_tables(rows, ["document_id", "metavertex_id"], "attributes", "evidence", op.tables_of(rows, "attributes")).distinct()


def p3_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The table of evidence objects, those without definitions included; ``columns`` holds every inlined member."""
    flat = p3_members(spark, d).where("member = 'evidence' and not exists(columns, x -> x.name = '$')")
    value = lambda n: F.get(F.filter("columns", lambda x: x["name"] == n), F.lit(0))["value"].alias(n)
    return flat.select("document_id", "metavertex_id", F.col("positions")[0].alias("evidence_pos"), value("block_id"), value("marker"), "columns")


def p3_schema(spark: SparkSession, d: str) -> DataFrame:
    """Which members of the attributes become tables and which are inlined."""
    return op.mapping(op.cut_schema(table(spark, d, "mg_metavertices", "attributes"), "attributes"))


QUERIES = {"p3_found": p3_found, "p3_lines": p3_lines, "p3_spans": p3_spans, "p3_members": p3_members, "p3_evidence": p3_evidence, "p3_definitions": p3_definitions, "p3_schema": p3_schema}
_SPANS = """spans as (
  select document_id, block_id, l as line_pos, generate_subscripts(line.spans, 1) - 1 as span_pos, line, unnest(line.spans) as span
  from (select document_id, block_id, generate_subscripts(text_lines, 1) - 1 as l, unnest(text_lines) as line from text_blocks)
)"""
SQL = {
    "p3_lines": "select distinct document_id, block_id, cast(line_pos as int) as line_pos, line.text as line_text, line.bbox.x0 as line_x0, line.bbox.y0 as line_y0, line.bbox.x1 as line_x1, line.bbox.y1 as line_y1 from (select document_id, block_id, generate_subscripts(text_lines, 1) - 1 as line_pos, unnest(text_lines) as line from text_blocks) where line is not null",
    "p3_spans": f"with {_SPANS} select distinct document_id, block_id, cast(line_pos as int) as line_pos, cast(span_pos as int) as span_pos, line.text as line_text, span.text as span_text, span.font as font, span.size as font_size, span.bbox.x0 as span_x0, span.bbox.y0 as span_y0, span.bbox.x1 as span_x1, span.bbox.y1 as span_y1 from spans where span is not null",
}
