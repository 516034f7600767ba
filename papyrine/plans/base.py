"""Current rows of the paper tables: each key once, as last delivered, deleted ones left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.sources.tables import table

TABLES = {
    "formulas": ("formula_index", "formula_id", ["token", "kind", "latex", "text_source", "confidence", "section_id", "ord", "symbols"], True),
    "blocks": ("graph_text_blocks", "block_id", ["block_type", "page_number", "section_id", "ord", "paragraph_id", "text", "text_with_tokens", "formula_tokens", "text_source"], False),
    "sections": ("graph_sections", "section_id", ["title", "sec_level", "ord", "parent_id"], False),
    "nodes": ("mg_nodes", "node_id", ["node_type", "node_label"], True),
    "edges": ("mg_edges", "edge_id", ["source_id", "target_id", "edge_type", "attributes"], False),
    "metavertices": ("mg_metavertices", "metavertex_id", ["mv_type", "mv_label", "contains_ids", "entry_points", "exit_points", "attributes"], True),
    "metaedges": ("mg_metaedges", "metaedge_id", ["metaedge_type", "source_set", "target_set", "mediator_nodes", "attributes"], False),
    "contexts": ("context_requests", "formula_id", ["formula_latex", "variables", "previous_sentence", "current_sentence", "next_sentence", "lang_label"], False),
    "layers": ("text_blocks", "block_id", ["page_number", "text", "bbox", "text_source", "confidence", "block_role", "section_id"], False),
}


def current(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """document_id, key and columns of a table; only what is asked for is read, and one row a key comes out."""
    source, key, every, deletable = TABLES[name]
    columns = columns or tuple(every)
    own = [*columns, *(["deleted_at"] if deletable else [])]
    rows = table(spark, d, source, "document_id", key, *own, "loaded_at")
    rows = rows.groupBy("document_id", key).agg(F.max_by(F.struct(*own), "loaded_at").alias("r")).select("document_id", key, *[F.col(f"r.{c}").alias(c) for c in own])
    return rows.where("deleted_at is null").drop("deleted_at") if deletable else rows


def sql(*names: str) -> str:
    """The same tables as common table expressions for DuckDB."""
    out = []
    for name in names:
        source, key, every, deletable = TABLES[name]
        own = [*every, *(["deleted_at"] if deletable else [])]
        row = ", ".join(f"'{c}': {c}" for c in own)
        out.append(
            f"{name} as (select document_id, {key}, {', '.join('r.' + c + ' as ' + c for c in every)} from (select document_id, {key}, arg_max({{{row}}}, loaded_at) as r from {source} group by 1, 2){' where r.deleted_at is null' if deletable else ''})"
        )
    return "with recursive " + ",\n".join(out) + "\n"
