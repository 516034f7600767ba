"""Integrity rules of documents and metagraphs over their tables.

Each rule is a join or an aggregation over whole tables; what breaks it comes out as (document_id, code, object_id), once.
Tables are handed over by name; rules whose tables are missing are left out.

Defined results: null ids and null references break no rule unless it says so; empty tables break none; rows given twice
count once except where a rule asks for repeated keys; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Formula token in running text.
TOKEN = r"(\[FORMULA_[0-9]+\])"
#: Mean degree above which a graph is too dense to display.
DENSE = 10


def _row(df: DataFrame, code: str, object_id: str | Column) -> DataFrame:
    c = F.col(object_id) if isinstance(object_id, str) else object_id
    return df.select("document_id", F.lit(code).alias("code"), c.cast("string").alias("object_id"))


def _repeated(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy("document_id", *keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")


def _unknown(df: DataFrame, reference: str, known: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is given, but not among the keys of its document."""
    k = known.select(F.col("document_id").alias("_d"), F.col(key).alias("_k")).distinct()
    return df.where(f"{reference} is not null and {reference} <> ''").join(k, (F.col("document_id") == F.col("_d")) & (F.col(reference) == F.col("_k")), "left_anti")


def _tokens(blocks: DataFrame) -> DataFrame:
    return blocks.select("document_id", F.explode(F.regexp_extract_all("text_with_tokens", F.lit(TOKEN), 1)).alias("token")).distinct()


def document(tables: dict[str, DataFrame]) -> DataFrame:
    """The 21 rules of a structured document.

    formulas (formula_id, token, region_id, section_id, number, has_place), regions (region_id, token, formula_id, bbox),
    blocks (block_id, section_id, text_with_tokens, bbox), contexts (context_id, formula_id, token, window_text, n_blocks),
    sections (section_id), reading_order (object_id), links (link_id, source_id, target_id), nodes (node_id),
    edges (edge_id, source_id, target_id), entities (entity_id, formula_id, context_id, section_id).
    """
    t = tables
    out: list[DataFrame] = []
    f, b, c, s, r, o = (t.get(k) for k in ("formulas", "blocks", "contexts", "sections", "regions", "reading_order"))
    if f is not None:
        out.append(_row(_repeated(f.where("token is not null"), "token"), "duplicate_formula_token", "token"))
        out.append(_row(f.where("formula_id is null or formula_id = ''"), "formula_id_missing", "token"))
        if "number" in f.columns:
            same = _repeated(f.where("number is not null"), "section_id", "number").select(F.col("document_id").alias("_d"), F.col("section_id").alias("_s"), F.col("number").alias("_m"))
            out.append(_row(f.join(same, (F.col("document_id") == F.col("_d")) & F.col("section_id").eqNullSafe(F.col("_s")) & (F.col("number") == F.col("_m")), "left_semi"), "duplicate_formula_number", "formula_id"))
    if f is not None and r is not None:
        out.append(_row(_unknown(r, "token", f, "token").unionByName(r.where("token is null")), "formula_region_token_missing", "region_id"))
        out.append(_row(_unknown(r, "formula_id", f, "formula_id").unionByName(r.where("formula_id is null or formula_id = ''")), "formula_region_formula_missing", "region_id"))
        out.append(_row(_unknown(f, "region_id", r, "region_id"), "formula_region_missing", "formula_id"))
    for name, key in (("blocks", "block_id"), ("regions", "region_id"), ("formulas", "formula_id")):
        x = t.get(name)
        if x is not None and "bbox" in x.columns:
            out.append(_row(x.where("bbox is not null and (size(bbox) <> 4 or exists(bbox, v -> v is null))"), "invalid_bbox", key))
    if f is not None and b is not None:
        token = _tokens(b)
        out.append(_row(_unknown(token, "token", f, "token"), "text_with_tokens_unknown_formula", "token"))
        out.append(_row(_unknown(f, "token", token, "token"), "token_not_inserted", "formula_id"))
        if o is not None:
            ids = b.select("document_id", F.col("block_id").alias("id")).union(f.select("document_id", "formula_id"))
            out.append(_row(_unknown(o, "object_id", ids, "id"), "reading_order_missing_object", "object_id"))
            out.append(_row(_unknown(b, "block_id", o, "object_id"), "reading_order_missing_text_block", "block_id"))
            placed = f.where("has_place") if "has_place" in f.columns else f
            out.append(_row(_unknown(placed, "formula_id", o, "object_id"), "reading_order_missing_formula", "formula_id"))
    if f is not None and c is not None:
        out.append(_row(_unknown(c, "formula_id", f, "formula_id"), "formula_context_missing_formula", "context_id"))
        bare = _row(_unknown(f, "formula_id", c, "formula_id"), "formula_context_missing", "formula_id")
        out.append(bare.unionByName(_row(c.where("coalesce(n_blocks, 0) = 0"), "formula_context_missing", "formula_id")))
    if c is not None:
        out.append(_row(c.where("token is not null and not contains(coalesce(window_text, ''), token)"), "formula_context_token_missing", "context_id"))
    if s is not None:
        if b is not None:
            out.append(_row(_unknown(b, "section_id", s, "section_id"), "text_block_section_missing", "block_id"))
        if f is not None:
            out.append(_row(_unknown(f, "section_id", s, "section_id"), "formula_section_missing", "formula_id"))
    if f is not None and "links" in t:
        out += [_row(_unknown(t["links"], end, f, "formula_id"), "formula_link_missing_formula", "link_id") for end in ("source_id", "target_id")]
    if "nodes" in t:
        out.append(_row(_repeated(t["nodes"], "node_id"), "graph_seed_duplicate_node", "node_id"))
        if "edges" in t:
            out += [_row(_unknown(t["edges"], end, t["nodes"], "node_id"), "graph_seed_edge_missing_node", "edge_id") for end in ("source_id", "target_id")]
    if "entities" in t:
        for known, key in ((f, "formula_id"), (c, "context_id"), (s, "section_id")):
            if known is not None:
                out.append(_row(_unknown(t["entities"], key, known, key), "entity_reference_missing", "entity_id"))
    return reduce(DataFrame.unionByName, out).distinct()


def graph_ready(tables: dict[str, DataFrame]) -> DataFrame:
    """The eight rules of a graph-ready document: tokens, contexts, variables, relations, sections, counts.

    formulas, blocks, contexts, sections as in ``document`` (contexts with section_id), variables (variable_id, formula_ids,
    context_ids), relations (relation_id, source_id, target_id), summary (field, n) with the counts a document states.
    """
    t = tables
    f, b, c, s, v = (t[k] for k in ("formulas", "blocks", "contexts", "sections", "variables"))
    out = [_row(_repeated(f.where("token is not null"), "token"), "duplicate_formula_token", "token")]
    out.append(_row(_unknown(f, "token", _tokens(b), "token"), "formula_token_not_inserted", "formula_id"))
    out.append(_row(_unknown(c, "formula_id", f, "formula_id"), "formula_context_missing_formula", "context_id"))
    out.append(_row(c.where("token is not null and not contains(coalesce(window_text, ''), token)"), "formula_context_token_missing", "context_id"))
    for ids, known, key in (("formula_ids", f, "formula_id"), ("context_ids", c, "context_id")):
        out.append(_row(_unknown(v.select("document_id", "variable_id", F.explode(ids).alias("ref")), "ref", known, key), "variable_reference_missing", "variable_id"))
    every = [f.select("document_id", F.col("formula_id").alias("id")), c.select("document_id", "context_id"), v.select("document_id", "variable_id"), s.select("document_id", "section_id"), b.select("document_id", "block_id")]
    known = reduce(DataFrame.union, every)
    if "relations" in t:
        out += [_row(_unknown(t["relations"], end, known, "id"), "relation_reference_missing", "relation_id") for end in ("source_id", "target_id")]
    for x, key in ((b, "block_id"), (f, "formula_id"), (c, "context_id")):
        if "section_id" in x.columns:
            out.append(_row(_unknown(x, "section_id", s, "section_id"), "section_reference_missing", key))
    if "summary" in t:
        counts = {"formulas_count": f, "text_blocks_count": b, "contexts_count": c, "sections_count": s, "variables_count": v, **({"relations_count": t["relations"]} if "relations" in t else {})}
        real = reduce(DataFrame.unionByName, [x.groupBy("document_id").agg(F.count(F.lit(1)).alias("real")).select("document_id", F.lit(k).alias("field"), "real") for k, x in counts.items()])
        told = t["summary"].where(F.col("field").isin(list(counts)) & (F.col("n") != 0)).join(real, ["document_id", "field"], "left")
        out.append(_row(told.where(F.col("n") != F.coalesce("real", F.lit(0))), "summary_count_mismatch", "field"))
    return reduce(DataFrame.unionByName, out).distinct()


def metagraph(nodes: DataFrame, edges: DataFrame, units: DataFrame, meta_edges: DataFrame) -> DataFrame:
    """(document_id, level, code, object_id) of a metagraph: references, duplicates and self-loops are errors; isolated units,
    units without variables and density are warnings.

    nodes (node_id), edges (edge_id, source_id, target_id, kind), units (unit_id, n_variables), meta_edges like edges.
    """
    parts = []
    for e, known, key, name in ((edges, nodes, "node_id", "edge"), (meta_edges, units, "unit_id", "meta_edge")):
        parts += [_row(_unknown(e, end, known, key), f"{name}_{end.removesuffix('_id')}_missing", "edge_id") for end in ("source_id", "target_id")]
        whole = e.where("source_id is not null and target_id is not null")
        repeated = _repeated(whole, "source_id", "target_id", "kind")
        parts.append(_row(repeated, f"duplicate_{name}", F.concat_ws("|", "source_id", "target_id", "kind")))
        parts.append(_row(whole.where("source_id = target_id"), f"{name}_self_loop", "edge_id"))
    errors = reduce(DataFrame.unionByName, parts).distinct().withColumn("level", F.lit("error"))
    ends = edges.unionByName(meta_edges).select("document_id", F.explode(F.array("source_id", "target_id")).alias("end")).where("end is not null").distinct()
    several = _repeated(units).select("document_id")
    alone = units.join(several, "document_id", "left_semi").join(ends.withColumnRenamed("end", "unit_id"), ["document_id", "unit_id"], "left_anti")
    degree = meta_edges.select("document_id", F.explode(F.array("source_id", "target_id")).alias("end")).groupBy("document_id").agg(F.count(F.lit(1)).alias("m"), F.countDistinct("end").alias("k"))
    warnings = _row(alone, "isolated_unit", "unit_id").unionByName(_row(units.where("coalesce(n_variables, 0) = 0"), "unit_without_variables", "unit_id")).unionByName(_row(degree.where(F.col("m") > DENSE * F.col("k")), "dense_graph", "document_id"))
    return errors.unionByName(warnings.distinct().withColumn("level", F.lit("warning"))).select("document_id", "level", "code", "object_id")
