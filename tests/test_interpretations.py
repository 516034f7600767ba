from pyspark.sql import functions as F

from papyrine.operators import reading, validation
from papyrine.plans import interpretation_queries as iq


def test_plain_reading():
    assert reading.plain("\\frac{a}{b} \\le \\sqrt{c}") == "a divided by b less than or equal to square root of c"
    assert reading.plain("\\sum_{i} x^{2} = \\alpha") == "sum subscript i x squared equals alpha"
    assert reading.plain("\\operatorname{Fix}(\\varphi) \\cup \\Gamma") == "Fix ( phi ) union capital gamma"
    assert reading.plain("") == ""


def test_confidence_and_summary(spark):
    df = spark.createDataFrame([("a = b", "here", True), ("a", None, False), (None, None, False)], "x string, c string, d boolean")
    assert [r[0] for r in df.select(reading.confidence(F.col("x"), F.col("c"), F.col("d"))).collect()] == [0.95, 0.7, 0.55]
    df = spark.createDataFrame([("k", "a plus b", ["a", "b"], [("a", "rate")]), ("k", "", [], [])], "k string, t string, v array<string>, d array<struct<symbol: string, definition: string>>")
    got = [r[0] for r in df.select(reading.summary(F.col("k"), F.col("t"), F.col("v"), F.col("d"))).collect()]
    assert got == ["Formula type: k. Readable form: a plus b. Variables: a, b. Definitions near formula: a means rate.", "Formula type: k."]


def test_labels(spark):
    df = spark.createDataFrame([("a  b",), ("x" * 30,), (None,), ("y" * 24,)], "c string")
    assert [r[0] for r in df.select(iq.short(F.col("c"), 24)).collect()] == ["a b", "x" * 23 + "…", "", "y" * 24]
    df = spark.createDataFrame([("formula_1",), ("f12",), ("my_definition",), ("ctx_text",), ("Section 1",), ("q",)], "c string")
    assert [r[0] for r in df.select(iq.object_type(F.col("c"))).collect()] == ["formula", "formula", "definition", "context", "section", "variable"]


def test_possible_definitions(spark, data):
    got = iq.QUERIES["def_possible"](spark, data)
    assert got.count() == got.select("document_id", "formula_id", "symbol", F.lower("definition")).distinct().count() > 0
    assert {r.confidence for r in got.select("confidence").distinct().collect()} <= {0.64, 0.7, 0.72, 0.74, 0.76, 0.78, 0.8, 0.82}


def rows(spark, schema, *values):
    return spark.createDataFrame([("d", *v) for v in values], "document_id string, " + schema)


def test_every_rule_of_documents(spark):
    t = {
        "formulas": rows(spark, "formula_id string, token string, region_id string, section_id string, number string, has_place boolean", ("f1", "[FORMULA_1]", "r1", "s1", "1", True), ("f2", "[FORMULA_1]", "gone", "nope", "1", True), ("", "[FORMULA_9]", None, "s1", None, False), ("f4", "[FORMULA_4]", None, "s1", "1", False)),
        "regions": rows(spark, "region_id string, token string, formula_id string, bbox array<double>", ("r1", "[FORMULA_1]", "f1", [1.0, 2.0, 3.0, 4.0]), ("r2", "[FORMULA_7]", "gone", [1.0])),
        "blocks": rows(spark, "block_id string, section_id string, text_with_tokens string", ("b1", "s1", "a [FORMULA_1] [FORMULA_8]"), ("b2", "nope", None)),
        "contexts": rows(spark, "context_id string, formula_id string, token string, window_text string, n_blocks int", ("c1", "f1", "[FORMULA_1]", "a [FORMULA_1]", 1), ("c2", "gone", "[FORMULA_2]", "none", 0)),
        "sections": rows(spark, "section_id string", ("s1",)), "reading_order": rows(spark, "object_id string", ("b1",), ("f1",), ("what",)),
        "links": rows(spark, "link_id string, source_id string, target_id string", ("l1", "f1", "gone"), ("l2", "f1", "f2")), "nodes": rows(spark, "node_id string", ("n1",), ("n1",), ("n2",)),
        "edges": rows(spark, "edge_id string, source_id string, target_id string", ("e1", "n1", "n2"), ("e2", "n1", "n9")), "entities": rows(spark, "entity_id string, formula_id string, context_id string, section_id string", ("x1", "f1", "c1", "s1"), ("x2", None, "c9", None)),
    }
    got = {}
    for r in validation.document(t).collect():
        got.setdefault(r.code, set()).add(r.object_id)
    assert got == {
        "duplicate_formula_token": {"[FORMULA_1]"}, "formula_id_missing": {"[FORMULA_9]"}, "duplicate_formula_number": {"f1", "f4"}, "formula_region_token_missing": {"r2"}, "formula_region_formula_missing": {"r2"},
        "formula_region_missing": {"f2"}, "invalid_bbox": {"r2"}, "text_with_tokens_unknown_formula": {"[FORMULA_8]"}, "token_not_inserted": {"", "f4"}, "reading_order_missing_object": {"what"},
        "reading_order_missing_text_block": {"b2"}, "reading_order_missing_formula": {"f2"}, "formula_context_missing_formula": {"c2"}, "formula_context_missing": {"f2", "f4", "gone"}, "formula_context_token_missing": {"c2"},
        "text_block_section_missing": {"b2"}, "formula_section_missing": {"f2"}, "formula_link_missing_formula": {"l1"}, "graph_seed_duplicate_node": {"n1"}, "graph_seed_edge_missing_node": {"e2"}, "entity_reference_missing": {"x2"},
    }
    assert len(got) == 21
    assert validation.document({k: v.where("false") for k, v in t.items()}).count() == 0


def test_every_rule_of_graph_ready_documents(spark):
    t = {
        "formulas": rows(spark, "formula_id string, token string, section_id string", ("f1", "[FORMULA_1]", "s1"), ("f2", "[FORMULA_1]", "s9"), ("f3", "[FORMULA_3]", None)), "blocks": rows(spark, "block_id string, section_id string, text_with_tokens string", ("b1", "s1", "[FORMULA_1]")),
        "contexts": rows(spark, "context_id string, formula_id string, token string, window_text string, section_id string", ("c1", "gone", "[FORMULA_1]", "none", "s1")), "sections": rows(spark, "section_id string", ("s1",)),
        "variables": rows(spark, "variable_id string, formula_ids array<string>, context_ids array<string>", ("v1", ["f1"], ["c1"]), ("v2", ["f9"], [])), "relations": rows(spark, "relation_id string, source_id string, target_id string", ("r1", "f1", "c1"), ("r2", "f1", "q")),
        "summary": rows(spark, "field string, n long", ("formulas_count", 3), ("contexts_count", 7), ("sections_count", 0)),
    }
    got = {(r.code, r.object_id) for r in validation.graph_ready(t).collect()}
    assert got == {
        ("duplicate_formula_token", "[FORMULA_1]"), ("formula_token_not_inserted", "f3"), ("formula_context_missing_formula", "c1"), ("formula_context_token_missing", "c1"), ("variable_reference_missing", "v2"),
        ("relation_reference_missing", "r2"), ("section_reference_missing", "f2"), ("summary_count_mismatch", "contexts_count"),
    }


def test_every_rule_of_metagraphs(spark):
    edges = rows(spark, "edge_id string, source_id string, target_id string, kind string", ("e1", "n1", "n2", "k"), ("e2", "n1", "n2", "k"), ("e3", "n1", "n1", "k"), ("e4", "n9", "n2", "k"))
    meta = rows(spark, "edge_id string, source_id string, target_id string, kind string", ("m1", "u1", "u9", "k"), ("m2", "u1", "u1", "k"))
    units = rows(spark, "unit_id string, n_variables int", ("u1", 2), ("u2", 0))
    got = {(r.level, r.code, r.object_id) for r in validation.metagraph(rows(spark, "node_id string", ("n1",), ("n2",)), edges, units, meta).collect()}
    assert got == {
        ("error", "edge_source_missing", "e4"), ("error", "duplicate_edge", "n1|n2|k"), ("error", "edge_self_loop", "e3"), ("error", "meta_edge_target_missing", "m1"), ("error", "meta_edge_self_loop", "m2"),
        ("warning", "isolated_unit", "u2"), ("warning", "unit_without_variables", "u2"),
    }
