"""Rules of notation, definitions and search against values written down by hand."""

import pytest
from pyspark.sql import functions as F

from papyrine.functions import latex, notation, text
from papyrine.operators import search
from papyrine.plans.definitions import rule_definitions


def values(spark, f, rows, schema="x string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    cols = [F.col(c) for c in df.columns]
    return [r[0] for r in df.select(f(*cols).alias("v")).collect()]


def test_text_to_latex(spark):
    assert len(notation.GREEK) == 30 and len(notation.SIGNS) == 33
    rows = ["• α ≤ β.", "ψ1 + x2", "lim ω → ∞", "x ∈ R n", "ρab(z)", "σ k − 3"]
    assert values(spark, latex.from_text, rows) == ["\\alpha \\le \\beta", "\\psi_{1} + x_{2}", "\\lim \\omega \\to \\infty", "x \\in \\mathbb{R}^{n}", "\\rho_{ab}(z)", "\\sigma_{k} - 3"]


def test_operators_and_classes(spark):
    assert values(spark, latex.operators, ["\\frac{a}{b} = \\sqrt{c}", "a \\cdots b \\dots c", "x^2 - 1 + y", "\\infty", "\\int x \\in A"]) == [["fraction", "sqrt", "equals"], ["ellipsis"], ["plus", "minus", "power"], [], ["integral", "membership"]]
    rows = [("\\forall x", None), ("f \\to g", ""), ("\\sum x", ""), ("a \\le b", None), ("a = b", "plain"), ("a", "here x denotes y"), ("a", "text"), (None, "for all x"), ("a", "the sum of")]
    assert values(spark, latex.kind, rows, "x string, y string") == ["set_or_logic_expression", "mapping_or_implication", "aggregation_or_calculus", "constraint_or_inequality", "definition_or_equation", "notation_context", "mathematical_expression", "set_or_logic_expression", "aggregation_or_calculus"]
    h = values(spark, latex.hints, [("\\frac{a}{b} \\leq \\max", "Theorem: x denotes y"), (None, None)], "x string, y string")
    assert h[0].asDict() == {"definition_like": True, "theorem_like": True, "optimization_like": True, "contains_equality": False, "contains_inequality": True, "contains_sum": False, "contains_integral": False, "contains_fraction": True, "contains_matrix": False}
    assert not any(h[1])


def test_symbols(spark):
    rows = ["$\\alpha$", " x _ 1 ", "{\\lambda}", "λ", "Lambda", "\\mathbb{R}", "\\mathcal{xy}", "where", "", "ρ", "x_{12}"]
    assert values(spark, latex.symbol, rows) == ["\\alpha", "x_1", "\\lambda", "\\lambda", "\\lambda", "\\mathbb{R}", None, None, None, "ρ", "x_12"]
    assert values(spark, latex.formula_symbols, ["\\mathbb{R} \\ni x_{1} + \\frac{\\alpha}{y} = z"]) == [["\\mathbb{R}", "\\ni", "\\alpha", "x_1", "y", "z"]]
    assert values(spark, latex.is_variable, ["\\frac", "x", "\\alpha", "+", "matrix", "\\quad", "frac", "x_1"]) == [False, True, True, False, False, False, False, True]
    assert values(spark, latex.operator_tokens, ["\\frac{a}{b} = c + \\alpha - \\frac{1}{2}"]) == [["\\frac", "=", "+", "-"]]


def test_wrappers_scripts_and_sanity(spark):
    assert values(spark, latex.stripped, ["$$ x $$", "$ $ $ $ $x$ $ $ $ $", "\\[ \\( y \\) \\]", "a $b$ c", None, ""]) == ["x", "x", "y", "a $b$ c", None, ""]
    assert values(spark, latex.braced, ["x_1^2", "x_{1}", "a_bc", "f(x)^2"]) == ["x_{1}^2", "x_{1}", "a_bc", "f(x)^{2}"]
    got = values(spark, latex.sanity, ["a = b", "", ")(", "{a", "plain", "a � = 1"])
    assert [(r.valid, r.warnings, r.score) for r in got] == [(True, [], 1.0), (False, ["empty_latex", "weak_math_signal"], 0.64), (True, ["unbalanced_parentheses", "weak_math_signal"], 0.64), (False, ["unbalanced_braces", "weak_math_signal"], 0.64), (True, ["weak_math_signal"], 0.82), (True, ["replacement_symbol"], 0.82)]
    assert values(spark, latex.structure_score, ["\\frac{a}{b} = x_1", "\\therefore abcdefgh"]) == [7, -5]
    assert values(spark, latex.prose_words, ["\\alpha then where cosh sech"]) == [2]


def test_blocks_and_layers(spark):
    rows = [("Section", "x"), ("LIST_ITEM", ""), (None, "RESULTS 2"), (None, "123"), ("other", "plain text"), (None, "  ")]
    assert values(spark, text.block_type, rows, "x string, y string") == ["heading", "list_item", "heading", "paragraph", "paragraph", "unknown"]
    rows = [("Introduction", None), ("1.2 Mesh", "paragraph"), ("Методы", "paragraph"), ("1.2 Mesh", "title"), ("Resulted", "paragraph"), ("x" * 181, "heading"), ("any", "heading"), ("", "heading")]
    assert values(spark, text.is_heading, rows, "x string, y string") == [True, True, True, False, False, False, True, False]
    got = values(spark, text.layer_assessment, ["a" * 100, "", "12 �\x01 " + " " * 20])
    assert [(r.quality, r.score, r.char_count, r.warnings, r.allow_ocr_fallback) for r in got] == [("good", 1.0, 100, [], False), ("missing", 0.0, 0, ["text_layer_missing", "excessive_whitespace"], True), ("poor", 0.28, 5, ["replacement_symbols_present", "control_symbols_present", "low_letter_ratio", "excessive_whitespace"], True)]
    assert values(spark, text.corrupted, ["¶¶¶", "ÃÃÃÃÃÃÃÃ", "plain", "", None]) == [True, True, False, False, False]
    assert values(spark, text.layer_quality, ["□" * 11 + "a" * 300, "a" * 300, "a" * 299, " "]) == ["poor", "good", "poor", "missing"]
    assert values(spark, text.markers, ["It is defined as x; let y. Пусть"]) == [["defined as", "is defined as", "let", "пусть"]]
    window = values(spark, text.token_window, [("a" * 400 + "[FORMULA_1]" + "b" * 400, "[FORMULA_1]")], "x string, y string")[0]
    assert window == "a" * 260 + "[FORMULA_1]" + "b" * 260


def test_definition_rules(spark):
    said = {
        "where x is the mesh, and more": ("en_where_is", "x", "the mesh, and more"), "где N — остаток энергии": ("ru_where_dash", "N", "остаток энергии"), "let A be a weight": ("en_let_be", "A", "a weight"),
        "пусть T постоянно": ("ru_let", "T", "постоянно"), "x_1 is defined as the sum": ("en_defined_as", "x_1", "the sum"), "k — это параметр": ("ru_is", "k", "параметр"), "q represents flow": ("en_represents", "q", "flow"),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "k int, t string")
    got = {(r.k, r.rule): (r.symbol, r.definition) for r in rule_definitions(df, ["k"], "t").collect()}
    for i, (rule, symbol, definition) in enumerate(said.values()):
        assert got[(i, rule)] == (symbol, definition)
    assert rule_definitions(df.where("false"), ["k"], "t").count() == 0


@pytest.fixture(scope="module")
def tables(spark):
    links = spark.createDataFrame([("a", "f1", "s1", 1, "\\lambda"), ("a", "f1", "s1", 1, "x"), ("a", "f2", "s2", 2, "\\lambda"), ("c", "f9", None, 1, "y")], "document_id string, formula_id string, section_id string, ord int, symbol string")
    formulas = spark.createDataFrame([("a", "f1", "\\lambda x", "s1", "[FORMULA_001]"), ("a", "f2", "\\lambda", "s2", "[FORMULA_002]"), ("b", "f1", "2 \\lambda", "s1", "[FORMULA_003]"), ("c", "f9", "y", None, None)], "document_id string, formula_id string, latex string, section_id string, token string")
    contexts = spark.createDataFrame([("a", "f1", "where \\lambda is a rate")], "document_id string, formula_id string, near string")
    blocks = spark.createDataFrame([("a", "b1", "s1", "see \\lambda here"), ("a", "b2", "s1", "where \\lambda is a rate"), ("b", "b1", "s1", "also \\lambda"), ("a", "b3", None, None)], "document_id string, block_id string, section_id string, text string")
    return links, formulas, contexts, blocks


def test_search_tiers(spark, tables):
    got = sorted((r.document_id, r.kind, r.formula_id or r.block_id, r.confidence) for r in search.variable(*tables, "λ").collect())
    assert got == [("a", "formula", "f1", 0.9), ("a", "formula", "f2", 0.78), ("a", "text_mention", "b1", 0.62), ("b", "fallback", "f1", 0.55)]
    assert search.variable(*tables, "\\frac").count() == 0 and search.variable(*tables, "").count() == 0
    assert search.variable(*[t.where("false") for t in tables], "λ").count() == 0
    d = spark.createDataFrame([("a", "\\lambda", "a rate"), ("b", "\\lambda", "A weight"), ("b", "\\lambda", "a weight")], "document_id string, symbol string, definition string")
    c = {r.document_id: r for r in search.corpus_variable(search.variable(*tables, "λ"), d, "λ").collect()}
    assert (c["a"].n_matches, c["a"].n_formulas, c["a"].n_definitions, c["a"].level, c["a"].confidence) == (3, 2, 1, "document", 0.9)
    assert [tuple(r) for r in search.conflicts(d, "λ").collect()] == [("a", "a rate", "b", "a weight")]


def test_search_by_name(spark, tables):
    links, formulas, contexts, blocks = tables
    for asked in ("f1", "F1", "FORMULA_001", "1", "[formula_001]"):
        assert "f1" in {r.formula_id for r in search.formula(formulas.where("document_id = 'a'"), asked).collect()}, asked
    assert [r.symbol for r in search.suggestions(links.select("symbol"), "lam").collect()][0] == "\\lambda"
    assert [r.block_id for r in search.text(blocks, "SEE").collect()] == ["b1"]
    index = {(r.document_id, r.symbol): r for r in search.index_rows(links, contexts, spark.createDataFrame([("a", "\\lambda", "f1", "a rate"), ("z", "q", "f5", "flow")], "document_id string, symbol string, formula_id string, definition string")).collect()}
    row = index[("a", "\\lambda")]
    assert (row.formulas, row.contexts, row.definitions, row.related) == ("f1|f2", "ctx:f1", "a rate", "x") and index[("z", "q")].definitions == "flow"
    e = spark.createDataFrame([("d", "a", "b"), ("d", "c", "b"), ("d", "c", "e"), ("d", None, "a"), ("x", "a", "q")], "document_id string, source_id string, target_id string")
    seed = spark.createDataFrame([("d", "a")], "document_id string, id string")
    assert sorted((r.id, r.hop) for r in search.neighbourhood(e, seed, 3).collect()) == [("a", 0), ("b", 1), ("c", 2), ("e", 3)]
    assert {r.alias: r["mode"] for r in search.modes(spark).collect()}["metagraph_view"] == "metagraph_planetary_overview"
