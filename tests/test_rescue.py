from papyrine.operators import rescue

SCHEMA = "document_id string, page_number int, formula_id string, latex string, text_source string, flags array<string>, confidence double, bbox struct<x0: double, y0: double, x1: double, y1: double>"
LINES = "document_id string, page_number int, line_id string, text string, bbox struct<x0: double, y0: double, x1: double, y1: double>"
box = lambda x, y: {"x0": float(x), "y0": float(y), "x1": float(x + 100), "y1": float(y + 10)}


def test_doubtful_formulas_take_the_line_beside_them(spark):
    f = spark.createDataFrame([
        ("d", 1, "f1", "t h e x", "pp_formula_net", ["contains_prose"], 0.4, box(0, 195)), ("d", 1, "f2", "where this holds because thus", "pp_formula_net", ["contains_prose"], 0.4, box(0, 800)),
        ("d", 1, "f3", "x = 1", "pp_formula_net", [], 0.9, box(0, 195)), ("d", 1, "f4", "tex", "tex_source", ["contains_prose"], 0.9, box(0, 195)), ("d", 1, "f5", "y", "paddle", ["very_long_formula"], None, None),
    ], SCHEMA)
    lines = spark.createDataFrame([("d", 1, "l1", "α + β ≤ γ·δ", box(0, 210)), ("d", 1, "l2", "plain words of a text", box(0, 205)), ("d", 2, "l3", "α = β + γ·δ", box(0, 195)), ("d", 1, "l4", None, box(0, 1))], LINES)
    got = {r.formula_id: (r.latex, r.text_source, r.confidence, r.outcome) for r in rescue.reconciled(f, lines).collect()}
    assert got["f1"] == ("\\alpha + \\beta \\le \\gamma \\cdot \\delta", "text_pattern", 0.62, "replaced") and "f2" not in got
    assert got["f3"][3] == got["f4"][3] == got["f5"][3] == "kept" and got["f5"][0] == "y"
    assert rescue.reconciled(f.where("false"), lines).count() == 0 and rescue.reconciled(f, lines.where("false")).count() == 4


def test_definitions_are_rescued_from_cyrillic_lines(spark):
    assert rescue.head("\\rho_0 - \\mathrm{p l o t}") == "\\rho_0" and rescue.head("plain words") is None and rescue.head("") is None
    assert rescue.stated("где r0 – плотность, m – вязкость") == [("r0", "плотность"), ("m", "вязкость")]
    assert rescue.meaning("\\rho_0", "где r0 – плотность среды, m – вязкость") == "плотность среды" and rescue.meaning("\\mu", "Здесь m – вязкость.") == "вязкость"
    assert rescue.meaning("x_1", "y – density") is None
    f = spark.createDataFrame([("d", 1, "f1", "\\rho_0 - \\mathrm{p l o t}", "pp_formula_net", ["romanized_ocr_noise"], 0.4, box(0, 100)), ("d", 1, "f2", "\\rho_0 - x", "pp_formula_net", [], 0.4, box(0, 100)), ("d", 1, "f3", "\\rho_0 - x", "pp_formula_net", ["contains_prose"], 0.4, box(0, 600))], SCHEMA)
    lines = spark.createDataFrame([("d", 1, "l1", "где r0 – плотность, m – вязкость", box(20, 112)), ("d", 1, "l2", "q – поток", box(0, 125)), ("d", 1, "l3", "text", box(0, 100))], LINES)
    assert {r.formula_id: r.latex for r in rescue.rescued(f, lines).collect()} == {"f1": "\\rho_0 - \\text{плотность}", "f2": "\\rho_0 - x", "f3": "\\rho_0 - x"}
    assert rescue.rescued(f.where("false"), lines).count() == 0
