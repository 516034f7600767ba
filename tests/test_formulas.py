import pytest

from papyrine.operators import formulas as op


def test_detection_in_order_and_without_overlap():
    t = "Let $a = b$ and x_1 = 3.5 hold.\n\\[ c < d \\] then \\(e\\) costs $5 to $6. \\begin{align}f &= g\\end{align}"
    got = [(stage, latex) for _, stage, latex, _ in op.detect(t)]
    assert got == [("inline", "a = b"), ("prose", "x_1 = 3.5"), ("block", "c < d"), ("inline", "e"), ("block", "f &= g")]
    assert op.detect(None) == [] and op.detect("") == [] and op.detect("no formula here") == []
    assert len(op.detect("x = 1, " * 20_000)) == 20_000


def test_splitting_and_reading():
    assert op.split_top("a = f(b = c) = d", "=") == ["a", "f(b = c)", "d"]
    assert op.split_top("", "=") == [] and op.split_top("a+{b-c}-d", "+-") == ["a", "{b-c}", "d"]
    assert op.plain("\\frac{c}{f} = x^{2}") == "c divided by f equals x squared"
    assert op.balanced("{a\\}}") and not op.balanced("}{") and not op.balanced("{")
    assert op.similarity("a = b", "a = b") == 1.0


def test_tables(spark):
    df = spark.createDataFrame([("d", "1", "$x$ and y = 2", 7), ("d", "2", None, 8), ("d", "3", "", 9)], "document_id string, block_id string, text string, start int")
    assert op.detected(df, ["document_id", "block_id"], "text").count() == 2
    assert op.detected(df.where("false"), ["block_id"], "text").count() == 0
    rows = {r.block_id: r for r in op.described(df.withColumnRenamed("text", "latex"), ["block_id"], "latex").collect()}
    assert rows["2"].sanity == 0.82 and rows["1"].left_side == "$x$ and y"
    schema = "document_id string, section_id string, kind string, id string, latex string"
    read = spark.createDataFrame([("d", "s", "inline_math", "r1", "a_1 = b"), ("d", "s", "inline_math", "r2", "a_1 = c"), ("d", "s", "inline_math", "r3", "zz"), ("d", "s", "display_math", "r4", "a_1 = b"), ("d", "s", "inline_math", "r5", None)], schema)
    tex = spark.createDataFrame([("d", "s", "inline_math", "t1", "a_1 = b"), ("d", "s", "inline_math", "t2", "a_1 = q")], schema)
    got = {r.read_id: r.tex_id for r in op.aligned(read, tex).collect()}
    assert got == {"r1": "t1", "r2": "t2"}
    assert op.aligned(read.where("false"), tex).count() == 0
    src = spark.createDataFrame([("p", "% no\n\\section{One} text $x$ more \\[ y \\] end"), ("q", None)], "paper string, tex string")
    assert [(r.kind, r.text) for r in op.tex_events(src, "paper", "tex").orderBy("pos").collect()] == [("section", "One"), ("text", "text"), ("inline", "x"), ("text", "more"), ("display", "y"), ("text", "end")]


@pytest.mark.parametrize("build, column", [(op.line_clusters, "line"), (op.proximity_groups, "group")])
def test_page_clusters(spark, build, column):
    box = lambda x, y: {"x0": float(x), "y0": float(y), "x1": float(x + 20), "y1": float(y + 10)}
    rows = [("d", 1, "a", box(0, 0)), ("d", 1, "b", box(40, 2)), ("d", 1, "c", box(0, 300)), ("d", 1, "n", None)]
    df = spark.createDataFrame(rows, "document_id string, page_number int, block_id string, bbox struct<x0: double, y0: double, x1: double, y1: double>")
    got = {r.block_id: r[column] for r in build(df, f"document_id string, page_number int, block_id string, {column} int").collect()}
    assert got["a"] == got["b"] != got["c"] and "n" not in got


def test_macros_and_tiny_mathematics():
    known = op.macros(r"\newcommand{\R}{\mathbb{R}} \def\eps{\varepsilon} \renewcommand\RR{\R^2}")
    assert known == {"\\R": "\\mathbb{R}", "\\eps": "\\varepsilon", "\\RR": "\\R^2"}
    assert op.expanded(r"\RR + \eps + \Rx", known) == r"\mathbb{R}^2 + \varepsilon + \Rx"
    assert op.expanded("\\a", {"\\a": "\\a x"}, 3).count("x") == 3
    assert op.inlined("the $x_1$ and $a = b$ of \\(n\\)") == "the x1 and $a = b$ of n"


def test_repairs(spark):
    from pyspark.sql import functions as F

    from papyrine.functions import latex

    rows = [("l i m x",), ("s  i n(x) ....... y",), ("\\\\alpha",), (None,), ("a \\\\ b = c",)]
    got = [r.x for r in spark.createDataFrame(rows, "latex string").select(latex.repaired(F.col("latex")).alias("x")).collect()]
    assert got == ["\\lim x", "\\sin(x) ... y", "\\alpha", None, "a \\\\ b = c"]
    assert [list(r.x) for r in spark.createDataFrame(rows[-1:], "latex string").select(latex.rows(F.col("latex")).alias("x")).collect()] == [["a", "b = c"]]


def test_fragments_and_matching():
    assert op.operands("a + b \\cdot c - (d + e)") == ["a", "b", "c", "(d + e)"] and op.operands("\\left( x \\right)") == ["( x )"]
    assert op.rows_of("\\begin{aligned} a = b \\\\ c = d \\end{aligned}") == ["a = b", "c = d"]
    assert op.fragments("y = a + b") == [("lhs", "", "lhs", "y"), ("rhs", "", "rhs", "a + b"), ("rhs.op_1", "rhs", "operand", "a"), ("rhs.op_2", "rhs", "operand", "b")]
    assert [f[0] for f in op.fragments("a = b \\\\ c")] == ["row_1", "row_1.lhs", "row_1.rhs", "row_2"] and op.fragments(None) == [] and op.fragments("x") == []
    assert op.match_key("\\mathbb{R} \\ni \\alpha_1 \\cup B") == "{r}alpha_1cupb"
    assert op.similarity("a_1 = b", "a_1 = b") == 1.0 and op.similarity("\\quad", "x") == 0.0
