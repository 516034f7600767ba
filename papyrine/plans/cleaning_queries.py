"""Cleaning and checks of texts and formulas over whole tables; without SQL, held against values written down by hand."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyrine.functions import latex
from papyrine.operators import cleaning as op
from papyrine.operators import formulas, tex
from papyrine.plans.base import current
from papyrine.sources.tables import table

QUERIES, SQL = {}, {}


def query(name: str):
    def add(f):
        QUERIES[name] = f
        return f

    return add


@query("text_cleaned")
def _(s, d):
    """Texts of documents cleaned, and decoded anew where a wrong code page was used."""
    return op.applied(table(s, d, "documents", "doc_id", "text"), ["doc_id"], "text", {"clean": (op.cleaned, "string"), "decoded": (op.decoded, "string")})


@query("text_normalized_blocks")
def _(s, d):
    """Texts of blocks, those that stay blank left out."""
    return op.applied(current(s, d, "layers", "text"), ["document_id", "block_id"], "text", {"clean": (op.block, "string")}).where("clean <> ''")


@query("text_normalized_lines")
def _(s, d):
    """Lines of blocks with their place, those that stay blank left out."""
    lines = table(s, d, "text_blocks", "document_id", "block_id", "text_lines").select("document_id", "block_id", F.posexplode("text_lines").alias("line_pos", "l")).select("document_id", "block_id", "line_pos", F.col("l.text").alias("text"))
    return op.applied(lines.distinct(), ["document_id", "block_id", "line_pos"], "text", {"clean": (op.line, "string")}).where("clean <> ''")


@query("text_tex_paragraphs")
def _(s, d):
    """Prose of TeX blocks, paragraphs that say nothing left out."""
    x = current(s, d, "layers", "text", "text_source").where("text_source = 'tex_source' and text is not null").select("document_id", "block_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("pos", "paragraph"))
    return op.applied(x, ["document_id", "block_id", "pos"], "paragraph", {"prose": (op.tex_prose, "string"), "meaningful": (lambda v: op.meaningful(op.tex_prose(v)), "boolean")}).where("meaningful").drop("meaningful")


@query("latex_normalized_formulas")
def _(s, d):
    """Formulas cleaned, repaired and normalised, with their flags and the confidence that is left."""
    f = current(s, d, "formulas", "latex", "confidence")
    x = op.applied(f, ["document_id", "formula_id", "confidence"], "latex", {"cleaned": (op.latex, "string"), "repaired": (lambda v: op.repaired(op.latex(v)), "string"), "flags": (lambda v: op.flags(op.repaired(op.latex(v))), "array<string>")})
    x = x.withColumn("normalized", latex.normalized(F.col("repaired"))).withColumn("sanity", latex.sanity(F.col("normalized"))["warnings"])
    changed = F.array_compact(F.array(F.when(F.col("repaired") != F.col("cleaned"), "repaired_latex")))
    every = F.concat("flags", F.transform("sanity", lambda w: F.concat(F.lit("latex_"), w)), changed)
    return x.select("document_id", "formula_id", "cleaned", "repaired", "normalized", F.array_join(every, "|").alias("flags"), latex.adjusted(F.col("confidence"), every).alias("confidence"))


@query("latex_standalone_lines")
def _(s, d):
    """Lines of blocks that are formulas by themselves, as LaTeX."""
    lines = current(s, d, "layers", "text").select("document_id", "block_id", F.posexplode(F.split("text", "\n")).alias("line_pos", "line"))
    x = op.applied(lines, ["document_id", "block_id", "line_pos"], "line", {"line": (str.strip, "string"), "formula": (op.standalone, "boolean")}).where("formula")
    return x.select("document_id", "block_id", "line_pos", latex.from_text(F.col("line")).alias("latex"))


@query("tex_documents")
def _(s, d):
    """Sections, paragraphs and formulas of TeX blocks, with formula tokens in place."""
    return tex.documents(current(s, d, "layers", "text", "text_source").where("text_source = 'tex_source'"), ["document_id", "block_id"], "text")


@query("latex_usable_formulas")
def _(s, d):
    """Formulas that can be kept, by shape; others keep their LaTeX under a raw source, with a confidence of 0.45 at most and a flag."""
    f = current(s, d, "formulas", "latex", "text_source", "confidence").where("coalesce(trim(latex), '') <> ''")
    x = op.applied(f, ["document_id", "formula_id", "text_source", "confidence"], "latex", {"usable": (lambda v: op.usable(" ".join(v.strip().strip("$").split())), "boolean"), "shape": (op.shape, "string"), "salvaged": (op.salvaged, "string")})
    return x.select("document_id", "formula_id", "usable", "shape", "salvaged", F.when(F.col("usable"), F.col("text_source")).otherwise(F.concat(F.coalesce("text_source", F.lit("unknown")), F.lit("_raw"))).alias("source"), F.when(F.col("usable") | F.col("confidence").isNull(), F.col("confidence")).otherwise(F.least("confidence", F.lit(0.45))).alias("confidence"), F.when(~F.col("usable"), "needs_formula_review").alias("flag"))


#: Confidence of the stages of detection; fixed values.
STAGES = {"block": 0.82, "inline": 0.78, "prose": 0.72, "cross_block": 0.68, "line": 0.58}


@query("latex_detected")
def _(s, d):
    """Formulas of blocks by every stage: displayed, inline, in prose, across up to four blocks of a page, whole lines; each formula of a block once, by its first stage."""
    b = current(s, d, "blocks", "text", "page_number", "ord").where("text is not null")
    own = formulas.detected(b, ["document_id", "block_id"], "text").select("document_id", "block_id", "stage", "latex")
    lines = op.applied(b.select("document_id", "block_id", F.explode(F.split("text", "\n")).alias("line")), ["document_id", "block_id"], "line", {"line": (str.strip, "string"), "formula": (op.standalone, "boolean")}).where("formula")
    line = lines.select("document_id", "block_id", F.lit("line").alias("stage"), latex.from_text(F.col("line")).alias("latex"))
    w = Window.partitionBy("document_id", "page_number").orderBy("ord", "block_id").rowsBetween(0, 3)
    near = b.select("document_id", "block_id", F.array_join(F.collect_list("text").over(w), " ").alias("joined"))  # four blocks at most
    cross = formulas.detected(near, ["document_id", "block_id"], "joined").where("stage = 'prose'").select("document_id", "block_id", F.lit("cross_block").alias("stage"), "latex")
    key = F.lower(F.regexp_replace("latex", r"\s+", ""))
    place = F.create_map(*[F.lit(x) for i, k in enumerate(STAGES) for x in (k, i)])
    every = own.unionByName(line).unionByName(cross).where("latex <> ''").withColumn("k", key)
    # What a block of the same page has by itself is no find across blocks.
    page = b.select("document_id", "block_id", "page_number")
    single = own.join(page, ["document_id", "block_id"]).select("document_id", "page_number", key.alias("k")).distinct()
    across = every.where("stage = 'cross_block'").join(page, ["document_id", "block_id"]).join(single, ["document_id", "page_number", "k"], "left_anti").drop("page_number")
    first = every.where("stage <> 'cross_block'").unionByName(across.select(*every.columns)).groupBy("document_id", "block_id", "k").agg(F.min(F.struct(place[F.col("stage")].alias("p"), "latex", "stage")).alias("r"))
    score = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])
    return first.select("document_id", "block_id", F.col("r.latex").alias("latex"), F.col("r.stage").alias("stage"), score[F.col("r.stage")].alias("confidence"))
