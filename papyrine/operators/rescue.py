"""Recognised formulas put right by the text layer of their page: replaced by a line that reads better, or given the
definition that a line beside them states.

formulas have document_id, page_number, formula_id, latex, text_source, flags (array), confidence and bbox; lines have
document_id, page_number, line_id, text and bbox. Formulas and lines of a page meet by bands of its height, so that only
what is near is compared; each formula takes the best line; of equals, the one whose text is larger.

Defined results: formulas without a box or without a severe flag, and those of a TeX source, come out as they are; lines
without text or box take no part; empty tables give empty results.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.operators import cleaning

#: Flags that make a recognised formula doubtful; fixed values.
SEVERE = ["contains_prose", "romanized_ocr_noise", "raw_ocr_contains_prose", "raw_ocr_romanized_ocr_noise", "very_long_formula"]
#: How far a line may be: gap in height, distance of centres; the score that replaces; fixed values.
GAP, CENTRE, LEAST = 70.0, 280.0, 1.1
NEAR_GAP, NEAR_CENTRE = 22.0, 180.0
_CYRILLIC = re.compile("[А-Яа-яЁё]")
#: Spellings of the heads of definitions in Cyrillic texts; fixed values.
HEADS = {"\\rho": "rho", "\\mu": "mu", "\\phi": "phi", "\\Phi": "phi", "\\psi": "psi", "\\Gamma": "gamma", "\\Delta": "delta", "\\varphi": "phi"}


def _bands(df: DataFrame, reach: float) -> DataFrame:
    """df with a row for each band of the page's height that its box, widened by ``reach``, touches."""
    low, high = F.floor((F.col("bbox.y0") - reach) / 200), F.floor((F.col("bbox.y1") + reach) / 200)
    return df.withColumn("_band", F.explode(F.sequence(low, F.greatest(low, high))))


def _gap(a: str, b: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(f"{a}.y0") - F.col(f"{b}.y1"), F.col(f"{b}.y0") - F.col(f"{a}.y1"))


def _across(a: str, b: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.col(f"{a}.x1"), F.col(f"{b}.x1")) - F.greatest(F.col(f"{a}.x0"), F.col(f"{b}.x0")))


def _centre(a: str, b: str) -> Column:
    return F.abs((F.col(f"{a}.x0") + F.col(f"{a}.x1")) / 2 - (F.col(f"{b}.x0") + F.col(f"{b}.x1")) / 2)


def _met(formulas: DataFrame, lines: DataFrame, reach: float) -> DataFrame:
    """Pairs of formulas (box f) and lines (box b) of one page that are near in height, each once."""
    f = _bands(formulas.where("bbox is not null"), reach).withColumnRenamed("bbox", "f")
    b = _bands(lines.where("bbox is not null and text is not null"), 0.0).select("document_id", "page_number", "_band", "line_id", F.col("text").alias("line"), F.col("bbox").alias("b"))
    return f.join(b, ["document_id", "page_number", "_band"]).where(_gap("f", "b") <= reach).drop("_band").distinct()


def line_latex(text: str) -> str | None:
    """LaTeX of a line that is a formula by itself, None if it is none or holds prose."""
    from papyrine.functions import notation

    x = " ".join(text.split())
    if not cleaning.standalone(x):
        return None
    for sign, command in {**notation.GREEK, **notation.SIGNS}.items():
        x = x.replace(sign, f" {command} ")
    x = cleaning.repaired(re.sub(r"\s+", " ", x).strip().rstrip("."))
    return None if {"contains_prose", "weak_math_signal"} & set(cleaning.flags(x)) else x


def reconciled(formulas: DataFrame, lines: DataFrame) -> DataFrame:
    """(document_id, page_number, formula_id, latex, text_source, confidence, outcome): doubtful formulas of visual
    recognisers take the best line near them (``replaced``), vanish if they are prose, or stay (``kept``)."""
    visual = F.startswith("text_source", F.lit("pp_")) | F.startswith("text_source", F.lit("paddle")) | F.endswith("text_source", F.lit("_raw"))
    severe = F.arrays_overlap(F.coalesce("flags", F.array().cast("array<string>")), F.array(*[F.lit(x) for x in SEVERE]))
    x = formulas.withColumn("doubtful", F.coalesce(visual & severe, F.lit(False)))
    read = cleaning.applied(lines.where("text is not null"), ["document_id", "page_number", "line_id"], "text", {"latex_line": (line_latex, "string")}).where("latex_line is not null")
    candidates = lines.join(read, ["document_id", "page_number", "line_id"])
    met = _met(x.where("doubtful"), candidates, GAP).join(read.select("document_id", "page_number", "line_id", "latex_line"), ["document_id", "page_number", "line_id"])
    width = F.greatest(F.lit(1.0), F.least(F.col("f.x1") - F.col("f.x0"), F.col("b.x1") - F.col("b.x0")))
    near = 1.4 * _across("f", "b") / width + F.greatest(F.lit(0.0), 1.0 - _gap("f", "b") / GAP) + F.greatest(F.lit(0.0), 0.6 - _centre("f", "b") / 500.0)
    marks = F.least(F.lit(1.2), 0.18 * F.regexp_count("latex_line", F.lit(r"\\[A-Za-z]+")) + 0.25 * F.regexp_count("latex_line", F.lit(r"=|\\in|\\cup|\\le|\\ge|\\to|<|>")))
    scored = met.withColumn("score", F.when(_centre("f", "b") > CENTRE, F.lit(0.0)).otherwise(near) + marks).where(F.col("score") >= LEAST)
    key = ["document_id", "formula_id"]
    best = scored.groupBy(*key).agg(F.max(F.struct("score", F.col("latex_line").alias("found"))).alias("r")).select(*key, F.col("r.found").alias("found"))
    prose = cleaning.applied(x.where("doubtful"), key, "latex", {"prose": (lambda v: len([w for w in re.findall(r"[A-Za-z]{4,}", re.sub(r"\\[A-Za-z]+", " ", v)) if w.lower() not in cleaning.notation.MATH_WORDS]) >= 3 and cleaning.holds_prose(v), "boolean")})
    j = x.join(best, key, "left").join(prose, key, "left")
    outcome = F.when(~F.col("doubtful"), "kept").when(F.col("found").isNotNull(), "replaced").when(F.coalesce("prose", F.lit(False)), "dropped").otherwise("kept")
    j = j.withColumn("outcome", outcome).where("outcome <> 'dropped'")
    new = F.col("outcome") == "replaced"
    return j.select("document_id", "page_number", "formula_id", F.when(new, F.col("found")).otherwise(F.col("latex")).alias("latex"), F.when(new, "text_pattern").otherwise(F.col("text_source")).alias("text_source"), F.when(new, F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.62))).otherwise(F.col("confidence")).alias("confidence"), "outcome")


def head(latex: str) -> str | None:
    """What a formula defines: a short symbol before a dash, a comma or text."""
    x = cleaning.repaired(latex)
    for chunk in [*re.findall(r"\$([^$]{1,120})\$", x), x]:
        for mark in ("\\mathrm{", "\\text{", ",", ";"):
            at = chunk.find(mark)
            if at > 0:
                chunk = chunk[:at]
                break
        chunk = re.split(r"\s*-\s*", chunk.strip(), maxsplit=1)[0].strip().rstrip("~\\-").strip("$ ")
        if chunk and len(chunk) <= 32 and " " not in chunk and "$" not in chunk and not re.search(r"[A-Za-z]{3,}", re.sub(r"\\[A-Za-z]+", "", chunk)) and re.search(r"\\[A-Za-z]+|[=<>_^]|\d|[\u0370-\u03ff]", chunk):
            return chunk
    return None


def _key(x: str) -> str:
    return re.sub(r"[^a-zа-я0-9]+", "", re.sub(r"^\s*(?:здесь|где)\s+", "", x.lower().replace("ё", "е")))


def spellings(symbol: str) -> set[str]:
    """How a line may spell the head of a definition."""
    for command, name in HEADS.items():
        symbol = symbol.replace(command, name)
    base = _key(re.sub(r"\\[A-Za-z]+", "", symbol))
    out = {base}
    if base.startswith("rho"):
        out.add("r" + base[3:])
    if base.startswith("mu"):
        out |= {"m" + base[2:], base[2:] + "m", base[2:]}
    for a, b in (("ui", "iu"), ("qx", "xq"), ("qy", "yq"), ("qz", "zq")):
        if base.startswith(a):
            out.add(b)
    if "eff" in base:
        out |= {"effm", "meff"}
    return {x for x in out if x}


def _same(lhs: str, names: set[str]) -> bool:
    k = _key(lhs)
    return bool(k) and any(k in n or n in k or len(k) <= 3 and len(n) <= 3 and sorted(k) == sorted(n) for n in names)


def stated(line: str) -> list[tuple[str, str]]:
    """(symbol, meaning) of the definitions that a line states with dashes, between commas."""
    parts = [re.match(r"(.+?)\s*[–—-]\s*(.+)", p.strip()) for p in re.split(r",\s*", re.sub(r"^\s*(?:Здесь|где)\s+", "", line, flags=re.I))]
    return [(m.group(1).strip(), m.group(2).strip()) for m in parts if m]


def meaning(symbol: str, line: str) -> str | None:
    """What a Cyrillic line says the symbol is: the definition with its spelling, or the only one there is."""
    found = stated(line)
    out = next((r for lhs, r in found if _same(lhs, spellings(symbol))), found[0][1] if len(found) == 1 else None)
    out = out.rstrip(",;:.").strip() if out else None
    return out if out and _CYRILLIC.search(out) else None


def rescued(formulas: DataFrame, lines: DataFrame) -> DataFrame:
    """(document_id, formula_id, latex): doubtful definitions written anew with what the best line beside them says."""
    key = ["document_id", "formula_id"]
    bad = F.arrays_overlap(F.coalesce("flags", F.array().cast("array<string>")), F.array(*[F.lit(x) for x in ("contains_prose", "romanized_ocr_noise", "needs_formula_review")]))
    own = formulas.where(bad & ~F.startswith(F.coalesce("text_source", F.lit("")), F.lit("tex_source")))
    heads = cleaning.applied(own, key, "latex", {"symbol": (head, "string")}).where("symbol is not null")
    met = _met(own.join(heads, key), lines.where("text rlike '[А-Яа-яЁё]'"), NEAR_GAP).where((_across("f", "b") > 0) | (_centre("f", "b") <= NEAR_CENTRE))
    both = met.withColumn("_both", F.concat("symbol", F.lit("\x01"), "line"))
    split = lambda v: v.split("\x01", 1)
    judged = cleaning.applied(both, [*key, "symbol", "line_id", "f", "b"], "_both", {"told": (lambda v: bool(stated(split(v)[1])), "boolean"), "named": (lambda v: any(_same(lhs, spellings(split(v)[0])) for lhs, _ in stated(split(v)[1])), "boolean"), "meaning": (lambda v: meaning(*split(v)), "string")})
    score = F.when(F.col("named"), 4.0).otherwise(0.0) + 0.01 * _across("f", "b") - 0.2 * _gap("f", "b")
    best = judged.where("told").groupBy(*key).agg(F.max(F.struct(score.alias("s"), "symbol", "meaning")).alias("r"))
    made = best.where("r.s > -1 and r.meaning is not null").select(*key, F.concat(F.col("r.symbol"), F.lit(" - \\text{"), F.regexp_replace(F.col("r.meaning"), r"([{}])", r"\\$1"), F.lit("}")).alias("new"))
    return formulas.join(made, key, "left").select(*key, F.coalesce("new", "latex").alias("latex"))
