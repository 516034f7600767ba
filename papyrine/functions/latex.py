"""Column functions over LaTeX. All are native expressions; null in, null out unless said otherwise."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions import notation
from papyrine.functions.notation import GREEK, SIGNS

#: Penalties of flags on a confidence; fixed values.
PENALTIES = {"contains_prose": 0.25, "weird_unicode": 0.2, "unbalanced_braces": 0.2, "unbalanced_delimiters": 0.2, "incomplete_formula": 0.25, "weak_math_signal": 0.15, "sum_missing_lower_bound": 0.2}


#: Pairs of math delimiters around a whole formula.
_WRAPPERS = [(r"\$\$", r"\$\$"), (r"\$", r"\$"), (r"\\\[", r"\\\]"), (r"\\\(", r"\\\)")]


def stripped(c: Column) -> Column:
    """Without math delimiters around it, however many; each layer is taken off as long as it matches at both ends.

    A layer takes two characters at least, so half as many rounds as the formula has characters are enough; they end as
    soon as nothing changes.
    """
    layer = lambda x: reduce(lambda y, w: F.regexp_replace(y, rf"(?s)^{w[0]}\s*(.*?)\s*{w[1]}$", "$1"), _WRAPPERS, F.trim(x))
    start = F.struct(c.alias("v"), F.lit(False).alias("done"))
    step = lambda a, _: F.when(a["done"], a).otherwise(F.struct(layer(a["v"]).alias("v"), (layer(a["v"]) == a["v"]).alias("done")))
    deep = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.length(c) / 2).cast("int"))), start, step, lambda a: a["v"])
    # Most formulas have no delimiter at all.
    return F.when(F.trim(c).rlike(r"^(\$|\\[\[(])"), F.trim(deep)).otherwise(F.trim(c))


def commands(c: Column) -> Column:
    """Unicode signs to commands, sizes dropped, one spelling for relations, text and limits."""
    for a, b in notation.FORMULA_SIGNS.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.regexp_replace(c, r"\\left\s*", "")
    c = F.regexp_replace(c, r"\\right\s*", "")
    for a, b in (("\\leq", "\\le"), ("\\geq", "\\ge"), ("\\neq", "\\ne")):
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.regexp_replace(c, r"\\mbox\s*\{([^{}]*)\}", r"\\text{$1}")
    return F.trim(F.regexp_replace(c, r"\\operatorname\*?\s*\{\s*l\s*i\s*m\s*\}", r"\\lim"))


def braced(c: Column) -> Column:
    """Braces around sub- and superscripts of one character; what has braces is never matched again, so once is enough."""
    return F.regexp_replace(c, r"(?<!\\)([A-Za-z0-9)\]])([\^_])([A-Za-z0-9])\b", "$1$2{$3}")


def from_text(c: Column) -> Column:
    """LaTeX of a formula as running text prints it: Greek letters and signs become commands, what follows some of them a
    subscript; a list point and a closing full stop are dropped."""
    c = F.trim(F.replace(F.regexp_replace(F.trim(c), r"\.+$", ""), F.lit("•"), F.lit("")))
    for a, b in {**GREEK, **SIGNS}.items():
        c = F.replace(c, F.lit(a), F.lit(f" {b} "))
    greek = "|".join(notation.SUBSCRIPTABLE)
    c = F.regexp_replace(c, r"\blim\b", r"\\lim")
    c = F.regexp_replace(c, r"(\\in)\s+R\s*([A-Za-z])\b", r"$1 \\mathbb{R}^{$2}")
    c = F.regexp_replace(c, rf"\\({greek})\s*([A-Za-z]?\d+)", r"\\$1_{$2}")
    c = F.regexp_replace(c, rf"\\({greek})\s*([A-Za-z]{{2}})(?=\b|\()", r"\\$1_{$2}")
    c = F.regexp_replace(c, rf"\\({greek})\s*([A-Za-z])\b", r"\\$1_{$2}")
    c = F.regexp_replace(c, r"\b([A-Za-z])(\d+)\b", r"$1_{$2}")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalized(c: Column) -> Column:
    """Delimiters off, commands and scripts in one spelling, white space single and none inside brackets."""
    c = F.regexp_replace(braced(commands(stripped(c))), r"\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"([(\[{])\s+", "$1"), r"\s+([)\]}])", "$1"))


def _alias(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in notation.ALIASES.items() for x in pair])
    plain = F.when(~F.lower(c).isin(notation.IGNORED_WORDS), c)
    return F.coalesce(F.try_element_at(known, c), F.try_element_at(known, F.lower(c)), F.nullif(plain, F.lit("")))


_STYLED = rf"^\\({'|'.join(notation.STYLES)})\{{([^{{}}]+)\}}$"
_ONE_LETTER = r"^\\?[A-Za-zα-ωΑ-Ω](_[A-Za-z0-9]+)?$"


def symbol(c: Column) -> Column:
    """One spelling of a symbol: no dollars around it, no white space or braces, Greek letters as commands, a style kept.

    Blank values, words that are no symbols, and styled ones of more than a letter become null.
    """
    c = F.regexp_replace(F.regexp_replace(F.trim(c), r"^\$+|\$+$", ""), r"\s+", "")
    inner = _alias(F.regexp_extract(c, _STYLED, 2))
    styled = F.when(inner.rlike(_ONE_LETTER), F.concat(F.lit("\\"), F.regexp_extract(c, _STYLED, 1), F.lit("{"), inner, F.lit("}")))
    return F.when(c.rlike(_STYLED), styled).otherwise(_alias(F.regexp_replace(c, r"[{}]", "")))


def holds_any(c: Column, values: list[str]) -> Column:
    return F.coalesce(reduce(or_, [F.contains(c, F.lit(v)) for v in values]), F.lit(False))


def operators(c: Column) -> Column:
    """Names of the operators that occur: those of whole commands, then those of characters, each once."""
    found = F.regexp_extract_all(c, F.lit(r"(\\[A-Za-z]+)"), 1)
    by_command = [F.when(F.array_contains(found, k), F.lit(v)) for k, v in notation.COMMAND_LABELS]
    return F.array_distinct(F.array_compact(F.array(*by_command, *[F.when(F.contains(c, F.lit(k)), F.lit(v)) for k, v in notation.SIGN_LABELS])))


def operator_tokens(c: Column) -> Column:
    """The operators themselves, commands first, in the order of their first occurrence."""
    found = F.filter(F.regexp_extract_all(c, F.lit(r"(\\[A-Za-z]+)"), 1), lambda x: F.substring(x, 2, 99).isin(notation.OPERATOR_COMMANDS))
    return F.array_distinct(F.concat(found, F.regexp_extract_all(c, F.lit(r"([=+\-*/^<>])"), 1)))


def is_variable(c: Column) -> Column:
    """Whether a normalised symbol can be a variable: no operator, no command of layout, no word."""
    bare = F.regexp_replace(c, r"^\\+", "")
    command = F.startswith(c, F.lit("\\"))
    no_command = command & bare.isin(notation.OPERATOR_COMMANDS + notation.IGNORED_COMMANDS)
    return ~(no_command | c.isin(list(notation.INFIX)) | F.lower(bare).isin(notation.IGNORED_WORDS) | F.lower(bare).isin([x.lower() for x in notation.OPERATOR_COMMANDS]))


def formula_symbols(c: Column) -> Column:
    """Normalised symbols of a formula: styled letters, commands, indexed letters, single letters; each once, in this order."""
    styles = "|".join(notation.STYLES)
    style_rx = rf"(\\(?:{styles})\s*\{{\s*[A-Za-zα-ωΑ-Ω]\s*\}})"
    styled = F.regexp_extract_all(c, F.lit(style_rx), 1)
    rest = F.regexp_replace(c, style_rx, " ")
    named = F.filter(F.regexp_extract_all(rest, F.lit(r"(\\[A-Za-z]+)"), 1), lambda x: ~F.substring(x, 2, 99).isin(notation.OPERATOR_COMMANDS + notation.IGNORED_COMMANDS))
    rest = F.regexp_replace(rest, r"\\[A-Za-z]+", " ")
    indexed_rx = r"(?<!\\)\b([A-Za-z]_\{?[A-Za-z0-9]+\}?)"
    indexed = F.regexp_extract_all(rest, F.lit(indexed_rx), 1)
    letters = F.regexp_extract_all(F.regexp_replace(rest, indexed_rx, " "), F.lit(r"(?<!\\)\b([A-Za-z])\b"), 1)
    return F.array_distinct(F.array_compact(F.transform(F.concat(styled, named, indexed, letters), symbol)))


def hints(c: Column, context: Column) -> Column:
    """What formula and context suggest: nine booleans."""
    near = F.lower(F.coalesce(context, F.lit("")))
    c = F.coalesce(c, F.lit(""))
    return F.struct(
        holds_any(near, notation.DEFINITION_MARKERS).alias("definition_like"), holds_any(near, notation.THEOREM_MARKERS).alias("theorem_like"),
        (holds_any(c, notation.OPTIMUM_COMMANDS) | holds_any(near, notation.OPTIMUM_MARKERS)).alias("optimization_like"), F.contains(c, F.lit("=")).alias("contains_equality"),
        c.rlike(r"<|>|\\leq?|\\geq?|\\lt|\\gt").alias("contains_inequality"), F.contains(c, F.lit("\\sum")).alias("contains_sum"), F.contains(c, F.lit("\\int")).alias("contains_integral"),
        F.contains(c, F.lit("\\frac")).alias("contains_fraction"), holds_any(c, notation.MATRIX_MARKERS).alias("contains_matrix"),
    )


def kind(c: Column, context: Column) -> Column:
    """First class that fits formula and context."""
    c = F.coalesce(c, F.lit(""))
    t = F.lower(F.concat(c, F.lit(" "), F.coalesce(context, F.lit(""))))
    out = F
    for name, held in notation.CLASSES:
        out = out.when(holds_any(c if held == ["="] else t, held), name)
    return out.otherwise("mathematical_expression")


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of the words of two formulas."""
    wa, wb = (F.array_distinct(F.regexp_extract_all(x, F.lit(r"(\\[A-Za-z]+|[A-Za-z0-9]+)"), 1)) for x in (a, b))
    n = F.size(F.array_union(wa, wb))
    return F.when(n > 0, F.size(F.array_intersect(wa, wb)) / n).otherwise(F.lit(0.0))


def flags(c: Column) -> Column:
    """What is wrong with a formula."""
    opened, closed = F.regexp_count(c, F.lit(r"\{")), F.regexp_count(c, F.lit(r"\}"))
    left, right = F.regexp_count(c, F.lit(r"\(")), F.regexp_count(c, F.lit(r"\)"))
    signal = F.regexp_count(c, F.lit(r"[=<>+^_]|\\[A-Za-z]+"))
    return F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim(c), F.lit("")) == "", "latex_missing"), F.when(opened != closed, "unbalanced_braces"), F.when(left != right, "unbalanced_delimiters"),
            F.when(F.trim(c).rlike(r"[=+<>]$"), "incomplete_formula"), F.when(F.length(c) > 700, "very_long_formula"), F.when(signal < 1, "weak_math_signal"),
        )
    )


def adjusted(confidence: Column, found: Column) -> Column:
    """Confidence less the penalties of the flags, 0.1 at least."""
    p = F.lit(0.0)
    for k, v in PENALTIES.items():
        p = p + F.when(F.array_contains(found, k), F.lit(v)).otherwise(F.lit(0.0))
    return F.when(confidence.isNotNull(), F.greatest(F.lit(0.1), F.round(confidence - p, 3)))


def quality(confidence: Column, sanity: Column, warnings: Column) -> Column:
    """Score of a recognised formula and its status."""
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.7 * F.coalesce(confidence, F.lit(0.0)) + 0.3 * sanity - 0.05 * warnings))
    return F.struct(F.round(score, 6).alias("score"), F.when(score >= 0.7, "ok").when(score >= 0.35, "partial").otherwise("failed").alias("status"))


def rank(n_symbols: Column, n_operators: Column, definition: Column, equality: Column, confidence: Column) -> Column:
    return 2 * n_symbols + n_operators + 3 * definition.cast("int") + 2 * equality.cast("int") + F.coalesce(confidence, F.lit(0.0))


def sanity(c: Column) -> Column:
    """(valid, warnings, score) of a formula's LaTeX; a closing bracket before its opening one counts as unbalanced."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"\\.", "")

    def unbalanced(left: str, right: str) -> Column:
        marks = F.regexp_extract_all(bare, F.lit(rf"([\{left}\{right}])"), 1)
        start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("bad"))
        step = lambda a, m: F.struct((a["n"] + F.when(m == left, 1).otherwise(-1)).alias("n"), (a["bad"] | ((m == right) & (a["n"] <= 0))).alias("bad"))
        return F.aggregate(marks, start, step, lambda a: a["bad"] | (a["n"] != 0))

    value = F.coalesce(c, F.lit(""))
    warnings = F.array_compact(F.array(
        F.when(F.trim(value) == "", "empty_latex"), F.when(unbalanced("{", "}"), "unbalanced_braces"), F.when(unbalanced("(", ")"), "unbalanced_parentheses"),
        F.when(F.contains(value, F.lit("\ufffd")), "replacement_symbol"), F.when(~value.rlike(r"\\[A-Za-z]+|[=<>_^]|\d|[\x{0370}-\x{03ff}]"), "weak_math_signal"),
    ))
    valid = ~F.arrays_overlap(warnings, F.array(F.lit("empty_latex"), F.lit("unbalanced_braces")))
    return F.struct(valid.alias("valid"), warnings.alias("warnings"), F.round(F.greatest(F.lit(0.0), 1.0 - 0.18 * F.size(warnings)), 2).alias("score"))


def structure_score(c: Column) -> Column:
    """How much structure a formula has: fractions, sums and scripts count for it, stray signs and long words against."""
    n = lambda *x: reduce(add, [F.regexp_count(c, F.lit(y)) for y in x])
    score = 4 * n(r"\\frac", r"\\lim", r"\\sum", r"\\int", r"\\sqrt") + 3 * n(r"\\cdots") + 2 * n("_", r"\^", r"\\to", r"\\infty", r"\\circ", r"\\cdot", r"\\cup", r"\\cap") + n("=")
    return (score - 3 * n(r"\\therefore") - 4 * n(r"_\{[^{}]+\}\s*-\s*\d") - n(r"[A-Za-z]{8,}")).cast("long")


def prose_words(c: Column) -> Column:
    """Number of words of four letters and more outside commands that are no names of functions."""
    words = F.regexp_extract_all(F.regexp_replace(c, r"\\[A-Za-z]+", " "), F.lit(r"([A-Za-z]{4,})"), 1)
    return F.size(F.filter(words, lambda w: ~F.lower(w).isin(notation.MATH_WORDS))).cast("long")


def math_signals(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\\[A-Za-z]+|[=<>_^]|\d|[\x{0370}-\x{03ff}]")).cast("long")


#: Names that recognisers set apart letter by letter, and how they are written; fixed values.
SPACED_NAMES = {"lim": "\\lim", "sin": "\\sin", "cos": "\\cos", "log": "\\log", "max": "\\max", "min": "\\min"}


def repaired(c: Column) -> Column:
    """Function names set apart are closed up, doubled backslashes before letters halved, runs of dots and blanks shortened."""
    for name, command in SPACED_NAMES.items():
        c = F.regexp_replace(c, r"(^|[^A-Za-z\\])" + r"\s+".join(name) + r"([^A-Za-z]|$)", "$1\\\\" + command.lstrip("\\") + "$2")
    c = F.regexp_replace(c, r"\\\\([A-Za-z])", r"\\$1")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\.{4,}", "..."), r"[ \t]+", " "))


def rows(c: Column) -> Column:
    """Rows of a recognised formula, empty ones dropped."""
    return F.filter(F.transform(F.split(c, r"\\\\(?![A-Za-z])"), lambda x: F.trim(x)), lambda x: x != "")


def prose_like(c: Column) -> Column:
    """Three words of four letters or more outside commands, and fewer than five marks of mathematics."""
    plain = F.regexp_replace(c, r"\\[A-Za-z]+", " ")
    return (F.regexp_count(plain, F.lit(r"\p{L}{4,}")) >= 3) & (F.regexp_count(c, F.lit(r"[=<>+^_\\]")) < 5)
