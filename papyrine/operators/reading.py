"""Formulas read as plain text and interpreted with the definitions near them.

Defined results: null LaTeX reads as nothing; commands without a reading of their own read as their name; an interpretation
without variables or definitions says only what there is.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions import latex

#: Readings of commands that read otherwise than they are named; fixed values.
COMMANDS = {
    "varepsilon": "epsilon", "vartheta": "theta", "varrho": "rho", "varsigma": "sigma", "varphi": "phi", "Gamma": "capital gamma", "Delta": "capital delta", "Theta": "capital theta",
    "Lambda": "capital lambda", "Xi": "capital xi", "Pi": "capital pi", "Sigma": "capital sigma", "Phi": "capital phi", "Psi": "capital psi", "Omega": "capital omega", "prod": "product",
    "coprod": "coproduct", "int": "integral", "iint": "double integral", "iiint": "triple integral", "oint": "contour integral", "lim": "limit", "limsup": "limit superior",
    "liminf": "limit inferior", "sup": "supremum", "inf": "infimum", "min": "minimum", "max": "maximum", "argmin": "arg minimum", "argmax": "arg maximum", "sin": "sine", "cos": "cosine",
    "tan": "tangent", "cot": "cotangent", "sec": "secant", "csc": "cosecant", "arcsin": "arcsine", "arccos": "arccosine", "arctan": "arctangent", "sinh": "hyperbolic sine",
    "cosh": "hyperbolic cosine", "tanh": "hyperbolic tangent", "log": "logarithm", "ln": "natural logarithm", "lg": "logarithm", "exp": "exponential", "det": "determinant",
    "dim": "dimension", "ker": "kernel", "deg": "degree", "gcd": "greatest common divisor", "Pr": "probability", "forall": "for all", "exists": "there exists",
    "nexists": "there does not exist", "notin": "not in", "ni": "contains", "subseteq": "subset or equal", "supset": "superset", "supseteq": "superset or equal", "cup": "union",
    "cap": "intersection", "setminus": "set difference", "emptyset": "empty set", "varnothing": "empty set", "land": "and", "lor": "or", "neg": "not", "Rightarrow": "implies",
    "Leftarrow": "is implied by", "Leftrightarrow": "if and only if", "mapsto": "maps to", "rightarrow": "to", "leftarrow": "from", "uparrow": "up", "downarrow": "down",
    "le": "less than or equal to", "ge": "greater than or equal to", "lt": "less than", "gt": "greater than", "ne": "not equal to", "approx": "approximately equal to", "sim": "similar to",
    "simeq": "similar or equal to", "equiv": "equivalent to", "cong": "congruent to", "propto": "proportional to", "pm": "plus or minus", "mp": "minus or plus", "cdot": "times",
    "div": "divided by", "ast": "asterisk", "circ": "composition", "oplus": "direct sum", "otimes": "tensor product", "grad": "gradient", "infty": "infinity", "ldots": "dots",
    "cdots": "dots", "vdots": "vertical dots", "ddots": "diagonal dots",
}
#: Readings of signs; fixed values.
SIGNS = {
    "=": "equals", "+": "plus", "-": "minus", "*": "times", "/": "divided by", "<": "less than", ">": "greater than", "≤": "less than or equal to", "≥": "greater than or equal to", "≠": "not equal to",
    "≈": "approximately equal to", "∈": "in", "∉": "not in", "⊂": "subset", "⊆": "subset or equal", "∪": "union", "∩": "intersection", "→": "to", "←": "from", "↔": "if and only if", "∞": "infinity",
}
_STRUCTURE = [
    (r"\\operatorname\*?\{([^{}]+)\}", lambda m: m.group(1).strip()), (r"\\(?:mathrm|mathit|mathbf|mathsf|mathtt|text)\{([^{}]*)\}", lambda m: m.group(1).strip()), (r"\\frac\{([^{}]+)\}\{([^{}]+)\}", r"\1 divided by \2"),
    (r"\\sqrt\[(.*?)\]\{([^{}]+)\}", r"\1 root of \2"), (r"\\sqrt\{([^{}]+)\}", r"square root of \1"), (r"_\{([^{}]+)\}", r" subscript \1"), (r"\^\{2\}", " squared"), (r"\^\{3\}", " cubed"), (r"\^\{([^{}]+)\}", r" to the power of \1"),
    (r"_(\w+)", r" subscript \1"), (r"\^(\w+)", r" to the power of \1"), (r"\\begin\{([^{}]+)\}", r"begin \1"), (r"\\end\{([^{}]+)\}", r"end \1"), (r"\\left|\\right", ""),
]


def plain(x: str) -> str:
    """A normalised formula in words: structure first, then signs, then commands."""
    for pattern, to in _STRUCTURE:
        x = re.sub(pattern, to, x)
    for sign, word in SIGNS.items():
        x = x.replace(sign, f" {word} ")
    x = re.sub(r"\\([A-Za-z]+)\*?", lambda m: f" {COMMANDS.get(m.group(1), m.group(1))} ", x)
    x = re.sub(r"([()\[\],;|])", r" \1 ", re.sub(r"[{}]", " ", x))
    return re.sub(r"\s+", " ", x).strip()


def confidence(c: Column, context: Column, defined: Column) -> Column:
    """Confidence of an interpretation: more with LaTeX, context, definitions and structure, 0.95 at most."""
    c = F.coalesce(c, F.lit(""))
    plus = lambda k, n: F.when(k, n).otherwise(0)  # noqa: E731  in hundredths, so that sums are exact
    structure = latex.holds_any(c, ["=", "\\sum", "\\prod", "\\int", "\\lim", "\\frac", "\\sqrt", "\\cup", "\\cap", "\\to"])
    score = 55 + plus(c != "", 15) + plus(F.coalesce(context, F.lit("")) != "", 10) + plus(defined, 15) + plus(structure, 5)
    return F.least(F.lit(95), score) / 100.0


def summary(kind: Column, text: Column, variables: Column, definitions: Column) -> Column:
    """What a formula is, in a sentence each: its kind, reading, variables, and definitions (an array of symbol and definition)."""
    said = F.transform(definitions, lambda d: F.concat(d["symbol"], F.lit(" means "), d["definition"]))
    return F.concat_ws(
        " ", F.concat(F.lit("Formula type: "), kind, F.lit(".")), F.when(text != "", F.concat(F.lit("Readable form: "), text, F.lit("."))),
        F.when(F.size(variables) > 0, F.concat(F.lit("Variables: "), F.array_join(variables, ", "), F.lit("."))), F.when(F.size(said) > 0, F.concat(F.lit("Definitions near formula: "), F.array_join(said, "; "), F.lit("."))),
    )
