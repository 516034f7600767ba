"""Column functions over running text. All are native expressions; null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions.notation import DEFINITION_MARKERS, SECTION_TITLES

#: Formula token in running text; a fixed format.
TOKEN = r"\[FORMULA_([0-9]+)\]"
#: Symbols printed otherwise than they are meant; fixed values.
ARTIFACTS = {"\u00ad": "", "\ufb01": "fi", "\ufb02": "fl", "\u2212": "-", "\u2013": "-", "\u2014": "-", "\u2217": "*"}
#: Characters of text decoded with the wrong code page; fixed values.
MOJIBAKE = "ÃÂâÏÎÐÑ"


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def collapse(c: Column) -> Column:
    """White space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def clip(c: Column, n: int) -> Column:
    """At most n characters, with three dots where something was cut off."""
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n)), F.lit("..."))).otherwise(c)


def token_window(text: Column, token: Column, radius: int = 260) -> Column:
    """Text around the first occurrence of a token; null where there is none."""
    at = F.call_function("locate", token, text)
    start = F.greatest(F.lit(1), at - radius)
    return F.when(at > 0, F.substring(text, start, F.length(token) + radius + at - start))


def sentences(c: Column) -> Column:
    """Runs up to closing marks, empty ones dropped."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"([^.!?。！？]+[.!?。！？]*)"), 1), lambda x: F.trim(x)), lambda x: x != "")


def tokens(c: Column) -> Column:
    """Distinct formula tokens in the order of their first occurrence."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\[FORMULA_[0-9]+\])"), 1))


def markers(c: Column) -> Column:
    """Definition markers that occur in the text, in the order of the table."""
    low = F.lower(c)
    return F.filter(F.array(*[F.lit(m) for m in DEFINITION_MARKERS]), lambda m: F.contains(low, m))


def references(c: Column) -> Column:
    """Distinct numbers in parentheses, as equations are referred to."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\(([0-9]{1,4}[a-zA-Z]?)\)"), 1))


def section_level(title: Column) -> Column:
    """Level that a numbered title says: one more than the dots inside its number, six at most, one without number."""
    number = F.regexp_extract(F.trim(title), r"^([0-9]+(?:\.[0-9]+)*)", 1)
    return F.when(number == "", 1).otherwise(F.least(F.lit(6), F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1)).cast("int")


def is_heading(c: Column, block_type: Column) -> Column:
    """Short, and typed as a heading, or numbered or named like one unless it is title, author or abstract."""
    c = F.trim(c)
    named = c.rlike(r"(?iu)^\s*(?:\d+(?:\.\d+)*\.?\s+)?(?:" + "|".join(SECTION_TITLES) + r")(?![\p{L}\p{N}_])")
    fits = F.coalesce(block_type == "heading", F.lit(False)) | ~F.coalesce(block_type.isin("title", "author", "abstract"), F.lit(False)) & (c.rlike(r"^[0-9]+(\.[0-9]+)*\.?\s+\S+") | named)
    return (c != "") & (F.length(c) <= 180) & fits


def block_type(role: Column, c: Column) -> Column:
    """Type of a block by its role, else by its text: short and all in capitals is a heading, blank is unknown."""
    role, c = F.lower(F.coalesce(role, F.lit(""))), F.trim(F.coalesce(c, F.lit("")))
    shout = (F.length(c) < 120) & (F.upper(c) == c) & (F.lower(c) != c)
    return (
        F.when(role.isin("section", "subsection", "subsubsection", "chapter", "part"), "heading")
        .when(role.isin("title", "author", "abstract", "heading", "paragraph", "caption", "list_item", "footer"), role)
        .when(shout, "heading").when(c != "", "paragraph").otherwise("unknown")
    )


def layer_assessment(c: Column) -> Column:
    """(quality, score, char_count, warnings, allow_ocr_fallback) of a text layer."""
    c = F.coalesce(c, F.lit(""))
    n = F.length(F.regexp_replace(c, r"^\s+|\s+$", ""))
    blanks = F.when(F.length(c) > 0, F.regexp_count(c, F.lit(r"\s")) / F.length(c)).otherwise(F.lit(1.0))
    warnings = F.array_compact(F.array(
        F.when(n == 0, "text_layer_missing"), F.when(F.contains(c, F.lit("\ufffd")), "replacement_symbols_present"), F.when(c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), "control_symbols_present"),
        F.when((n > 0) & (F.regexp_count(c, F.lit(LETTER)) / F.greatest(F.lit(1), n) < 0.2), "low_letter_ratio"), F.when(blanks > 0.65, "excessive_whitespace"),
    ))
    score = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - 0.18 * F.size(warnings)))
    quality = F.when(n == 0, "missing").when((score >= 0.7) & (n >= 80), "good").otherwise("poor")
    return F.struct(quality.alias("quality"), F.round(score, 2).alias("score"), n.alias("char_count"), warnings.alias("warnings"), (quality != "good").alias("allow_ocr_fallback"))


def share(c: Column, of: str, within: str) -> Column:
    """Share of characters of one class among those of another; 0 where there are none of the latter."""
    n = F.regexp_count(c, F.lit(within))
    return F.when(n > 0, F.regexp_count(c, F.lit(of)) / n).otherwise(F.lit(0.0))


CYRILLIC, LETTER = r"[\x{0400}-\x{04FF}]", r"\p{L}"


def has_cyrillic(c: Column) -> Column:
    """At least eight Cyrillic letters, or 18 % of the letters."""
    return (F.regexp_count(c, F.lit(CYRILLIC)) >= 8) | (share(c, CYRILLIC, LETTER) >= 0.18)


def many_cyrillic(c: Column) -> Column:
    """At least twelve Cyrillic letters and 12 % of the letters."""
    return (F.regexp_count(c, F.lit(CYRILLIC)) >= 12) & (share(c, CYRILLIC, LETTER) >= 0.12)


def mojibake(c: Column) -> Column:
    """Number of characters that wrong decoding leaves behind."""
    return F.length(c) - F.length(F.translate(c, MOJIBAKE, ""))


#: What a text decoded with the wrong code page holds where it is judged as a whole; fixed values.
CORRUPTED_MARKS = ("Ã", "Â", "â€", "Ð", "Ñ")


def corrupted(c: Column) -> Column:
    """Whether a document's text is unreadable: stray signs, marks of a wrong code page, or some of them in Latin text."""
    n = lambda *x: sum((F.length(c) - F.length(F.replace(c, F.lit(y), F.lit("")))) / len(y) for y in x)
    marks = n(*CORRUPTED_MARKS)
    cyrillic, latin = F.regexp_count(c, F.lit("[А-яёЁ]")), F.regexp_count(c, F.lit("[A-z]"))
    letters = cyrillic + latin
    return F.coalesce((c != "") & ((n("\u00b6", "\ufffd") >= 3) | (marks >= 8) | ((letters > 100) & (cyrillic < letters * 0.15) & (marks >= 3))), F.lit(False))


def layer_quality(c: Column) -> Column:
    """missing, poor or good."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    bad = F.length(c) - F.length(F.translate(c, "\ufffd\u25a1", ""))
    letters = F.regexp_count(c, F.lit(LETTER)) / F.greatest(F.length(c), F.lit(1))
    return F.when(c == "", "missing").when((F.length(c) < 300) | (bad > 10) | (letters < 0.35), "poor").otherwise("good")


def repaired_artifacts(c: Column) -> Column:
    for a, b in ARTIFACTS.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def dehyphenated(c: Column) -> Column:
    """Words joined across a hyphen at a line end, blanks collapsed, blank lines capped at one."""
    c = F.regexp_replace(c, r"(\p{L})-[ \t]*\n[ \t]*(\p{L})", "$1$2")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def mentions(c: Column) -> Column:
    """Distinct symbols named in prose: indexed capitals, single capitals (but I and A), and functions of one letter."""
    found = F.regexp_extract_all(c, F.lit(r"(\b[A-Z]_[A-Za-z0-9]+\b|\b[A-Z]\b|\b[A-Za-z]\([A-Za-z]\))"), 1)
    return F.array_distinct(F.filter(found, lambda x: ~x.isin("I", "A")))


def safe_id(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_]+", "_")


def arxiv_id(c: Column) -> Column:
    """First identifier of the new or the old style, with its version."""
    return blank_to_null(F.regexp_extract(c, r"([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?|[a-z-]+(?:\.[A-Z]{2})?/[0-9]{7}(?:v[0-9]+)?)", 1))


def id_list(c: Column) -> Column:
    """Parts between commas, semicolons and white space, empty ones dropped."""
    return F.filter(F.split(c, r"[,;\s]+"), lambda x: x != "")


def paragraphs(c: Column) -> Column:
    return F.split(c, "\n")
