"""Definitions that context sentences give of symbols, by rule; what several families of queries rest on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions import latex
from papyrine.plans.base import current, sql
from papyrine.plans.text_queries import symbol_sql

_SYMBOL = r"(\\?[A-Za-z](?:_\{?[A-Za-z0-9]+\}?)?|[A-Z]_[A-Za-z0-9]+|[Α-Ωα-ω])"
_TAIL = r"([^.;\n]{2,180})"
#: The 14 rules: name, pattern, confidence; fixed values. A definition has 2 to 180 characters.
RULES = [
    ("ru_where_dash", rf"где\s+{_SYMBOL}\s*[-–—:]\s*{_TAIL}", 0.78),
    ("ru_where_is", rf"где\s+{_SYMBOL}\s+(?:является|есть)\s+{_TAIL}", 0.78),
    ("ru_denotes", rf"{_SYMBOL}\s+(?:обозначает|обозначают)\s+{_TAIL}", 0.76),
    ("ru_named", rf"{_SYMBOL}\s+(?:называется|называют)\s+{_TAIL}", 0.7),
    ("ru_defined_as", rf"{_SYMBOL}\s+(?:определяется\s+как|задается\s+как|задаётся\s+как)\s+{_TAIL}", 0.8),
    ("ru_let", rf"пусть\s+{_SYMBOL}\s+{_TAIL}", 0.64),
    ("ru_denote_by", rf"через\s+{_SYMBOL}\s+(?:обозначим|обозначается)\s+{_TAIL}", 0.76),
    ("ru_is", rf"{_SYMBOL}\s*[-–—]\s*это\s+{_TAIL}", 0.74),
    ("en_where_is", rf"where\s+{_SYMBOL}\s+(?:is|are)\s+{_TAIL}", 0.78),
    ("en_denotes", rf"{_SYMBOL}\s+(?:denotes|denote)\s+{_TAIL}", 0.76),
    ("en_defined_as", rf"{_SYMBOL}\s+(?:is|are)\s+defined\s+as\s+{_TAIL}", 0.82),
    ("en_let_be", rf"let\s+{_SYMBOL}\s+be\s+{_TAIL}", 0.72),
    ("en_represents", rf"{_SYMBOL}\s+(?:represents|represent)\s+{_TAIL}", 0.74),
    ("en_denote_by", rf"we\s+denote\s+by\s+{_SYMBOL}\s+{_TAIL}", 0.76),
]
_BLANK = r"[\s\p{Z}\x1c-\x1f\x{85}]+"
_HEAD = "^(?:is|are|является|есть) +"
#: The same as common table expressions for DuckDB, from ``contexts`` to ``defs``.
DEFS = f""", said as (select document_id, formula_id, trim(regexp_replace(current_sentence, '{_BLANK}', ' ', 'g')) as said from contexts where current_sentence is not null), found as (
""" + "\nunion all ".join(f"select document_id, formula_id, '{n}' as rule, {c} as confidence, generate_subscripts(regexp_extract_all(said, '(?i){p}', 1), 1) as place, unnest(regexp_extract_all(said, '(?i){p}', 1)) as symbol, unnest(regexp_extract_all(said, '(?i){p}', 2)) as definition from said" for n, p, c in RULES) + f"""),
cleaned as (select document_id, formula_id, rule, confidence, place, {symbol_sql("symbol")} as symbol, trim(regexp_replace(trim(definition), '(?i){_HEAD}', ''), ' ,:-–—') as definition from found),
defs as (select document_id, formula_id, rule, cast(confidence as double) as confidence, symbol, arg_min(definition, place) as definition from cleaned where definition <> '' and symbol is not null group by 1, 2, 3, 4, 5, lower(definition))
"""
DEF = sql("contexts") + DEFS


def rule_definitions(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, rule, confidence, symbol, definition) by all rules; of definitions equal but for case, the first of the text."""
    said = df.where(F.col(text).isNotNull()).select(*keys, F.trim(F.regexp_replace(text, _BLANK, " ")).alias("said"))
    part = lambda p, k: F.regexp_extract_all("said", F.lit(f"(?iu){p}"), k)
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(c).alias("confidence"), F.arrays_zip(part(p, F.lit(1)).alias("symbol"), part(p, F.lit(2)).alias("definition")).alias("m")) for n, p, c in RULES])
    flat = said.select(*keys, F.explode(rules).alias("r")).select(*keys, "r.rule", "r.confidence", F.posexplode("r.m").alias("at", "m"))
    cleaned = flat.select(*keys, "rule", "confidence", "at", latex.symbol(F.col("m.symbol")).alias("symbol"), F.btrim(F.regexp_replace(F.trim("m.definition"), f"(?iu){_HEAD}", ""), F.lit(" ,:-–—")).alias("definition"))
    return cleaned.where("definition <> '' and symbol is not null").groupBy(*keys, "rule", "confidence", "symbol", F.lower("definition")).agg(F.min_by("definition", "at").alias("definition")).select(*keys, "rule", "confidence", "symbol", "definition")


def definitions(s: SparkSession, d: str) -> DataFrame:
    """Definitions of the current sentences: one pass over the contexts for all rules."""
    return rule_definitions(current(s, d, "contexts", "current_sentence"), ["document_id", "formula_id"], "current_sentence")
