"""Scalar operators over text and LaTeX, run over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.functions import latex, notation, text
from papyrine.plans.base import current, sql
from papyrine.sources.tables import table

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents", "doc_id", "text")


@query("text_normalize_space", "select doc_id, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) as clean from documents")
def _(s, d):
    return _docs(s, d).select("doc_id", text.collapse(F.col("text")).alias("clean"))


@query("text_clip_context", "select doc_id, case when length(text) > 420 then rtrim(text[1:420], ' ') || '...' else text end as clipped from documents")
def _(s, d):
    return _docs(s, d).select("doc_id", text.clip(F.col("text"), 420).alias("clipped"))


@query("text_repair_artifacts", "select doc_id, replace(replace(replace(replace(replace(replace(replace(text, chr(173), ''), chr(64257), 'fi'), chr(64258), 'fl'), chr(8722), '-'), chr(8211), '-'), chr(8212), '-'), chr(8727), '*') as clean from documents")
def _(s, d):
    return _docs(s, d).select("doc_id", text.repaired_artifacts(F.col("text")).alias("clean"))


@query("text_dehyphenate", r"""select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(\p{L})-[ \t]*\n[ \t]*(\p{L})', '\1\2', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) as clean from documents""")
def _(s, d):
    return _docs(s, d).select("doc_id", text.dehyphenated(F.col("text")).alias("clean"))


@query("text_mojibake_score", "select doc_id, length(text) - length(translate(text, 'ÃÂâÏÎÐÑ', '')) as score from documents")
def _(s, d):
    return _docs(s, d).select("doc_id", text.mojibake(F.col("text")).cast("long").alias("score"))


_CYR = "length(regexp_replace(text, '[^\\x{0400}-\\x{04FF}]', '', 'g'))"
_LET = "length(regexp_replace(text, '[^\\p{L}]', '', 'g'))"


@query("text_has_cyrillic", f"select doc_id, {_CYR} >= 8 or coalesce({_CYR} / nullif({_LET}, 0), 0) >= 0.18 as cyrillic, {_CYR} >= 12 and coalesce({_CYR} / nullif({_LET}, 0), 0) >= 0.12 as many from documents")
def _(s, d):
    return _docs(s, d).select("doc_id", text.has_cyrillic(F.col("text")).alias("cyrillic"), text.many_cyrillic(F.col("text")).alias("many"))


def _count(x: str, of: str) -> str:
    return f"(length({x}) - length(replace({x}, '{of}', ''))) / {len(of)}"


_BAD = "(" + " + ".join(_count("x", m) for m in text.CORRUPTED_MARKS) + ")"
_CORRUPTED = f"""(x <> '' and (length(x) - length(translate(x, chr(182) || chr(65533), '')) >= 3 or {_BAD} >= 8 or (length(regexp_replace(x, '[^А-яёЁA-z]', '', 'g')) > 100
and length(regexp_replace(x, '[^А-яёЁ]', '', 'g')) < 0.15 * length(regexp_replace(x, '[^А-яёЁA-z]', '', 'g')) and {_BAD} >= 3)))"""


@query("text_looks_corrupted", f"select doc_id, coalesce({_CORRUPTED}, false) as corrupted from (select doc_id, text as x from documents)")
def _(s, d):
    return _docs(s, d).select("doc_id", text.corrupted(F.col("text")).alias("corrupted"))


@query("order_corrupted_documents", sql("blocks") + f", j as (select document_id, string_agg(text, chr(10) order by ord nulls first, block_id) as x from (select *, row_number() over (partition by document_id order by ord nulls first, block_id) as r from blocks) where r <= 80 group by 1) select document_id, coalesce({_CORRUPTED}, false) as corrupted from j")
def _(s, d):
    """Whether the first 80 blocks of a document are unreadable."""
    w = Window.partitionBy("document_id").orderBy("ord", "block_id")
    b = current(s, d, "blocks", "ord", "text").withColumn("r", F.row_number().over(w)).where("r <= 80")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda v: v["text"]), "\n")
    return b.groupBy("document_id").agg(whole.alias("x")).select("document_id", text.corrupted(F.col("x")).alias("corrupted"))


_BARE = "regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')"


@query("text_layer_quality", f"select doc_id, case when x = '' then 'missing' when length(x) < 300 or length(x) - length(translate(x, chr(65533) || chr(9633), '')) > 10 or length(regexp_replace(x, '[^\\p{{L}}]', '', 'g')) / length(x) < 0.35 then 'poor' else 'good' end as quality from (select doc_id, {_BARE} as x from documents)")
def _(s, d):
    return _docs(s, d).select("doc_id", text.layer_quality(F.col("text")).alias("quality"))


@query("text_layer_assessment", f"""select doc_id, case when n = 0 then 'missing' when 1 - 0.18 * len(w) >= 0.7 and n >= 80 then 'good' else 'poor' end as quality, cast(case when n = 0 then 0 else round(greatest(0, 1 - 0.18 * len(w)), 2) end as double) as score, n as char_count, array_to_string(w, '|') as warnings,
not (n > 0 and 1 - 0.18 * len(w) >= 0.7 and n >= 80) as allow_ocr_fallback from (select doc_id, n, list_filter([case when n = 0 then 'text_layer_missing' end, case when contains(x, chr(65533)) then 'replacement_symbols_present' end, case when regexp_matches(x, '[\x00-\x08\x0b\x0c\x0e-\x1f]') then 'control_symbols_present' end,
case when n > 0 and length(regexp_replace(x, '[^\\p{{L}}]', '', 'g')) / greatest(1, n) < 0.2 then 'low_letter_ratio' end, case when (case when length(x) > 0 then length(regexp_replace(x, '[^\\s]', '', 'g')) / length(x) else 1.0 end) > 0.65 then 'excessive_whitespace' end], lambda v: v is not null) as w from (select doc_id, coalesce(text, '') as x, length({_BARE}) as n from documents))""")
def _(s, d):
    a = _docs(s, d).select("doc_id", text.layer_assessment(F.col("text")).alias("a")).select("doc_id", "a.*")
    return a.select("doc_id", "quality", "score", F.col("char_count").cast("long").alias("char_count"), F.array_join("warnings", "|").alias("warnings"), "allow_ocr_fallback")


@query("text_mentions_per_document")
def _(s, d):
    return _docs(s, d).select("doc_id", F.explode(text.mentions(F.col("text"))).alias("symbol"))


@query("text_paragraphs", "select doc_id, i - 1 as pos, p[i] as paragraph from (select doc_id, string_split(text, chr(10)) as p, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)")
def _(s, d):
    return _docs(s, d).select("doc_id", F.posexplode(text.paragraphs(F.col("text"))).alias("pos", "paragraph")).select("doc_id", F.col("pos").cast("long").alias("pos"), "paragraph")


@query("context_sentences", sql("blocks") + "select document_id, block_id, trim(x) as sentence from (select document_id, block_id, unnest(regexp_extract_all(text, '([^.!?。！？]+[.!?。！？]*)', 1)) as x from blocks) where trim(x) <> ''")
def _(s, d):
    return current(s, d, "blocks", "text").select("document_id", "block_id", F.explode(text.sentences(F.col("text"))).alias("sentence"))


@query("context_formula_tokens", sql("blocks") + "select distinct document_id, block_id, unnest(regexp_extract_all(text_with_tokens, '\\[FORMULA_[0-9]+\\]')) as token from blocks")
def _(s, d):
    return current(s, d, "blocks", "text_with_tokens").select("document_id", "block_id", F.explode(text.tokens(F.col("text_with_tokens"))).alias("token"))


@query("context_formula_refs", sql("blocks") + "select distinct document_id, block_id, unnest(regexp_extract_all(text, '\\(([0-9]{1,4}[a-zA-Z]?)\\)', 1)) as ref from blocks")
def _(s, d):
    return current(s, d, "blocks", "text").select("document_id", "block_id", F.explode(text.references(F.col("text"))).alias("ref"))


_MARKS = "[" + ", ".join(f"'{m}'" for m in text.DEFINITION_MARKERS) + "]"


@query("context_markers", sql("contexts") + f"select document_id, formula_id, array_to_string(list_filter({_MARKS}, lambda m: contains(lower(current_sentence), m)), '|') as markers from contexts where current_sentence is not null")
def _(s, d):
    return current(s, d, "contexts", "current_sentence").where("current_sentence is not null").select("document_id", "formula_id", F.array_join(text.markers(F.col("current_sentence")), "|").alias("markers"))


@query("context_token_window", sql("blocks") + """, t as (select distinct document_id, block_id, text_with_tokens as x, unnest(regexp_extract_all(text_with_tokens, '\\[FORMULA_[0-9]+\\]')) as token from blocks),
p as (select *, instr(x, token) as spot, greatest(1, instr(x, token) - 260) as b from t)
select document_id, block_id, token, substr(x, b, length(token) + 260 + spot - b) as near from p""")
def _(s, d):
    rows = current(s, d, "blocks", "text_with_tokens").select("document_id", "block_id", "text_with_tokens", F.explode(text.tokens(F.col("text_with_tokens"))).alias("token"))
    return rows.select("document_id", "block_id", "token", text.token_window(F.col("text_with_tokens"), F.col("token")).alias("near"))


@query("context_sentence_of_token", sql("blocks") + """, t as (select distinct document_id, block_id, text_with_tokens as x, unnest(regexp_extract_all(text_with_tokens, '\\[FORMULA_[0-9]+\\]')) as token from blocks),
p as (select *, list_filter(list_transform(regexp_extract_all(x, '([^.!?。！？]+[.!?。！？]*)', 1), lambda v: trim(v)), lambda v: v <> '') as ss from t), q as (select *, coalesce(list_position(list_transform(ss, lambda v: contains(v, token)), true), 0) as spot from p)
select document_id, block_id, token, case when spot > 1 then ss[spot - 1] end as before, case when spot > 0 then ss[spot] end as own, case when spot > 0 and spot < len(ss) then ss[spot + 1] end as after from q""")
def _(s, d):
    """Sentence with a token, and its neighbours."""
    rows = current(s, d, "blocks", "text_with_tokens").select("document_id", "block_id", text.sentences(F.col("text_with_tokens")).alias("ss"), F.explode(text.tokens(F.col("text_with_tokens"))).alias("token"))
    at = F.expr("array_position(transform(ss, x -> contains(x, token)), true)")
    rows = rows.withColumn("at", at.cast("int"))
    return rows.select("document_id", "block_id", "token", F.expr("case when at > 1 then ss[at - 2] end").alias("before"), F.expr("case when at > 0 then ss[at - 1] end").alias("own"), F.expr("case when at > 0 and at < size(ss) then ss[at] end").alias("after"))


@query("order_section_level", sql("sections") + """select document_id, section_id, case when n = '' then 1 else least(6, length(n) - length(replace(n, '.', '')) + 1) end as level_of_title, lower(trim(regexp_replace(title, '[ \\t\\r\\n]+', ' ', 'g'))) as norm_title
from (select *, regexp_extract(trim(title), '^([0-9]+(?:\\.[0-9]+)*)', 1) as n from sections)""")
def _(s, d):
    return current(s, d, "sections", "title").select("document_id", "section_id", text.section_level(F.col("title")).alias("level_of_title"), F.lower(text.collapse(F.col("title"))).alias("norm_title"))


_TITLES = "(?i)^\\s*(?:\\d+(?:\\.\\d+)*\\.?\\s+)?(?:" + "|".join(notation.SECTION_TITLES) + ")(?:[^\\p{L}\\p{N}_]|$)"


@query("order_heading_blocks", sql("blocks") + f"select document_id, block_id from (select *, trim(text) as x from blocks) where x <> '' and length(x) <= 180 and (coalesce(block_type = 'heading', false) or (coalesce(block_type, '') not in ('title', 'author', 'abstract') and (regexp_matches(x, '^[0-9]+(\\.[0-9]+)*\\.?\\s+[^\\s]') or regexp_matches(x, '{_TITLES}'))))")
def _(s, d):
    return current(s, d, "blocks", "text", "block_type").where(text.is_heading(F.col("text"), F.col("block_type"))).select("document_id", "block_id")


@query("ops_safe_ids", sql("nodes") + "select document_id, node_id, regexp_replace(node_id, '[^A-Za-z0-9_]+', '_', 'g') as safe from nodes")
def _(s, d):
    return current(s, d, "nodes", "node_type").select("document_id", "node_id", text.safe_id(F.col("node_id")).alias("safe"))


@query("ops_arxiv_ids", "select paper_id, nullif(regexp_extract(lower(coalesce(text, '')), '([0-9]{4}\\.[0-9]{4,5}(?:v[0-9]+)?|[a-z-]+(?:\\.[A-Z]{2})?/[0-9]{7}(?:v[0-9]+)?)', 1), '') as arxiv from documents")
def _(s, d):
    return table(s, d, "documents", "paper_id", "text").select("paper_id", text.arxiv_id(F.lower(F.coalesce("text", F.lit("")))).alias("arxiv"))


@query("ops_id_list", "select document_id, unnest(list_filter(regexp_split_to_array(array_to_string(authors, ', '), '[,;\\s]+'), lambda x: x <> '')) as part from paper_profiles")
def _(s, d):
    return table(s, d, "paper_profiles", "document_id", "authors").select("document_id", F.explode(text.id_list(F.array_join("authors", ", "))).alias("part"))


def _formulas(s: SparkSession, d: str, *c: str) -> DataFrame:
    return current(s, d, "formulas", *c)


_F = sql("formulas")
_STRIP = "latex"
for _i in range(4):
    for _a, _b in latex._WRAPPERS:
        _STRIP = f"trim(regexp_replace({_STRIP}, '(?s)^{_a}\\s*(.*?)\\s*{_b}$', '\\1'))"


@query("latex_strip_wrappers", _F + f"select document_id, formula_id, {_STRIP} as bare from formulas")
def _(s, d):
    return _formulas(s, d, "latex").select("document_id", "formula_id", latex.stripped(F.col("latex")).alias("bare"))


_BRACED = "latex"
for _i in range(2):
    _BRACED = f"regexp_replace({_BRACED}, '(^|[^\\\\])([A-Za-z0-9)\\]])([\\^_])([A-Za-z0-9])\\b', '\\1\\2\\3{{\\4}}', 'g')"


@query("latex_brace_scripts", _F + f"select document_id, formula_id, {_BRACED} as braced from formulas")
def _(s, d):
    return _formulas(s, d, "latex").select("document_id", "formula_id", latex.braced(F.col("latex")).alias("braced"))


def _any(x: str, values: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, '{v}')" for v in values) + ")"


_LABELS = {}
for _k, _v in notation.COMMAND_LABELS:
    _LABELS.setdefault(_v, []).append(f"list_contains(c, '{_k}')")
for _k, _v in notation.SIGN_LABELS:
    _LABELS.setdefault(_v, []).append(f"contains(latex, '{_k}')")
_OPS = "list_filter([" + ", ".join(f"case when {' or '.join(w)} then '{v}' end" for v, w in _LABELS.items()) + "], lambda x: x is not null)"


@query("latex_operators", _F + f"select document_id, formula_id, array_to_string({_OPS}, '|') as ops from (select *, regexp_extract_all(latex, '\\\\[A-Za-z]+') as c from formulas where latex is not null)")
def _(s, d):
    return _formulas(s, d, "latex").where("latex is not null").select("document_id", "formula_id", F.array_join(latex.operators(F.col("latex")), "|").alias("ops"))


_OPERATOR_LIST = "['" + "', '".join(notation.OPERATOR_COMMANDS) + "']"


@query("symbol_operators", _F + f"select distinct document_id, formula_id, op from (select document_id, formula_id, unnest(list_concat(list_filter(regexp_extract_all(latex, '\\\\[A-Za-z]+'), lambda x: list_contains({_OPERATOR_LIST}, x[2:])), regexp_extract_all(latex, '[=+\\-*/^<>]'))) as op from formulas)")
def _(s, d):
    """The operators of each formula as they are written."""
    return _formulas(s, d, "latex").select("document_id", "formula_id", F.explode(latex.operator_tokens(F.col("latex"))).alias("op"))


_NEAR = "lower(coalesce(c.current_sentence, ''))"


@query("latex_semantic_hints", sql("formulas", "contexts") + f"""select f.document_id, f.formula_id, {_any(_NEAR, notation.DEFINITION_MARKERS)} as definition_like, {_any(_NEAR, notation.THEOREM_MARKERS)} as theorem_like, {_any("f.latex", notation.OPTIMUM_COMMANDS)} or {_any(_NEAR, notation.OPTIMUM_MARKERS)} as optimization_like,
contains(f.latex, '=') as contains_equality, regexp_matches(f.latex, '<|>|\\\\leq?|\\\\geq?|\\\\lt|\\\\gt') as contains_inequality, contains(f.latex, '\\sum') as contains_sum, contains(f.latex, '\\int') as contains_integral, contains(f.latex, '\\frac') as contains_fraction, {_any("f.latex", notation.MATRIX_MARKERS)} as contains_matrix
from (select document_id, formula_id, coalesce(latex, '') as latex from formulas) f left join contexts c on c.document_id = f.document_id and c.formula_id = f.formula_id""")
def _(s, d):
    j = _formulas(s, d, "latex").join(current(s, d, "contexts", "current_sentence"), ["document_id", "formula_id"], "left")
    return j.select("document_id", "formula_id", latex.hints(F.col("latex"), F.col("current_sentence")).alias("h")).select("document_id", "formula_id", "h.*")


_CLASS = "case " + " ".join(f"when {_any('bare' if held == ['='] else 't', held)} then '{name}'" for name, held in notation.CLASSES) + " else 'mathematical_expression' end"


@query("latex_classify", sql("formulas", "contexts") + f"select document_id, formula_id, {_CLASS} as class from (select f.document_id, f.formula_id, coalesce(f.latex, '') as bare, lower(coalesce(f.latex, '') || ' ' || coalesce(c.current_sentence, '')) as t from formulas f left join contexts c on c.document_id = f.document_id and c.formula_id = f.formula_id)")
def _(s, d):
    f, c = _formulas(s, d, "latex"), current(s, d, "contexts", "current_sentence")
    return f.join(c, ["document_id", "formula_id"], "left").select("document_id", "formula_id", latex.kind(F.col("latex"), F.col("current_sentence")).alias("class"))


@query("latex_from_text")
def _(s, d):
    """LaTeX of what blocks print as text."""
    return current(s, d, "blocks", "text").where("text is not null").select("document_id", "block_id", latex.from_text(F.col("text")).alias("latex"))


@query("latex_sanity")
def _(s, d):
    x = _formulas(s, d, "latex").select("document_id", "formula_id", latex.sanity(F.col("latex")).alias("v")).select("document_id", "formula_id", "v.*")
    return x.withColumn("warnings", F.array_join("warnings", "|"))


_MATH_WORDS = "['" + "', '".join(notation.MATH_WORDS) + "']"


@query("latex_prose_words", _F + f"select document_id, formula_id, len(list_filter(regexp_extract_all(regexp_replace(latex, '\\\\[A-Za-z]+', ' ', 'g'), '[A-Za-z]{{4,}}'), lambda w: not list_contains({_MATH_WORDS}, lower(w)))) as words, len(regexp_extract_all(latex, '\\\\[A-Za-z]+|[=<>_^]|[0-9]|[\\x{{0370}}-\\x{{03ff}}]')) as signals from formulas where latex is not null")
def _(s, d):
    return _formulas(s, d, "latex").where("latex is not null").select("document_id", "formula_id", latex.prose_words(F.col("latex")).alias("words"), latex.math_signals(F.col("latex")).alias("signals"))


@query("latex_flags", _F + """select document_id, formula_id, array_to_string(list_filter([case when coalesce(trim(latex), '') = '' then 'latex_missing' end,
case when length(latex) - length(replace(latex, '{', '')) <> length(latex) - length(replace(latex, '}', '')) then 'unbalanced_braces' end, case when length(latex) - length(replace(latex, '(', '')) <> length(latex) - length(replace(latex, ')', '')) then 'unbalanced_delimiters' end,
case when regexp_matches(trim(latex), '[=+<>]$') then 'incomplete_formula' end, case when length(latex) > 700 then 'very_long_formula' end, case when len(regexp_extract_all(latex, '[=<>+^_]|\\\\[A-Za-z]+')) < 1 then 'weak_math_signal' end], lambda x: x is not null), '|') as flags from formulas""")
def _(s, d):
    return _formulas(s, d, "latex").select("document_id", "formula_id", F.array_join(latex.flags(F.col("latex")), "|").alias("flags"))


@query("latex_quality_status")
def _(s, d):
    f = _formulas(s, d, "latex", "confidence").withColumn("flags", latex.flags(F.col("latex")))
    n = F.size("flags")
    return f.select("document_id", "formula_id", latex.adjusted(F.col("confidence"), F.col("flags")).alias("adjusted"), latex.quality(F.col("confidence"), F.greatest(F.lit(0.0), 1 - 0.18 * n), n).alias("q")).select("document_id", "formula_id", "adjusted", "q.*")


@query("latex_overlap_neighbours", _F + """, w as (select document_id, formula_id, ord, list_distinct(regexp_extract_all(latex, '(\\\\[A-Za-z]+|[A-Za-z0-9]+)', 1)) as a, lead(formula_id) over o as next_id, lead(list_distinct(regexp_extract_all(latex, '(\\\\[A-Za-z]+|[A-Za-z0-9]+)', 1))) over o as b from formulas where latex is not null window o as (partition by document_id order by ord, formula_id))
select document_id, formula_id, next_id, case when len(list_distinct(list_concat(a, b))) > 0 then round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) else 0.0 end as overlap from w where next_id is not null""")
def _(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("document_id").orderBy("ord", "formula_id")
    f = _formulas(s, d, "latex", "ord").where("latex is not null").withColumn("next_id", F.lead("formula_id").over(w)).withColumn("b", F.lead("latex").over(w)).where("next_id is not null")
    return f.select("document_id", "formula_id", "next_id", F.round(latex.jaccard(F.col("latex"), F.col("b")), 6).alias("overlap"))


def _alias(x: str) -> str:
    table = " ".join(f"when '{a}' then '{b}'" for a, b in notation.ALIASES.items())
    return f"coalesce(case {x} {table} end, case lower({x}) {table} end, case when lower({x}) not in ({', '.join(repr(w) for w in notation.IGNORED_WORDS)}) then nullif({x}, '') end)"


def symbol_sql(x: str) -> str:
    """The normalised spelling of a symbol, as an expression of DuckDB."""
    bare = f"regexp_replace(regexp_replace(trim({x}), '^\\$+|\\$+$', '', 'g'), '\\s+', '', 'g')"
    inner = _alias(f"regexp_extract({bare}, '{latex._STYLED}', 2)")
    styled = f"case when regexp_matches({inner}, '{latex._ONE_LETTER}') then '\\' || regexp_extract({bare}, '{latex._STYLED}', 1) || '{{' || {inner} || '}}' end"
    plain = f"regexp_replace({bare}, '[{{}}]', '', 'g')"
    return f"case when regexp_matches({bare}, '{latex._STYLED}') then {styled} else {_alias(plain)} end"


_GREEK = symbol_sql("x")


@query("symbol_normalize", _F + f"select distinct document_id, formula_id, {_GREEK} as symbol from (select document_id, formula_id, unnest(symbols) as x from formulas) where {_GREEK} is not null")
def _(s, d):
    return symbols(s, d).select("document_id", "formula_id", "symbol")


def symbols(s: SparkSession, d: str, *c: str) -> DataFrame:
    """Link table of formulas and their normalised symbols, each pair once."""
    each = F.array_distinct(F.array_compact(F.transform("symbols", latex.symbol)))
    return _formulas(s, d, "symbols", *c).select("document_id", "formula_id", *c, F.explode(each).alias("symbol"))


@query("symbol_in_latex")
def _(s, d):
    """Symbols that the LaTeX of each formula holds."""
    return _formulas(s, d, "latex").select("document_id", "formula_id", F.explode(latex.formula_symbols(F.col("latex"))).alias("symbol"))


@query("symbol_commands_in_latex", _F + "select distinct document_id, formula_id, unnest(regexp_extract_all(latex, '\\\\[A-Za-z]+')) as command from formulas")
def _(s, d):
    return _formulas(s, d, "latex").select("document_id", "formula_id", F.explode(F.array_distinct(F.regexp_extract_all("latex", F.lit(r"(\\[A-Za-z]+)"), 1))).alias("command"))


@query("symbol_indexed_in_latex", _F + "select distinct document_id, formula_id, unnest(regexp_extract_all(latex, '[A-Za-z]_[0-9]+')) as symbol from formulas")
def _(s, d):
    return _formulas(s, d, "latex").select("document_id", "formula_id", F.explode(F.array_distinct(F.regexp_extract_all("latex", F.lit(r"([A-Za-z]_[0-9]+)"), 1))).alias("symbol"))
