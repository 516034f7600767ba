"""Further rows of the inventory: cleaning, extraction, tiers of joins, units, summaries, lookups, selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.functions import latex, notation, text
from papyrine.plans.base import current, sql
from papyrine.plans.graph_queries import _DEF, _FSQ, definitions, fs
from papyrine.plans.text_queries import _GREEK
from papyrine.sources.tables import table

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


union = lambda *x: reduce(DataFrame.unionByName, x)

# ---- text ---------------------------------------------------------------------------------------------------------


@query("text_service_symbols", r"select doc_id, regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{200B}-\x{200F}\x{202A}-\x{202E}\x{FEFF}\x{FFFD}]', '', 'g'), '</?(p|span|div|br)[^<>]*>', ' ', 'g') as clean from documents")
def _(s, d):
    c = F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{200B}-\x{200F}\x{202A}-\x{202E}\x{FEFF}\x{FFFD}]", "")
    return table(s, d, "documents", "doc_id", "text").select("doc_id", F.regexp_replace(c, r"</?(p|span|div|br)[^<>]*>", " ").alias("clean"))


@query("text_html_to_text", r"select doc_id, trim(regexp_replace(regexp_replace(text, '<[^<>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) as plain from documents where contains(text, '<')")
def _(s, d):
    x = table(s, d, "documents", "doc_id", "text").where(F.contains("text", F.lit("<")))
    return x.select("doc_id", text.collapse(F.regexp_replace("text", r"<[^<>]+>", " ")).alias("plain"))


@query("text_tex_to_prose", r"""select document_id, block_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\(?:ref|cite|label|footnote)\{[^{}]*\}', '', 'g'), '\\(?:emph|textbf|textit)\{([^{}]*)\}', '\1', 'g'), '\\[A-Za-z]+', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) as prose
from text_blocks where text_source = 'tex_source'""")
def _(s, d):
    c = F.regexp_replace("text", r"\\(?:ref|cite|label|footnote)\{[^{}]*\}", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\\(?:emph|textbf|textit)\{([^{}]*)\}", "$1"), r"\\[A-Za-z]+", " ")
    return table(s, d, "text_blocks", "document_id", "block_id", "text", "text_source").where("text_source = 'tex_source'").select("document_id", "block_id", text.collapse(c).alias("prose"))


@query("text_lines_kept", "select distinct document_id, block_id, pos - 1 as pos, line.text as line from (select document_id, block_id, unnest(range(1, len(text_lines) + 1)) as pos, unnest(text_lines) as line from text_blocks) where coalesce(trim(line.text), '') <> ''")
def _(s, d):
    x = table(s, d, "text_blocks", "document_id", "block_id", "text_lines").select("document_id", "block_id", F.posexplode("text_lines").alias("pos", "l"))
    return x.select("document_id", "block_id", F.col("pos").cast("long").alias("pos"), F.col("l.text").alias("line")).where("coalesce(trim(line), '') <> ''").distinct()


@query("order_block_types", sql("layers") + r"""select document_id, block_id, case when role in ('section', 'subsection', 'subsubsection', 'chapter', 'part') then 'heading' when role in ('title', 'author', 'abstract', 'heading', 'paragraph', 'caption', 'list_item', 'footer') then role
when length(x) < 120 and upper(x) = x and lower(x) <> x then 'heading' when x <> '' then 'paragraph' else 'unknown' end as type from (select document_id, block_id, lower(coalesce(block_role, '')) as role, trim(coalesce(text, '')) as x from layers)""")
def _(s, d):
    return current(s, d, "layers", "block_role", "text").select("document_id", "block_id", text.block_type(F.col("block_role"), F.col("text")).alias("type"))


# ---- LaTeX --------------------------------------------------------------------------------------------------------

_F = sql("formulas")


@query("latex_greek_to_commands", _F + "select document_id, formula_id, " + reduce(lambda a, kv: f"replace({a}, '{kv[0]}', '{kv[1]}')", {**notation.GREEK, **notation.SIGNS}.items(), "array_to_string(symbols, ' ')") + " as commands from formulas where symbols is not null")
def _(s, d):
    """Greek letters and signs of the symbols as commands, by the whole tables."""
    c = reduce(lambda a, kv: F.replace(a, F.lit(kv[0]), F.lit(kv[1])), {**notation.GREEK, **notation.SIGNS}.items(), F.array_join("symbols", " "))
    return current(s, d, "formulas", "symbols").where("symbols is not null").select("document_id", "formula_id", c.alias("commands"))


_N = lambda *x: " + ".join(f"len(regexp_extract_all(latex, '{y}'))" for y in x)


@query("latex_score", _F + f"""select document_id, formula_id, 4 * ({_N(r"\\frac", r"\\lim", r"\\sum", r"\\int", r"\\sqrt")}) + 3 * ({_N(r"\\cdots")}) + 2 * ({_N("_", r"\^", r"\\to", r"\\infty", r"\\circ", r"\\cdot", r"\\cup", r"\\cap")}) + {_N("=")} - 3 * ({_N(r"\\therefore")}) - 4 * ({_N(r"_\{[^{}]+\}\s*-\s*[0-9]")}) - ({_N("[A-Za-z]{8,}")}) as score from formulas where latex is not null""")
def _(s, d):
    return current(s, d, "formulas", "latex").where("latex is not null").select("document_id", "formula_id", latex.structure_score(F.col("latex")).alias("score"))


@query("latex_usable", _F + r"select document_id, formula_id, case when regexp_matches(latex, '\\(frac|sum|int|sqrt)') or length(latex) > 40 then 'block' else 'inline' end as shape, case when regexp_matches(latex, '[=<>]|\\(le|ge)') then confidence else least(confidence, 0.45) end as confidence from formulas where coalesce(trim(latex), '') <> ''")
def _(s, d):
    x = current(s, d, "formulas", "latex", "confidence").where("coalesce(trim(latex), '') <> ''")
    return x.select("document_id", "formula_id", F.when(F.col("latex").rlike(r"\\(frac|sum|int|sqrt)") | (F.length("latex") > 40), "block").otherwise("inline").alias("shape"), F.when(F.col("latex").rlike(r"[=<>]|\\(le|ge)"), F.col("confidence")).when(F.col("confidence").isNull(), None).otherwise(F.least("confidence", F.lit(0.45))).alias("confidence"))


@query("latex_distinct", _F + r"select document_id, kind, min(formula_id) as first_id, count(*) as n from (select *, lower(regexp_replace(latex, '[ \t\r\n]+', '', 'g')) as k from formulas where latex is not null) group by document_id, kind, k")
def _(s, d):
    x = current(s, d, "formulas", "kind", "latex").where("latex is not null").withColumn("k", F.lower(F.regexp_replace("latex", r"[ \t\r\n]+", "")))
    return x.groupBy("document_id", "kind", "k").agg(F.min("formula_id").alias("first_id"), F.count(F.lit(1)).alias("n")).drop("k")


@query("latex_sides", _F + "select document_id, formula_id, trim(split_part(latex, '=', 1)) as left_side, trim(substr(latex, instr(latex, '=') + 1)) as right_side from formulas where instr(latex, '=') > 0")
def _(s, d):
    at = F.instr("latex", "=")
    x = current(s, d, "formulas", "latex").where(at > 0)
    return x.select("document_id", "formula_id", F.trim(F.substring(F.col("latex"), F.lit(1), at - 1)).alias("left_side"), F.trim(F.substring(F.col("latex"), at + 1, F.length("latex"))).alias("right_side"))


@query("symbol_single_letters", _F + r"select distinct document_id, formula_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(latex, '\\[A-Za-z]+', ' ', 'g'), '[A-Za-z]_[0-9]+', ' ', 'g'), '[A-Za-z]')) as symbol from formulas")
def _(s, d):
    rest = F.regexp_replace(F.regexp_replace("latex", r"\\[A-Za-z]+", " "), r"[A-Za-z]_[0-9]+", " ")
    return current(s, d, "formulas", "latex").select("document_id", "formula_id", F.explode(F.array_distinct(F.regexp_extract_all(rest, F.lit("([A-Za-z])"), 1))).alias("symbol"))


_NO_VARIABLE = "['" + "', '".join(notation.OPERATOR_COMMANDS + notation.IGNORED_COMMANDS) + "']"
_NO_WORD = "['" + "', '".join([*notation.IGNORED_WORDS, *[x.lower() for x in notation.OPERATOR_COMMANDS]]) + "']"


@query("symbol_variables_only", _F + f"""select distinct document_id, formula_id, symbol from (select document_id, formula_id, {_GREEK} as symbol from (select document_id, formula_id, unnest(list_concat(coalesce(symbols, []), regexp_extract_all(coalesce(latex, ''), '\\\\[A-Za-z]+'))) as x from formulas))
where symbol is not null and not (symbol[1] = '\\' and list_contains({_NO_VARIABLE}, ltrim(symbol, '\\'))) and symbol not in ('=', '+', '-', '*', '/', '^', '<', '>') and not list_contains({_NO_WORD}, lower(ltrim(symbol, '\\')))""")
def _(s, d):
    """Symbols and commands of each formula that can be variables."""
    every = F.concat(F.coalesce("symbols", F.array().cast("array<string>")), F.coalesce(F.regexp_extract_all("latex", F.lit(r"(\\[A-Za-z]+)"), 1), F.array().cast("array<string>")))
    x = current(s, d, "formulas", "symbols", "latex").select("document_id", "formula_id", F.explode(F.filter(F.array_compact(F.transform(every, latex.symbol)), latex.is_variable)).alias("symbol"))
    return x.distinct()


_BY_SYMBOL = {}
for _k, _v in notation.ALIASES.items():
    _BY_SYMBOL.setdefault(_v, []).append(_k)


def aliases(symbol: Column) -> Column:
    """Spellings of a normalised symbol in running text: itself, without backslash, and its letter and name."""
    table = F.create_map(*[y for k, v in _BY_SYMBOL.items() for y in (F.lit(k), F.array(*[F.lit(x) for x in v]))])
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(symbol, F.ltrim(F.regexp_replace(symbol, r"^\\+", ""))), F.coalesce(F.try_element_at(table, symbol), none)))


def mentioned(text_: Column, spelling: Column) -> Column:
    """Whether a text mentions a spelling: a command anywhere, anything else as a word of its own."""
    literal = F.regexp_replace(spelling, r"([^A-Za-z0-9_\s])", r"\\$1")
    return F.when(F.startswith(spelling, F.lit("\\")), F.contains(text_, spelling)).otherwise(F.regexp_like(text_, F.concat(F.lit(r"(?<![A-Za-z0-9_\\])"), literal, F.lit(r"(?![A-Za-z0-9_])"))))


@query("symbol_in_context")
def _(s, d):
    """Symbols of a formula that its sentence mentions, by any of their spellings."""
    f = current(s, d, "formulas", "symbols").select("document_id", "formula_id", F.explode("symbols").alias("x")).select("document_id", "formula_id", latex.symbol(F.col("x")).alias("symbol")).where("symbol is not null").distinct()
    c = current(s, d, "contexts", "current_sentence").where("current_sentence is not null")
    said = f.join(c, ["document_id", "formula_id"]).select("document_id", "formula_id", "symbol", "current_sentence", F.explode(aliases(F.col("symbol"))).alias("spelling"))
    return said.where(mentioned(F.col("current_sentence"), F.col("spelling"))).select("document_id", "formula_id", "symbol").distinct()


# ---- layout and tiers ---------------------------------------------------------------------------------------------


@query("merge_formula_block_tiers", sql("formulas", "blocks") + """, t as (select distinct b.document_id, b.block_id, b.ord, u.token from blocks b, unnest(b.formula_tokens) as u(token)), one as (select document_id, token, arg_min(block_id, {'o': ord, 'b': block_id}) as block_id from t where token is not null group by 1, 2),
sec as (select document_id, section_id, arg_min(block_id, {'o': ord, 'b': block_id}) as block_id from blocks where section_id is not null group by 1, 2)
select f.document_id, f.formula_id, coalesce(one.block_id, sec.block_id) as block_id, case when one.block_id is not null then 'token' when sec.block_id is not null then 'section' else 'none' end as tier from formulas f left join one on one.document_id = f.document_id and one.token = f.token left join sec on sec.document_id = f.document_id and sec.section_id = f.section_id""")
def _(s, d):
    """Block of each formula: the first that holds its token, else the first of its section."""
    b = current(s, d, "blocks", "formula_tokens", "section_id", "ord")
    first = F.min_by("block_id", F.struct("ord", "block_id"))
    one = b.select("document_id", "block_id", "ord", F.explode("formula_tokens").alias("token")).where("token is not null").groupBy("document_id", "token").agg(first.alias("by_token"))
    sec = b.where("section_id is not null").groupBy("document_id", "section_id").agg(first.alias("by_section"))
    j = current(s, d, "formulas", "token", "section_id").join(one, ["document_id", "token"], "left").join(sec, ["document_id", "section_id"], "left")
    return j.select("document_id", "formula_id", F.coalesce("by_token", "by_section").alias("block_id"), F.when(F.col("by_token").isNotNull(), "token").when(F.col("by_section").isNotNull(), "section").otherwise("none").alias("tier"))


@query("order_status", sql("formulas", "blocks") + """select b.document_id, b.n_blocks, coalesce(f.n, 0) as n_formulas, case when coalesce(f.n, 0) = 0 then 'no_formulas' when coalesce(f.weak, 0) > 0 then 'partial' else 'ok' end as status from (select document_id, count(*) as n_blocks from blocks group by 1) b
left join (select document_id, count(*) as n, count_if(coalesce(confidence, 0.0) < 0.5) as weak from formulas group by 1) f on f.document_id = b.document_id""")
def _(s, d):
    f = current(s, d, "formulas", "confidence").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("confidence", F.lit(0.0)) < 0.5).alias("weak"))
    b = current(s, d, "blocks", "ord").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    n, weak = F.coalesce("n", F.lit(0)), F.coalesce("weak", F.lit(0))
    return b.join(f, "document_id", "left").select("document_id", "n_blocks", n.alias("n_formulas"), F.when(n == 0, "no_formulas").when(weak > 0, "partial").otherwise("ok").alias("status"))


@query("order_warnings", sql("formulas", "blocks") + "select distinct document_id, code from (select document_id, 'low_confidence' as code from formulas where confidence < 0.5 union all select document_id, 'latex_missing' from formulas where coalesce(trim(latex), '') = '' union all select document_id, 'text_missing' from blocks where coalesce(trim(text), '') = '')")
def _(s, d):
    f, b = current(s, d, "formulas", "confidence", "latex"), current(s, d, "blocks", "text")
    row = lambda x, code: x.select("document_id", F.lit(code).alias("code"))
    return union(row(f.where("confidence < 0.5"), "low_confidence"), row(f.where("coalesce(trim(latex), '') = ''"), "latex_missing"), row(b.where("coalesce(trim(text), '') = ''"), "text_missing")).distinct()


# ---- units, graphs, summaries -------------------------------------------------------------------------------------


@query("sem_units", sql("formulas", "contexts") + "select f.document_id, f.formula_id, 'META_' || lpad(cast(row_number() over (partition by f.document_id order by f.ord, f.formula_id) as varchar), 3, '0') as unit_id, coalesce(len(f.symbols), 0) as n_symbols, c.formula_id is not null as has_context from formulas f left join contexts c on c.document_id = f.document_id and c.formula_id = f.formula_id")
def _(s, d):
    c = current(s, d, "contexts", "lang_label").select("document_id", "formula_id", F.lit(True).alias("c"))
    w = Window.partitionBy("document_id").orderBy("ord", "formula_id")
    j = current(s, d, "formulas", "ord", "symbols").join(c, ["document_id", "formula_id"], "left")
    n = F.coalesce(F.when(F.col("symbols").isNotNull(), F.size("symbols")), F.lit(0)).cast("long")
    return j.select("document_id", "formula_id", F.concat(F.lit("META_"), F.lpad(F.row_number().over(w).cast("string"), 3, "0")).alias("unit_id"), n.alias("n_symbols"), F.coalesce("c", F.lit(False)).alias("has_context"))


@query("sem_edges_by_type", sql("formulas", "contexts", "blocks") + """select relation, document_id, count(*) as n from (select 'has_context' as relation, document_id from contexts union all select 'contains', document_id from blocks where section_id is not null union all select 'appears_in', document_id from formulas where section_id is not null) group by 1, 2""")
def _(s, d):
    row = lambda x, k: x.select(F.lit(k).alias("relation"), "document_id")
    x = union(row(current(s, d, "contexts", "lang_label"), "has_context"), row(current(s, d, "blocks", "section_id").where("section_id is not null"), "contains"), row(current(s, d, "formulas", "section_id").where("section_id is not null"), "appears_in"))
    return x.groupBy("relation", "document_id").agg(F.count(F.lit(1)).alias("n"))


@query("sem_dependencies", _FSQ.replace("with recursive ", "with recursive ", 1) + """, p as (select document_id, symbol, formula_id, lag(formula_id) over (partition by document_id, symbol order by ord, formula_id) as before_id from fs) select document_id, formula_id as target_id, before_id as source_id, count(*) as shared from p where before_id is not null group by 1, 2, 3""")
def _(s, d):
    """Each formula with the last earlier one of each of its symbols, and how many symbols lead there."""
    w = Window.partitionBy("document_id", "symbol").orderBy("ord", "formula_id")
    p = fs(s, d).withColumn("source_id", F.lag("formula_id").over(w)).where("source_id is not null")
    return p.groupBy("document_id", F.col("formula_id").alias("target_id"), "source_id").agg(F.count(F.lit(1)).alias("shared"))


@query("rich_sections", sql("sections") + ", k as (select document_id, section_id from sections) select s.document_id, s.section_id, coalesce(k.section_id, 'paper:' || s.document_id) as parent_id from sections s left join k on k.document_id = s.document_id and k.section_id = s.parent_id")
def _(s, d):
    """Parent of each section, the paper itself where it has none or an unknown one."""
    x = current(s, d, "sections", "parent_id")
    k = x.select("document_id", F.col("section_id").alias("parent_id"), F.lit(True).alias("known"))
    return x.join(k, ["document_id", "parent_id"], "left").select("document_id", "section_id", F.when(F.col("known"), F.col("parent_id")).otherwise(F.concat(F.lit("paper:"), "document_id")).alias("parent_id"))


@query("rich_definition_confidence", _DEF + "select document_id, formula_id, cast(max(confidence) as double) as confidence, count(distinct symbol) as n_symbols from defs group by 1, 2")
def _(s, d):
    return definitions(s, d).groupBy("document_id", "formula_id").agg(F.max("confidence").alias("confidence"), F.countDistinct("symbol").alias("n_symbols"))


@query("rich_notation_scopes", _FSQ + "select document_id, symbol, section_id, case when count(distinct formula_id) > 1 then 78 else 55 end as confidence from fs where section_id is not null group by 1, 2, 3")
def _(s, d):
    v = fs(s, d).where("section_id is not null").groupBy("document_id", "symbol", "section_id").agg(F.countDistinct("formula_id").alias("n"))
    return v.select("document_id", "symbol", "section_id", F.when(F.col("n") > 1, 78).otherwise(55).alias("confidence"))


@query("rich_relation_edges", sql("edges", "nodes") + "select e.document_id, e.edge_type, count(*) as n from edges e where exists (select 1 from nodes n where n.document_id = e.document_id and n.node_id = e.source_id) and exists (select 1 from nodes n where n.document_id = e.document_id and n.node_id = e.target_id) group by 1, 2")
def _(s, d):
    n = current(s, d, "nodes", "node_type").select("document_id", "node_id")
    e = current(s, d, "edges", "source_id", "target_id", "edge_type")
    both = e.join(n.withColumnRenamed("node_id", "source_id"), ["document_id", "source_id"], "left_semi").join(n.withColumnRenamed("node_id", "target_id"), ["document_id", "target_id"], "left_semi")
    return both.groupBy("document_id", "edge_type").agg(F.count(F.lit(1)).alias("n"))


@query("rich_entry_exit_points", sql("metavertices") + "select document_id, role, point, count(*) as n from (select document_id, 'entry' as role, unnest(entry_points) as point from metavertices union all select document_id, 'exit', unnest(exit_points) from metavertices) where point is not null group by 1, 2, 3")
def _(s, d):
    m = current(s, d, "metavertices", "entry_points", "exit_points")
    x = union(*[m.select("document_id", F.lit(r).alias("role"), F.explode(c).alias("point")) for r, c in (("entry", "entry_points"), ("exit", "exit_points"))])
    return x.where("point is not null").groupBy("document_id", "role", "point").agg(F.count(F.lit(1)).alias("n"))


@query("legacy_union_graph", sql("blocks", "formulas") + "select document_id, kind, count(*) as n from (select document_id, 'text' as kind from blocks union all select document_id, 'formula' from formulas) group by 1, 2")
def _(s, d):
    x = union(*[current(s, d, t, "ord").select("document_id", F.lit(k).alias("kind")) for t, k in (("blocks", "text"), ("formulas", "formula"))])
    return x.groupBy("document_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("corpus_edges", sql("edges") + "select document_id || '::' || source_id as source, document_id || '::' || target_id as target, edge_type from edges where source_id is not null and target_id is not null")
def _(s, d):
    id_ = lambda c: F.concat("document_id", F.lit("::"), c)
    return current(s, d, "edges", "source_id", "target_id", "edge_type").where("source_id is not null and target_id is not null").select(id_("source_id").alias("source"), id_("target_id").alias("target"), "edge_type")


@query("corpus_display", sql("nodes") + "select id, node_type from (select document_id || '::' || node_id as id, node_type from nodes) order by id limit 260")
def _(s, d):
    """First nodes of the display, in the order of their ids (a top-k of fixed size)."""
    return current(s, d, "nodes", "node_type").select(F.concat("document_id", F.lit("::"), "node_id").alias("id"), "node_type").orderBy("id").limit(260)


@query("corpus_coverage", _DEF.replace("with recursive ", "with recursive ", 1) + ", f as (select document_id, count(distinct formula_id) as n from formula_index group by 1) select f.document_id, round(coalesce(x.n, 0) / f.n, 6) as coverage from f left join (select document_id, count(distinct formula_id) as n from defs group by 1) x on x.document_id = f.document_id")
def _(s, d):
    """Share of a paper's formulas with a definition (formulas ever delivered)."""
    f = table(s, d, "formula_index", "document_id", "formula_id").groupBy("document_id").agg(F.countDistinct("formula_id").alias("n"))
    x = definitions(s, d).groupBy("document_id").agg(F.countDistinct("formula_id").alias("m"))
    return f.join(x, "document_id", "left").select("document_id", F.round(F.coalesce("m", F.lit(0)) / F.col("n"), 6).alias("coverage"))


@query("metric_summary", _F + "select round(avg(n), 6) as mean, min(n) as least, max(n) as most, sum(n) as total from (select document_id, count(*) as n from formulas group by 1)")
def _(s, d):
    return current(s, d, "formulas", "ord").groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).agg(F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("total"))


@query("metric_orphan_rate", sql("nodes", "edges") + ", g as (select distinct document_id, unnest([source_id, target_id]) as node_id from edges) select n.document_id, count(*) as nodes, count_if(g.node_id is null) as orphans from nodes n left join g on g.document_id = n.document_id and g.node_id = n.node_id group by 1")
def _(s, d):
    g = current(s, d, "edges", "source_id", "target_id").select("document_id", F.explode(F.array("source_id", "target_id")).alias("node_id")).where("node_id is not null").distinct().withColumn("g", F.lit(1))
    return current(s, d, "nodes", "node_type").join(g, ["document_id", "node_id"], "left").groupBy("document_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("g").isNull()).alias("orphans"))


@query("metric_roles", sql("metaedges") + "select metaedge_type, role, count(*) as n from (select metaedge_type, 'source' as role, unnest(source_set) as m from metaedges union all select metaedge_type, 'target', unnest(target_set) from metaedges) group by 1, 2")
def _(s, d):
    m = current(s, d, "metaedges", "metaedge_type", "source_set", "target_set")
    x = union(*[m.select("metaedge_type", F.lit(r).alias("role"), F.explode(c).alias("m")) for r, c in (("source", "source_set"), ("target", "target_set"))])
    return x.groupBy("metaedge_type", "role").agg(F.count(F.lit(1)).alias("n"))


@query("valid_dangling_sources", sql("nodes", "edges", "metavertices") + ", t as (select document_id, node_id as id from nodes union select document_id, metavertex_id from metavertices) select e.document_id, e.edge_id from edges e where e.source_id is not null and not exists (select 1 from t where t.document_id = e.document_id and t.id = e.source_id)")
def _(s, d):
    t = union(current(s, d, "nodes", "node_type").select("document_id", F.col("node_id").alias("source_id")), current(s, d, "metavertices", "mv_type").select("document_id", F.col("metavertex_id").alias("source_id")))
    return current(s, d, "edges", "source_id").where("source_id is not null").join(t, ["document_id", "source_id"], "left_anti").select("document_id", "edge_id")


@query("valid_units_without_symbols", _F + "select document_id, formula_id from formulas where coalesce(len(symbols), 0) = 0")
def _(s, d):
    return current(s, d, "formulas", "symbols").where((F.col("symbols").isNull()) | (F.size("symbols") == 0)).select("document_id", "formula_id")


# ---- lookups, selections, updates ---------------------------------------------------------------------------------


@query("search_best_variable", _FSQ + "select document_id, arg_max(symbol, {'n': n, 's': symbol}) as symbol, max(n) as n from (select document_id, symbol, count(*) as n from fs group by 1, 2) group by 1")
def _(s, d):
    v = fs(s, d).groupBy("document_id", "symbol").agg(F.count(F.lit(1)).alias("n"))
    return v.groupBy("document_id").agg(F.max_by("symbol", F.struct("n", "symbol")).alias("symbol"), F.max("n").alias("n"))


@query("proj_type_selection", sql("nodes") + "select document_id, node_id, r from (select document_id, node_id, row_number() over (partition by document_id, node_type order by node_id) as r from nodes where node_type in ('formula', 'symbol', 'definition')) where r <= 40")
def _(s, d):
    w = Window.partitionBy("document_id", "node_type").orderBy("node_id")
    return current(s, d, "nodes", "node_type").where("node_type in ('formula', 'symbol', 'definition')").withColumn("r", F.row_number().over(w)).where("r <= 40").select("document_id", "node_id", "r")


@query("proj_lane_members", sql("metaedges") + "select document_id, metaedge_id, pos - 1 as pos, m as member from (select document_id, metaedge_id, unnest(range(1, least(8, len(source_set)) + 1)) as pos, unnest(source_set[1:8]) as m from metaedges where source_set is not null)")
def _(s, d):
    x = current(s, d, "metaedges", "source_set").select("document_id", "metaedge_id", F.posexplode(F.slice("source_set", 1, 8)).alias("pos", "member"))
    return x.select("document_id", "metaedge_id", F.col("pos").cast("long").alias("pos"), "member")


@query("ops_json_confidence", "select distinct document_id, edge_id, least(1.0, greatest(0.0, coalesce(try_cast(json_extract_string(attributes, '$.confidence') as double), 0.0))) as confidence from mg_edges where json_valid(attributes)")
def _(s, d):
    """Confidence out of open attributes, clamped; what is no JSON is left out."""
    v = F.col("v.confidence").cast("double")
    x = table(s, d, "mg_edges", "document_id", "edge_id", "attributes").withColumn("v", F.from_json("attributes", "confidence double, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return x.where("attributes is not null and v._bad is null").select("document_id", "edge_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(v, F.lit(0.0)))).alias("confidence")).distinct()


@query("ops_main_source", "select paper_id, arg_max(doc_id, {'s': round(case when contains(text, '\\section') then 3 else 0 end + least(3.0, length(text) / 100000.0), 6), 'd': -doc_id}) as doc_id from documents where paper_id is not null and text is not null group by 1")
def _(s, d):
    """Main text of each paper by score; ties go to the smaller id."""
    x = table(s, d, "documents", "paper_id", "doc_id", "text").where("paper_id is not null and text is not null")
    score = F.round(F.when(F.contains("text", F.lit("\\section")), 3).otherwise(0) + F.least(F.lit(3.0), F.length("text") / 100000.0), 6)
    return x.groupBy("paper_id").agg(F.max_by("doc_id", F.struct(score.alias("s"), (-F.col("doc_id")).alias("d"))).alias("doc_id"))


@query("ops_first_per_paper", "select paper_id, min(doc_id) as doc_id, count(*) as n from documents where paper_id is not null group by 1")
def _(s, d):
    return table(s, d, "documents", "paper_id", "doc_id").where("paper_id is not null").groupBy("paper_id").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("ops_latest_delivery", "select document_id, formula_id, max(loaded_at) as seen, count(*) as deliveries, bool_or(deleted_at is not null) as ever_deleted from formula_index group by 1, 2")
def _(s, d):
    x = table(s, d, "formula_index", "document_id", "formula_id", "loaded_at", "deleted_at")
    return x.groupBy("document_id", "formula_id").agg(F.max("loaded_at").alias("seen"), F.count(F.lit(1)).alias("deliveries"), F.bool_or(F.col("deleted_at").isNotNull()).alias("ever_deleted"))


@query("ops_report_edges", sql("edges") + "select document_id, string_agg(edge_id, chr(10) order by edge_id) as lines from (select document_id, edge_id, row_number() over (partition by document_id order by edge_id) as r from edges) where r <= 20 group by 1")
def _(s, d):
    """First twenty edges of each paper as lines of a report."""
    w = Window.partitionBy("document_id").orderBy("edge_id")
    x = current(s, d, "edges", "edge_type").withColumn("r", F.row_number().over(w)).where("r <= 20")
    return x.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_list("edge_id")), "\n").alias("lines"))
