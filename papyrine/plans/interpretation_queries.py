"""Readings and interpretations of formulas, definitions by alias, relations and variables of documents, names and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.functions import latex, notation, text
from papyrine.operators import cleaning, reading
from papyrine.plans.base import current, sql
from papyrine.plans.definitions import DEFS, definitions
from papyrine.plans.graph_queries import _FS, fs
from papyrine.plans.more_queries import aliases
from papyrine.plans.text_queries import _NEAR, _any
from papyrine.sources.tables import table

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


# ---- readings -----------------------------------------------------------------------------------------------------


def _readings(s: SparkSession, d: str) -> DataFrame:
    f = current(s, d, "formulas", "latex").withColumn("latex", latex.normalized(F.col("latex")))
    return cleaning.applied(f.where("latex is not null"), ["document_id", "formula_id", "latex"], "latex", {"plain_text": (reading.plain, "string")})


@query("latex_plain_text")
def _(s, d):
    """Every formula in words."""
    return _readings(s, d).select("document_id", "formula_id", "plain_text")


@query("latex_interpretations")
def _(s, d):
    """Kind, reading, summary and confidence of every formula with the variables and definitions near it."""
    key = ["document_id", "formula_id"]
    v = fs(s, d).groupBy(*key).agg(F.array_sort(F.collect_set("symbol")).alias("variables"))
    said = definitions(s, d).select(*key, "symbol", "definition").join(fs(s, d).select(*key, "symbol").distinct(), [*key, "symbol"], "left_semi")
    x = said.groupBy(*key, "symbol").agg(F.min("definition").alias("definition")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("symbol", "definition"))).alias("said"))
    j = _readings(s, d).join(current(s, d, "contexts", "current_sentence"), key, "left").join(v, key, "left").join(x, key, "left")
    none, nothing = F.array().cast("array<string>"), F.array().cast("array<struct<symbol: string, definition: string>>")
    variables, found = F.coalesce("variables", none), F.coalesce("said", nothing)
    kind = latex.kind(F.col("latex"), F.col("current_sentence"))
    return j.select(*key, kind.alias("kind"), "plain_text", reading.summary(kind, F.col("plain_text"), variables, found).alias("summary"), reading.confidence(F.col("latex"), F.col("current_sentence"), F.size(found) > 0).alias("confidence"))


# ---- definitions and relations ------------------------------------------------------------------------------------

#: What follows a symbol, or its spelling, where it is defined; fixed values.
_ALIAS_PATTERNS = [(r"(?i)(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])\s+(?:denotes|denote|represents|is defined as|is)\s+([^.;,\n]{2,120})"), (r"(?iu)(?:where|где)\s+(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])\s*(?:[-–—]|:|,)?\s*([^.;\n]{2,120})"), (r"(?iu)(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])\s+(?:обозначает|определяется как|задается как|задаётся как)\s+([^.;,\n]{2,120})")]


@query("def_possible")
def _(s, d):
    """Possible definitions of the symbols of each formula: those by rule, then those by any spelling of the symbol, each meaning once."""
    key = ["document_id", "formula_id", "symbol"]
    symbols = fs(s, d).select(*key).distinct()
    by_rule = definitions(s, d).join(symbols, key, "left_semi").select(*key, "definition", "confidence", F.lit(0).alias("tier"))
    said = symbols.join(current(s, d, "contexts", "current_sentence").where("current_sentence is not null"), ["document_id", "formula_id"])
    spelled = said.select(*key, "current_sentence", F.explode(aliases(F.col("symbol"))).alias("spelling"))
    literal = F.regexp_replace(F.regexp_replace("spelling", r"^\\+", ""), r"([^A-Za-z0-9_\s])", r"\\$1")
    found = F.array_compact(F.array(*[F.nullif(F.call_function("regexp_extract", F.col("current_sentence"), F.concat(F.lit(a), literal, F.lit(b)), F.lit(1)), F.lit("")) for a, b in _ALIAS_PATTERNS]))
    by_alias = spelled.select(*key, F.explode(found).alias("definition")).select(*key, text.collapse(F.col("definition")).alias("definition"), F.lit(0.72).alias("confidence"), F.lit(1).alias("tier"))
    every = by_rule.unionByName(by_alias).where("definition <> ''")
    once = every.groupBy(*key, F.lower("definition").alias("meaning")).agg(F.min(F.struct("tier", "definition", "confidence")).alias("r"))
    return once.select(*key, "r.definition", "r.confidence")


@query("rel_structured", sql("formulas", "contexts", "blocks") + _FS + f""", n as (select distinct f.document_id, f.formula_id, t.block_id from formulas f join (select document_id, block_id, unnest(formula_tokens) as token from blocks) t on t.document_id = f.document_id and t.token = f.token),
k as (select f.document_id, f.formula_id, {_any(_NEAR, notation.DEFINITION_MARKERS)} as marked from formulas f join contexts c on c.document_id = f.document_id and c.formula_id = f.formula_id)
select * replace (cast(confidence as double) as confidence) from (select 'has_context' as type, document_id, formula_id as source_id, 'ctx:' || formula_id as target_id, 0.78 as confidence from k
union all select 'near_text', n.document_id, n.formula_id, n.block_id, 0.62 from n join k on k.document_id = n.document_id and k.formula_id = n.formula_id
union all select distinct 'contains_symbol', document_id, formula_id, symbol, 0.7 from fs
union all select distinct 'possibly_defined_by', fs.document_id, fs.symbol, 'ctx:' || fs.formula_id, 0.58 from fs join k on k.document_id = fs.document_id and k.formula_id = fs.formula_id where k.marked)""")
def _(s, d):
    """The four relations of a structured document: contexts, near texts, symbols, and symbols that a context may define."""
    key = ["document_id", "formula_id"]
    f = current(s, d, "formulas", "token")
    c = current(s, d, "contexts", "current_sentence").join(f.select(*key), key, "left_semi").withColumn("ctx", F.concat(F.lit("ctx:"), "formula_id"))
    t = current(s, d, "blocks", "formula_tokens").select("document_id", "block_id", F.explode("formula_tokens").alias("token")).where("token is not null")
    near = f.join(t, ["document_id", "token"]).join(c.select(*key), key, "left_semi").select(*key, "block_id").distinct()
    own = fs(s, d).select(*key, "symbol").distinct()
    marked = own.join(c.where(latex.holds_any(F.lower("current_sentence"), notation.DEFINITION_MARKERS)), key)
    row = lambda x, kind, a, b, k: x.select(F.lit(kind).alias("type"), "document_id", F.col(a).alias("source_id"), F.col(b).alias("target_id"), F.lit(k).alias("confidence"))
    parts = [row(c, "has_context", "formula_id", "ctx", 0.78), row(near, "near_text", "formula_id", "block_id", 0.62), row(own, "contains_symbol", "formula_id", "symbol", 0.7), row(marked, "possibly_defined_by", "symbol", "ctx", 0.58)]
    return reduce(DataFrame.unionByName, parts)


@query("var_table", sql("formulas", "contexts") + DEFS + _FS + """, c as (select document_id, formula_id from contexts), m as (select document_id, symbol, count(distinct lower(definition)) as n from defs group by 1, 2)
select v.document_id, v.symbol, 'var_' || lpad(cast(row_number() over (partition by v.document_id order by v.symbol) as varchar), 4, '0') as var_id, v.n_formulas, v.n_contexts, coalesce(m.n, 0) as n_definitions, v.n_sections,
case when v.n_sections = 1 then 'section' when v.n_sections > 1 then 'document' when v.n_contexts > 0 then 'paragraph' else 'document' end as level, cast(case when m.n > 0 then 0.78 else 0.55 end as double) as confidence
from (select fs.document_id, fs.symbol, count(distinct fs.formula_id) as n_formulas, count(distinct c.formula_id) as n_contexts, count(distinct fs.section_id) as n_sections from fs left join c on c.document_id = fs.document_id and c.formula_id = fs.formula_id group by 1, 2) v left join m on m.document_id = v.document_id and m.symbol = v.symbol""")
def _(s, d):
    """Variables with their uses, contexts, meanings, and the scope that follows: a section, the document, or a paragraph."""
    key = ["document_id", "symbol"]
    c = current(s, d, "contexts", "lang_label").select("document_id", "formula_id", F.col("formula_id").alias("c"))
    v = fs(s, d).join(c, ["document_id", "formula_id"], "left").groupBy(*key).agg(F.countDistinct("formula_id").alias("n_formulas"), F.countDistinct("c").alias("n_contexts"), F.countDistinct("section_id").alias("n_sections"))
    m = definitions(s, d).groupBy(*key).agg(F.countDistinct(F.lower("definition")).alias("n"))
    w = Window.partitionBy("document_id").orderBy("symbol")
    level = F.when(F.col("n_sections") == 1, "section").when(F.col("n_sections") > 1, "document").when(F.col("n_contexts") > 0, "paragraph").otherwise("document")
    n = F.coalesce("n", F.lit(0))
    return v.join(m, key, "left").select(*key, F.concat(F.lit("var_"), F.lpad(F.row_number().over(w).cast("string"), 4, "0")).alias("var_id"), "n_formulas", "n_contexts", n.alias("n_definitions"), "n_sections", level.alias("level"), F.when(n > 0, 0.78).otherwise(0.55).alias("confidence"))


# ---- names and labels ---------------------------------------------------------------------------------------------

#: Lengths of labels by what they label; fixed values.
LIMITS = {"node": 24, "formula": 10, "symbol": 12, "section": 34, "metaedge": 28, "object": 16}


def short(c: Column, limit: int) -> Column:
    """A label of at most so many characters, white space collapsed, the last one three dots in one where it is cut."""
    c = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit - 1), F.lit("…")))


def object_type(c: Column) -> Column:
    """What an id stands for, by the words in it."""
    low = F.lower(c)
    return (
        F.when(F.contains(low, F.lit("formula")) | low.rlike(r"\bf\d+\b"), "formula").when(F.contains(low, F.lit("definition")), "definition").when(latex.holds_any(low, ["context", "sentence", "text"]), "context")
        .when(F.contains(low, F.lit("section")), "section").otherwise("variable")
    )


def _short_sql(c: str, n: int) -> str:
    x = f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"
    return f"case when length({x}) <= {n} then {x} else substr({x}, 1, {n - 1}) || '…' end"


@query("ops_short_labels", sql("nodes") + "select document_id, node_id, " + ", ".join(f"{_short_sql('node_label', n)} as label_{k}" for k, n in LIMITS.items()) + ", case when contains(lower(node_id), 'formula') or regexp_matches(lower(node_id), '\\bf\\d+\\b') then 'formula' when contains(lower(node_id), 'definition') then 'definition' when contains(lower(node_id), 'context') or contains(lower(node_id), 'sentence') or contains(lower(node_id), 'text') then 'context' when contains(lower(node_id), 'section') then 'section' else 'variable' end as kind from nodes")
def _(s, d):
    """Labels of nodes at every length that a display has, and what their ids stand for."""
    return current(s, d, "nodes", "node_label").select("document_id", "node_id", *[short(F.col("node_label"), n).alias(f"label_{k}") for k, n in LIMITS.items()], object_type(F.col("node_id")).alias("kind"))


@query("ops_formula_sources", sql("formulas") + "select document_id, formula_id, case kind when 'inline' then 'inline_math' when 'block' then 'display_math' when 'display' then 'display_math' else case when kind in ('inline_math', 'display_math') then kind else 'unknown' end end as kind, case text_source " + " ".join(f"when '{k}' then '{v}'" for k, v in notation.SOURCES.items()) + " else coalesce(nullif(text_source, ''), 'unknown') end as source from formulas")
def _(s, d):
    """Kinds and sources of formulas by the names that documents use."""
    kind = F.when(F.col("kind").isin("inline", "inline_math"), "inline_math").when(F.col("kind").isin("block", "display", "display_math"), "display_math").otherwise("unknown")
    source = reduce(lambda a, kv: a.when(F.col("text_source") == kv[0], kv[1]), notation.SOURCES.items(), F).otherwise(F.coalesce(F.nullif("text_source", F.lit("")), F.lit("unknown")))
    return current(s, d, "formulas", "kind", "text_source").select("document_id", "formula_id", kind.alias("kind"), source.alias("source"))


_STEM = "coalesce(nullif(substr(trim(regexp_replace(title, '[^A-Za-z0-9А-Яа-я_.-]+', '_', 'g'), '._-'), 1, 80), ''), 'document')"


@query("ops_document_ids", f"""select document_id, case when n = 1 then base else base || '_' || n end as new_id from (select document_id, base, row_number() over (partition by base order by document_id) as n
from (select document_id, {_STEM} || '_' || strftime(seen, '%Y%m%d_%H%M%S') || '_pdf' as base from (select document_id, min(loaded_at) as seen, coalesce(max(title), 'document') as title from paper_profiles where document_id is not null group by 1)))""")
def _(s, d):
    """Ids of papers by title, first arrival and suffix; of those that would be the same, the second and later ones are numbered."""
    p = table(s, d, "paper_profiles", "document_id", "title", "loaded_at").where("document_id is not null").groupBy("document_id").agg(F.min("loaded_at").alias("seen"), F.coalesce(F.max("title"), F.lit("document")).alias("title"))
    stem = F.substring(F.btrim(F.regexp_replace("title", "[^A-Za-z0-9А-Яа-я_.-]+", "_"), F.lit("._-")), 1, 80)
    base = F.concat(F.coalesce(F.nullif(stem, F.lit("")), F.lit("document")), F.lit("_"), F.date_format("seen", "yyyyMMdd_HHmmss"), F.lit("_pdf"))
    x = p.select("document_id", base.alias("base")).withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy("document_id")))
    return x.select("document_id", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("n").cast("string"))).alias("new_id"))


# ---- places -------------------------------------------------------------------------------------------------------


_GAP = "abs((h.x0 + h.x1) / 2 - (o.x0 + o.x1) / 2) * 0.05"
_BOX = "bbox.x0 as x0, bbox.y0 as y0, bbox.x1 as x1, bbox.y1 as y1"


@query("geo_context_blocks", sql("layers") + f""", b as (select document_id, page_number, block_id, block_role, {_BOX} from layers where bbox is not null),
p as (select h.document_id, h.block_id as heading_id, o.block_id, case when o.y1 <= h.y0 then 'above' when o.y0 >= h.y1 then 'below' else 'beside' end as side,
case when o.y1 <= h.y0 then h.y0 - o.y1 + {_GAP} when o.y0 >= h.y1 then o.y0 - h.y1 + {_GAP} else abs((h.x0 + h.x1) / 2 - (o.x0 + o.x1) / 2) + abs((h.y0 + h.y1) / 2 - (o.y0 + o.y1) / 2) end as gap
from b h join b o on o.document_id = h.document_id and o.page_number = h.page_number and o.block_id <> h.block_id where h.block_role = 'heading'),
g as (select document_id, heading_id, list_sort(list({{'g': round(gap, 6), 'b': block_id}}) filter (side = 'above'))[1].b as above, list_sort(list({{'g': round(gap, 6), 'b': block_id}}) filter (side = 'below'))[1].b as below, coalesce(list_sort(list({{'g': round(gap, 6), 'b': block_id}}) filter (side = 'beside')), []) as beside from p group by 1, 2)
select document_id, heading_id, coalesce(above, beside[1].b) as above_id, coalesce(below, case when above is null then beside[2].b else beside[1].b end) as below_id from g""")
def _(s, d):
    """Blocks above and below each heading of a page: the nearest by gap and a little of the sideways distance; where there is none, one that overlaps it."""
    b = current(s, d, "layers", "page_number", "bbox", "block_role").where("bbox is not null")
    h = b.where("block_role = 'heading'").select("document_id", "page_number", F.col("block_id").alias("heading_id"), F.col("bbox").alias("h"))
    p = h.join(b.select("document_id", "page_number", "block_id", F.col("bbox").alias("o")), ["document_id", "page_number"]).where("block_id <> heading_id")
    dx = F.abs((F.col("h.x0") + F.col("h.x1")) / 2 - (F.col("o.x0") + F.col("o.x1")) / 2)
    dy = F.abs((F.col("h.y0") + F.col("h.y1")) / 2 - (F.col("o.y0") + F.col("o.y1")) / 2)
    above, below = F.col("o.y1") <= F.col("h.y0"), F.col("o.y0") >= F.col("h.y1")
    at = lambda gap: F.struct(F.round(gap, 6).alias("g"), F.col("block_id").alias("b"))
    first = F.min(F.when(above, at(F.col("h.y0") - F.col("o.y1") + dx * 0.05)))
    last = F.min(F.when(~above & below, at(F.col("o.y0") - F.col("h.y1") + dx * 0.05)))
    beside = F.array_sort(F.collect_list(F.when(~above & ~below, at(dx + dy))))  # blocks of one page that overlap one of it
    g = p.groupBy("document_id", "heading_id").agg(first["b"].alias("above"), last["b"].alias("below"), beside.alias("beside"))
    near = lambda i: F.get("beside", F.lit(i))["b"]
    return g.select("document_id", "heading_id", F.coalesce("above", near(0)).alias("above_id"), F.coalesce("below", F.when(F.col("above").isNull(), near(1)).otherwise(near(0))).alias("below_id"))
