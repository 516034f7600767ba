"""Layout, relations, search, metagraphs, corpus, metrics, validation and projections over the current paper tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.functions import latex, notation
from papyrine.operators import geometry, graph, search
from papyrine.plans.base import current, sql
from papyrine.plans.definitions import DEF, DEFS, definitions
from papyrine.plans.text_queries import _GREEK, _NEAR, _OPS, _any, symbol_sql, symbols
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
_FS = f", fs as (select distinct document_id, formula_id, ord, section_id, {_GREEK} as symbol from (select document_id, formula_id, ord, section_id, unnest(symbols) as x from formulas) where {_GREEK} is not null)\n"
_FSQ = sql("formulas") + _FS


def fs(s: SparkSession, d: str) -> DataFrame:
    return symbols(s, d, "ord", "section_id")


#: Columns that DuckDB makes decimals of, where Spark has doubles.
_DOUBLES = {"rel_has_context": "confidence", "rel_all": "confidence", "sem_sequence": "weight", "sem_same_context": "weight", "rich_node_mass": "mass", "legacy_source_reliability": "reliability", "proj_ambiguity": "score"}


# ---- layout -------------------------------------------------------------------------------------------------------


@query("geo_page_union", sql("layers") + "select document_id, page_number, min(bbox.x0) as x0, min(bbox.y0) as y0, max(bbox.x1) as x1, max(bbox.y1) as y1, count(*) as n from layers group by 1, 2")
def _(s, d):
    x = current(s, d, "layers", "page_number", "bbox")
    return x.groupBy("document_id", "page_number").agg(F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1"), F.count(F.lit(1)).alias("n"))


_IOU = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_AREA = "greatest(1.0, greatest(0, {0}.x1 - {0}.x0) * greatest(0, {0}.y1 - {0}.y0))"


@query("geo_neighbour_overlap", sql("layers") + f"""select document_id, block_id, next_id, round({_IOU} / ({_AREA.format('a')} + {_AREA.format('b')} - {_IOU}), 6) as iou, round({_IOU} / least({_AREA.format('a')}, {_AREA.format('b')}), 6) as overlap
from (select document_id, block_id, bbox as a, lead(block_id) over w as next_id, lead(bbox) over w as b from layers where bbox is not null window w as (partition by document_id, page_number order by bbox.y0, bbox.x0, block_id)) where next_id is not null""")
def _(s, d):
    w = Window.partitionBy("document_id", "page_number").orderBy("bbox.y0", "bbox.x0", "block_id")
    x = current(s, d, "layers", "page_number", "bbox").where("bbox is not null").withColumn("next_id", F.lead("block_id").over(w)).withColumn("b", F.lead("bbox").over(w)).where("next_id is not null")
    a, b = F.col("bbox"), F.col("b")
    return x.select("document_id", "block_id", "next_id", F.round(geometry.iou(a, b), 6).alias("iou"), F.round(geometry.overlap(a, b), 6).alias("overlap"))


_DIST = "coalesce(abs((h.bbox.x0 + h.bbox.x1) - (o.bbox.x0 + o.bbox.x1)) / 2 + abs((h.bbox.y0 + h.bbox.y1) - (o.bbox.y0 + o.bbox.y1)) / 2, 1e7)"


@query("geo_nearest_block", sql("layers") + f"""select document_id, heading_id, block_id, round(dist, 4) as dist from (select h.document_id, h.block_id as heading_id, o.block_id, {_DIST} as dist, row_number() over (partition by h.document_id, h.block_id order by {_DIST}, o.block_id) as r
from layers h join layers o on o.document_id = h.document_id and o.page_number = h.page_number and o.block_id <> h.block_id where h.block_role = 'heading') where r = 1""")
def _(s, d):
    """Nearest block of each heading on its page (pages are small, so pairs of a page are few)."""
    x = current(s, d, "layers", "page_number", "bbox", "block_role")
    h = x.where("block_role = 'heading'").select("document_id", "page_number", F.col("block_id").alias("heading_id"), F.col("bbox").alias("hb"))
    p = h.join(x, ["document_id", "page_number"]).where("block_id <> heading_id").withColumn("dist", geometry.distance(F.col("hb"), F.col("bbox")))
    best = p.groupBy("document_id", "heading_id").agg(F.min(F.struct("dist", "block_id")).alias("b"))
    return best.select("document_id", "heading_id", F.col("b.block_id").alias("block_id"), F.round("b.dist", 4).alias("dist"))


@query("geo_scale_to_points", sql("layers") + "select document_id, block_id, round(bbox.x0 * 72.0 / 300, 4) as x0, round(bbox.y1 * 72.0 / 300, 4) as y1 from layers")
def _(s, d):
    b = geometry.scaled(F.col("bbox"), F.lit(300))
    return current(s, d, "layers", "bbox").select("document_id", "block_id", F.round(b["x0"], 4).alias("x0"), F.round(b["y1"], 4).alias("y1"))


@query("geo_regions")
def _(s, d):
    return geometry.greedy_regions(current(s, d, "layers", "page_number", "bbox"), "document_id string, page_number int, block_id string, region int")


@query("order_reading", sql("layers") + "select document_id, block_id, row_number() over (partition by document_id order by page_number nulls first, case when bbox.x0 > 540 and (bbox.x0 + bbox.x1) / 2 > 600 then 1 else 0 end, coalesce(bbox.y0, 1e7), coalesce(bbox.x0, 1e7), block_id) as position from layers")
def _(s, d):
    return geometry.reading_order(current(s, d, "layers", "page_number", "bbox")).select("document_id", "block_id", "position")


@query("order_previous_next", sql("blocks") + """select document_id, block_id, last_value(case when block_type = 'paragraph' then block_id end ignore nulls) over (partition by document_id order by ord, block_id rows between unbounded preceding and 1 preceding) as previous_id,
first_value(case when block_type = 'paragraph' then block_id end ignore nulls) over (partition by document_id order by ord, block_id rows between 1 following and unbounded following) as next_id from blocks""")
def _(s, d):
    w = Window.partitionBy("document_id").orderBy("ord", "block_id")
    text_id = F.when(F.col("block_type") == "paragraph", F.col("block_id"))
    back, on = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    return current(s, d, "blocks", "block_type", "ord").select("document_id", "block_id", F.last(text_id, ignorenulls=True).over(back).alias("previous_id"), F.first(text_id, ignorenulls=True).over(on).alias("next_id"))


@query("order_section_ranges", sql("sections") + "select document_id, section_id, ord as start_ord, lead(ord) over (partition by document_id order by ord, section_id) - 1 as end_ord from sections")
def _(s, d):
    w = Window.partitionBy("document_id").orderBy("ord", "section_id")
    return current(s, d, "sections", "ord").select("document_id", "section_id", F.col("ord").alias("start_ord"), (F.lead("ord").over(w) - 1).alias("end_ord"))


@query("order_section_fill", sql("blocks") + "select document_id, block_id, last_value(section_id ignore nulls) over (partition by document_id order by ord, block_id rows between unbounded preceding and current row) as filled from blocks")
def _(s, d):
    w = Window.partitionBy("document_id").orderBy("ord", "block_id").rowsBetween(Window.unboundedPreceding, 0)
    return current(s, d, "blocks", "section_id", "ord").select("document_id", "block_id", F.last("section_id", ignorenulls=True).over(w).alias("filled"))


@query("order_section_text", sql("blocks") + "select document_id, section_id, string_agg(text_with_tokens, chr(10) order by ord, block_id) as body from blocks where section_id is not null and text_with_tokens is not null group by 1, 2")
def _(s, d):
    x = current(s, d, "blocks", "section_id", "ord", "text_with_tokens").where("section_id is not null and text_with_tokens is not null")
    parts = F.array_sort(F.collect_list(F.struct("ord", "block_id", "text_with_tokens")))
    return x.groupBy("document_id", "section_id").agg(F.array_join(F.transform(parts, lambda r: r["text_with_tokens"]), "\n").alias("body"))


@query("order_paragraphs", sql("blocks") + "select document_id, paragraph_id, count(*) as n_blocks, min(ord) as first_ord, sum(length(text)) as n_chars from blocks where paragraph_id is not null and block_type in ('paragraph', 'unknown', 'abstract') group by 1, 2")
def _(s, d):
    x = current(s, d, "blocks", "paragraph_id", "block_type", "ord", "text").where("paragraph_id is not null and block_type in ('paragraph', 'unknown', 'abstract')")
    return x.groupBy("document_id", "paragraph_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.min("ord").alias("first_ord"), F.sum(F.length("text")).alias("n_chars"))


@query("order_structure", sql("blocks") + "select document_id, section_id, count(distinct block_id) as n_blocks, count(distinct token) as n_tokens from (select document_id, section_id, block_id, unnest(case when len(formula_tokens) > 0 then formula_tokens else [null] end) as token from blocks where section_id is not null) group by 1, 2")
def _(s, d):
    x = current(s, d, "blocks", "section_id", "formula_tokens").where("section_id is not null").select("document_id", "section_id", "block_id", F.explode_outer("formula_tokens").alias("token"))
    return x.groupBy("document_id", "section_id").agg(F.countDistinct("block_id").alias("n_blocks"), F.countDistinct("token").alias("n_tokens"))


@query("order_normalized_blocks", sql("blocks") + "select document_id, block_id, 'tb_' || lpad(cast(row_number() over (partition by document_id order by ord, block_id) as varchar), 4, '0') as new_id, case when coalesce(trim(text), '') = '' then 'text_missing' when block_type = 'unknown' then 'kind_unknown' else 'ok' end as flag from blocks")
def _(s, d):
    w = Window.partitionBy("document_id").orderBy("ord", "block_id")
    flag = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "text_missing").when(F.col("block_type") == "unknown", "kind_unknown").otherwise("ok")
    return current(s, d, "blocks", "ord", "text", "block_type").select("document_id", "block_id", F.concat(F.lit("tb_"), F.lpad(F.row_number().over(w).cast("string"), 4, "0")).alias("new_id"), flag.alias("flag"))


@query("merge_distinct_blocks", sql("layers") + "select document_id, page_number, min(block_id) as block_id, count(*) as n from (select *, lower(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))) as k from layers where text is not null) group by document_id, page_number, k")
def _(s, d):
    from papyrine.functions.text import collapse

    x = current(s, d, "layers", "page_number", "text").where("text is not null").withColumn("k", F.lower(collapse(F.col("text"))))
    return x.groupBy("document_id", "page_number", "k").agg(F.min("block_id").alias("block_id"), F.count(F.lit(1)).alias("n")).drop("k")


_RANK = "case text_source when 'tex_source' then 5 when 'pp_formula_net' then 4 when 'text_pattern' then 3 else 0 end"


@query("merge_by_token", sql("formulas") + f"select document_id, token, arg_max(formula_id, {{'a': {_RANK}, 'b': coalesce(confidence, 0.0), 'c': formula_id}}) as formula_id, count(*) as n from formulas where token is not null group by 1, 2")
def _(s, d):
    """Representative of each token: best source, then confidence, then id."""
    x = current(s, d, "formulas", "token", "text_source", "confidence").where("token is not null")
    key = F.struct(F.expr(_RANK).alias("a"), F.coalesce("confidence", F.lit(0.0)).alias("b"), F.col("formula_id").alias("c"))
    return x.groupBy("document_id", "token").agg(F.max_by("formula_id", key).alias("formula_id"), F.count(F.lit(1)).alias("n"))


@query("merge_reindexed", sql("formulas") + "select document_id, formula_id, 'f_' || cast(row_number() over (partition by document_id order by section_id nulls first, ord nulls first, formula_id) as varchar) as new_id from formulas")
def _(s, d):
    w = Window.partitionBy("document_id").orderBy("section_id", "ord", "formula_id")
    return current(s, d, "formulas", "section_id", "ord").select("document_id", "formula_id", F.concat(F.lit("f_"), F.row_number().over(w).cast("string")).alias("new_id"))


# ---- relations ----------------------------------------------------------------------------------------------------


@query("rel_has_context", sql("formulas", "contexts") + "select document_id, formula_id, round(case when c then 0.78 else 0.45 end, 2) as confidence from (select f.document_id, f.formula_id, c.formula_id is not null as c from formulas f left join contexts c on c.document_id = f.document_id and c.formula_id = f.formula_id)")
def _(s, d):
    f, c = current(s, d, "formulas", "ord"), current(s, d, "contexts", "lang_label").withColumn("c", F.lit(True)).drop("lang_label")
    return f.join(c, ["document_id", "formula_id"], "left").select("document_id", "formula_id", F.when(F.col("c"), 0.78).otherwise(0.45).alias("confidence"))


@query("rel_contains_symbol", _FSQ + "select document_id, formula_id, symbol from fs")
def _(s, d):
    return fs(s, d).select("document_id", "formula_id", "symbol")


@query("rel_nearby", sql("formulas") + "select document_id, source_id, target_id from (select document_id, formula_id as source_id, lead(formula_id) over (partition by document_id order by ord, formula_id) as target_id from formulas) where target_id is not null")
def _(s, d):
    return graph.consecutive(current(s, d, "formulas", "ord"), ["document_id"], ["ord", "formula_id"], "formula_id")


@query("rel_references", sql("blocks", "formulas") + """select distinct b.document_id, b.block_id, f.formula_id from (select distinct document_id, block_id, unnest(regexp_extract_all(text, '\\(([0-9]+)\\)', 1)) as ref from blocks) b
join formulas f on f.document_id = b.document_id and cast(f.ord as varchar) = b.ref""")
def _(s, d):
    """Blocks to the formulas whose number they name in parentheses."""
    b = current(s, d, "blocks", "text").select("document_id", "block_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\(([0-9]+)\)"), 1))).alias("ref"))
    f = current(s, d, "formulas", "ord").select("document_id", "formula_id", F.col("ord").cast("string").alias("ref"))
    return b.join(f, ["document_id", "ref"]).select("document_id", "block_id", "formula_id").distinct()


#: Budget of links by common symbols: formulas of a symbol, links of a document; fixed values.
SAME_SYMBOL_FORMULAS, SAME_SYMBOL_LINKS = 48, 2500


@query("rel_same_symbols", _FSQ + f""", r as (select *, row_number() over (partition by document_id, symbol order by ord nulls first, formula_id) as r from fs),
sr as (select document_id, symbol, row_number() over (partition by document_id order by ord nulls first, formula_id, symbol) as sr from r where r = 1),
p as (select a.document_id, a.formula_id as source_id, b.formula_id as target_id, min({{'s': sr.sr, 'b': b.r, 'a': a.r, 'symbol': a.symbol}}) as k from r a join r b on a.document_id = b.document_id and a.symbol = b.symbol and a.r > b.r
join sr on sr.document_id = a.document_id and sr.symbol = a.symbol where a.r <= {SAME_SYMBOL_FORMULAS} and b.r <= {SAME_SYMBOL_FORMULAS} group by 1, 2, 3)
select document_id, source_id, target_id, symbol from (select document_id, source_id, target_id, k.symbol as symbol, row_number() over (partition by document_id order by k.s, k.b, k.a) as n from p) where n <= {SAME_SYMBOL_LINKS}""")
def _(s, d):
    """Later to earlier formula of a document with a symbol in common, within the budget; rel_symbol_classes has all of them."""
    f = fs(s, d)
    w = Window.partitionBy("document_id", "symbol").orderBy("ord", "formula_id")
    r = f.withColumn("r", F.row_number().over(w)).where(F.col("r") <= SAME_SYMBOL_FORMULAS)
    first = Window.partitionBy("document_id").orderBy("ord", "formula_id", "symbol")
    sr = r.where("r = 1").withColumn("sr", F.row_number().over(first)).select("document_id", "symbol", "sr")
    r = r.join(sr, ["document_id", "symbol"])
    a = r.select("document_id", "symbol", "sr", F.col("formula_id").alias("source_id"), F.col("r").alias("ra"))
    b = r.select("document_id", "symbol", F.col("formula_id").alias("target_id"), F.col("r").alias("rb"))
    p = a.join(b, ["document_id", "symbol"]).where("ra > rb").groupBy("document_id", "source_id", "target_id").agg(F.min(F.struct("sr", "rb", "ra", "symbol")).alias("k"))
    n = Window.partitionBy("document_id").orderBy("k.sr", "k.rb", "k.ra")
    return p.withColumn("n", F.row_number().over(n)).where(F.col("n") <= SAME_SYMBOL_LINKS).select("document_id", "source_id", "target_id", F.col("k.symbol").alias("symbol"))


_DEF = DEF


@query("def_evidence", _DEF + "select document_id, formula_id, rule, confidence, symbol, definition from defs")
def _(s, d):
    return definitions(s, d)


@query("def_first_per_symbol", _DEF + "select document_id, symbol, arg_min(definition, {'f': formula_id, 'r': rule, 'd': definition}) as definition from defs group by 1, 2")
def _(s, d):
    return definitions(s, d).groupBy("document_id", "symbol").agg(F.min_by("definition", F.struct("formula_id", "rule", "definition")).alias("definition"))


@query("rel_all", sql("formulas", "contexts", "blocks") + _FS + """select 'formula_contains_variable' as relation, document_id, formula_id as source_id, symbol as target_id, 0.82 as confidence from fs
union all select 'formula_has_context', f.document_id, f.formula_id, 'ctx:' || f.formula_id, 0.8 from formulas f where exists (select 1 from contexts c where c.document_id = f.document_id and c.formula_id = f.formula_id)
union all select 'formula_in_section', document_id, formula_id, section_id, 0.85 from formulas where section_id is not null
union all select 'text_block_in_section', document_id, block_id, section_id, 0.85 from blocks where section_id is not null
union all select distinct 'formula_near_text_block', f.document_id, f.formula_id, t.block_id, 0.62 from formulas f join (select document_id, block_id, unnest(formula_tokens) as token from blocks) t on t.document_id = f.document_id and t.token = f.token""")
def _(s, d):
    f, c, b = current(s, d, "formulas", "section_id", "token"), current(s, d, "contexts", "lang_label"), current(s, d, "blocks", "section_id", "formula_tokens")
    t = b.select("document_id", "block_id", F.explode("formula_tokens").alias("token")).where("token is not null")
    near = f.join(t, ["document_id", "token"]).select("document_id", "formula_id", "block_id").distinct()
    row = lambda x, name, a, t, k: x.select(F.lit(name).alias("relation"), "document_id", F.col(a).alias("source_id"), t.alias("target_id"), F.lit(k).alias("confidence"))
    return union(
        row(fs(s, d), "formula_contains_variable", "formula_id", F.col("symbol"), 0.82),
        row(f.join(c, ["document_id", "formula_id"], "left_semi"), "formula_has_context", "formula_id", F.concat(F.lit("ctx:"), "formula_id"), 0.8),
        row(f.where("section_id is not null"), "formula_in_section", "formula_id", F.col("section_id"), 0.85),
        row(b.where("section_id is not null"), "text_block_in_section", "block_id", F.col("section_id"), 0.85), row(near, "formula_near_text_block", "formula_id", F.col("block_id"), 0.62),
    )


# ---- variables and search -----------------------------------------------------------------------------------------


@query("var_aggregate", _FSQ + "select document_id, symbol, 'var_' || lpad(cast(row_number() over (partition by document_id order by symbol) as varchar), 4, '0') as var_id, n_formulas, n_sections, case when n_sections = 1 then 'section' else 'document' end as scope from (select document_id, symbol, count(distinct formula_id) as n_formulas, count(distinct section_id) as n_sections from fs group by 1, 2)")
def _(s, d):
    v = fs(s, d).groupBy("document_id", "symbol").agg(F.countDistinct("formula_id").alias("n_formulas"), F.countDistinct("section_id").alias("n_sections"))
    w = Window.partitionBy("document_id").orderBy("symbol")
    return v.select("document_id", "symbol", F.concat(F.lit("var_"), F.lpad(F.row_number().over(w).cast("string"), 4, "0")).alias("var_id"), "n_formulas", "n_sections", F.when(F.col("n_sections") == 1, "section").otherwise("document").alias("scope"))


@query("search_variable_index", sql("formulas", "contexts") + DEFS + _FS + """, c as (select document_id, formula_id from contexts),
u as (select fs.document_id, fs.symbol, fs.formula_id, case when c.formula_id is not null then 'ctx:' || fs.formula_id end as context_id, cast(null as varchar) as definition from fs left join c on c.document_id = fs.document_id and c.formula_id = fs.formula_id
union all select document_id, symbol, cast(null as varchar), 'ctx:' || formula_id, definition from defs),
rel as (select a.document_id, a.symbol, string_agg(distinct b.symbol, '|' order by b.symbol) as related from fs a join fs b on a.document_id = b.document_id and a.formula_id = b.formula_id and a.symbol <> b.symbol group by 1, 2)
select u.document_id, u.symbol, coalesce(string_agg(distinct u.formula_id, '|' order by u.formula_id), '') as formulas, coalesce(string_agg(distinct u.context_id, '|' order by u.context_id), '') as contexts,
coalesce(string_agg(distinct u.definition, '|' order by u.definition), '') as definitions, coalesce(any_value(rel.related), '') as related from u left join rel on rel.document_id = u.document_id and rel.symbol = u.symbol group by 1, 2""")
def _(s, d):
    """Inverted index: formulas, contexts, definitions and variables of the same formulas of each variable, joined by bars."""
    return search.index_rows(fs(s, d), current(s, d, "contexts", "lang_label"), definitions(s, d))


@query("search_related_variables", _FSQ + "select a.document_id, a.symbol, b.symbol as related, count(*) as n from fs a join fs b on a.document_id = b.document_id and a.formula_id = b.formula_id and a.symbol <> b.symbol group by 1, 2, 3")
def _(s, d):
    """Variables that occur in the same formulas, by number of formulas; a formula has few symbols."""
    a = fs(s, d).select("document_id", "formula_id", "symbol")
    return a.join(a.withColumnRenamed("symbol", "related"), ["document_id", "formula_id"]).where("symbol <> related").groupBy("document_id", "symbol", "related").agg(F.count(F.lit(1)).alias("n"))


@query("search_definition_conflicts", _DEF + "select document_id, symbol, count(distinct lower(definition)) as meanings from defs group by 1, 2 having count(distinct lower(definition)) > 1")
def _(s, d):
    return definitions(s, d).groupBy("document_id", "symbol").agg(F.countDistinct(F.lower("definition")).alias("meanings")).where("meanings > 1")


# ---- semantic metagraph -------------------------------------------------------------------------------------------


@query("sem_sequence", sql("formulas") + "select document_id, source_id, target_id, 0.3 as weight from (select document_id, formula_id as source_id, lead(formula_id) over (partition by document_id order by ord, formula_id) as target_id from formulas) where target_id is not null")
def _(s, d):
    return graph.consecutive(current(s, d, "formulas", "ord"), ["document_id"], ["ord", "formula_id"], "formula_id").withColumn("weight", F.lit(0.3))


@query("sem_same_context", sql("formulas") + "select document_id, section_id, source_id, target_id, 0.5 as weight from (select document_id, section_id, formula_id as source_id, lead(formula_id) over (partition by document_id, section_id order by ord, formula_id) as target_id from formulas where section_id is not null) where target_id is not null")
def _(s, d):
    return graph.consecutive(current(s, d, "formulas", "section_id", "ord").where("section_id is not null"), ["document_id", "section_id"], ["ord", "formula_id"], "formula_id").withColumn("weight", F.lit(0.5))


@query("sem_definition_usage", sql("formulas", "contexts") + DEFS + _FS + """, o as (select distinct d.document_id, d.symbol, f.ord, f.formula_id from defs d join formulas f on f.document_id = d.document_id and f.formula_id = d.formula_id)
select u.document_id, u.symbol, u.formula_id as target_id, count(*) as n_defining, max(o.ord) as last_defined_at from fs u join o on o.document_id = u.document_id and o.symbol = u.symbol and o.ord < u.ord group by 1, 2, 3""")
def _(s, d):
    """Usages of defined symbols: a formula has an edge from each of the first ``n_defining`` units that define its symbol (sem_definition_members)."""
    key = ["document_id", "symbol"]
    o = defining_units(s, d).select(*key, "ord", F.lit(None).cast("string").alias("target_id"), F.lit(1).alias("defines"))
    u = fs(s, d).select(*key, "ord", F.col("formula_id").alias("target_id"), F.lit(0).alias("defines"))
    before = Window.partitionBy(*key).orderBy("ord").rangeBetween(Window.unboundedPreceding, -1)
    x = o.unionByName(u).where("ord is not null")
    x = x.select(*key, "target_id", F.sum("defines").over(before).alias("n_defining"), F.max(F.when(F.col("defines") == 1, F.col("ord"))).over(before).alias("last_defined_at"))
    return x.where("target_id is not null and n_defining > 0")


def defining_units(s: SparkSession, d: str) -> DataFrame:
    """(document_id, symbol, ord, formula_id): units whose context defines a symbol."""
    return definitions(s, d).select("document_id", "symbol", "formula_id").distinct().join(current(s, d, "formulas", "ord"), ["document_id", "formula_id"]).select("document_id", "symbol", "ord", "formula_id")


@query("sem_definition_members", sql("formulas", "contexts") + DEFS + """, o as (select distinct d.document_id, d.symbol, f.ord, f.formula_id from defs d join formulas f on f.document_id = d.document_id and f.formula_id = d.formula_id)
select document_id, symbol, formula_id, row_number() over (partition by document_id, symbol order by ord nulls first, formula_id) as place from o""")
def _(s, d):
    w = Window.partitionBy("document_id", "symbol").orderBy("ord", "formula_id")
    return defining_units(s, d).select("document_id", "symbol", "formula_id", F.row_number().over(w).alias("place"))

@query("sem_variable_clusters", _FSQ + "select document_id, symbol, count(distinct formula_id) as n_units, min(formula_id) as first_unit from fs group by 1, 2 having count(distinct formula_id) >= 2")
def _(s, d):
    return fs(s, d).groupBy("document_id", "symbol").agg(F.countDistinct("formula_id").alias("n_units"), F.min("formula_id").alias("first_unit")).where("n_units >= 2")


@query("sem_section_groups", sql("formulas") + "select document_id, section_id, count(*) as n_units from formulas where section_id is not null group by 1, 2 having count(*) >= 2")
def _(s, d):
    return current(s, d, "formulas", "section_id").where("section_id is not null").groupBy("document_id", "section_id").agg(F.count(F.lit(1)).alias("n_units")).where("n_units >= 2")


@query("sem_nodes", sql("formulas", "blocks", "contexts") + _FS + """select 'formula' as kind, document_id, formula_id as id from formulas union all select 'paragraph', document_id, block_id from blocks union all select 'context', document_id, 'ctx:' || formula_id from contexts
union all select distinct 'variable', document_id, 'var:' || symbol from fs""")
def _(s, d):
    row = lambda x, k, c: x.select(F.lit(k).alias("kind"), "document_id", c.alias("id"))
    return union(row(current(s, d, "formulas", "ord"), "formula", F.col("formula_id")), row(current(s, d, "blocks", "ord"), "paragraph", F.col("block_id")), row(current(s, d, "contexts", "lang_label"), "context", F.concat(F.lit("ctx:"), "formula_id")), row(fs(s, d), "variable", F.concat(F.lit("var:"), "symbol")).distinct())


# ---- rich metagraph -----------------------------------------------------------------------------------------------


@query("rich_depends_on", _FSQ + """select document_id, section_id, source_id, target_id from (select document_id, section_id, source_id, target_id, row_number() over (partition by document_id, section_id, source_id order by o desc, target_id) as r
from (select distinct a.document_id, a.section_id, a.formula_id as source_id, b.formula_id as target_id, b.ord as o from fs a join fs b on a.document_id = b.document_id and a.section_id = b.section_id and a.symbol = b.symbol and b.ord < a.ord)) where r <= 3""")
def _(s, d):
    """Up to three nearest earlier formulas of the section with a symbol in common."""
    f = fs(s, d).where("section_id is not null").select("document_id", "section_id", "symbol", "formula_id", "ord")
    return graph.nearest_earlier(f, ["document_id", "section_id", "symbol"], "formula_id", "ord", 3)


@query("rich_source_counts", sql("formulas") + "select document_id, coalesce(text_source, 'unknown') as source, count(*) as n from formulas group by 1, 2")
def _(s, d):
    return current(s, d, "formulas", "text_source").groupBy("document_id", F.coalesce("text_source", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("rich_degrees", sql("edges") + "select document_id, node_id, count(*) as degree from (select document_id, unnest([source_id, target_id]) as node_id from edges) where node_id is not null group by 1, 2")
def _(s, d):
    return graph.degrees(current(s, d, "edges", "source_id", "target_id"), ["document_id"])


@query("rich_node_mass", sql("nodes", "edges", "formulas", "contexts") + DEFS + _FS + """, g as (select document_id, node_id, count(*) as degree from (select document_id, unnest([source_id, target_id]) as node_id from edges) where node_id is not null group by 1, 2),
fx as (select f.document_id, f.formula_id as node_id, 1.5 * len(coalesce(f.symbols, [])) + case when c.formula_id is not null then 2 else 0 end as bonus from formulas f left join contexts c on c.document_id = f.document_id and c.formula_id = f.formula_id),
sx as (select document_id, symbol, 2.0 * count(distinct formula_id) as bonus from fs group by 1, 2), dx as (select distinct document_id, symbol, 2.0 as bonus from defs),
y as (select document_id, node_id, x, symbol_of_label from (select document_id, node_id, node_label as x, """ + symbol_sql("node_label") + """ as symbol_of_label from nodes where node_type = 'symbol'))
select n.document_id, n.node_id, round(least(80.0, 1 + coalesce(g.degree, 0) + case when n.node_type = 'formula' then coalesce(fx.bonus, 0) when n.node_type = 'symbol' then coalesce(sx.bonus, 0) + coalesce(dx.bonus, 0)
when n.node_type in ('section', 'paragraph', 'context') then 0.5 * length(coalesce(n.node_label, '')) else 0 end), 4) as mass from nodes n left join g on g.document_id = n.document_id and g.node_id = n.node_id left join fx on fx.document_id = n.document_id and fx.node_id = n.node_id
left join y on y.document_id = n.document_id and y.node_id = n.node_id left join sx on sx.document_id = n.document_id and sx.symbol = y.symbol_of_label left join dx on dx.document_id = n.document_id and dx.symbol = y.symbol_of_label""")
def _(s, d):
    """Mass of nodes: degree, symbols and context of formulas, formulas and definitions of symbols, length of texts; 80 at most."""
    key = ["document_id", "node_id"]
    g = graph.degrees(current(s, d, "edges", "source_id", "target_id"), ["document_id"])
    c = current(s, d, "contexts", "lang_label").select("document_id", "formula_id", F.lit(2.0).alias("c"))
    n = F.coalesce(F.when(F.col("symbols").isNotNull(), F.size("symbols")), F.lit(0))
    fx = current(s, d, "formulas", "symbols").join(c, ["document_id", "formula_id"], "left").select("document_id", F.col("formula_id").alias("node_id"), (1.5 * n + F.coalesce("c", F.lit(0.0))).alias("of_formula"))
    sx = fs(s, d).groupBy("document_id", "symbol").agg((2.0 * F.countDistinct("formula_id")).alias("of_symbol"))
    dx = definitions(s, d).select("document_id", "symbol", F.lit(2.0).alias("of_definition")).distinct()
    x = current(s, d, "nodes", "node_type", "node_label").withColumn("symbol", F.when(F.col("node_type") == "symbol", latex.symbol(F.col("node_label"))))
    x = x.join(g, key, "left").join(fx, key, "left").join(sx, ["document_id", "symbol"], "left").join(dx, ["document_id", "symbol"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    kind = F.col("node_type")
    bonus = F.when(kind == "formula", zero("of_formula")).when(kind == "symbol", zero("of_symbol") + zero("of_definition")).when(kind.isin("section", "paragraph", "context"), 0.5 * F.length(F.coalesce("node_label", F.lit("")))).otherwise(0.0)
    return x.select(*key, F.round(F.least(F.lit(80.0), 1 + F.coalesce("degree", F.lit(0)) + bonus), 4).alias("mass"))


@query("rich_container_mass")
def _(s, d):
    """Mass of metavertices, bottom-up through containment of any depth."""
    c = current(s, d, "metavertices", "contains_ids").select("document_id", F.col("metavertex_id").alias("parent"), F.explode("contains_ids").alias("child")).where("child is not null and child <> parent").distinct()
    own = QUERIES["rich_node_mass"](s, d).select("document_id", F.col("node_id").alias("id"), "mass")
    return graph.rolled_up(graph.cut(c), graph.cut(own))


@query("rich_contains", sql("metavertices") + "select distinct document_id, metavertex_id as parent, unnest(contains_ids) as child from metavertices")
def _(s, d):
    return current(s, d, "metavertices", "contains_ids").select("document_id", F.col("metavertex_id").alias("parent"), F.explode("contains_ids").alias("child")).distinct()


@query("rich_metaedge_members", sql("metaedges") + """select distinct document_id, metaedge_id, role, member from (select document_id, metaedge_id, 'source' as role, unnest(source_set) as member from metaedges union all select document_id, metaedge_id, 'target', unnest(target_set) from metaedges union all select document_id, metaedge_id, 'mediator', unnest(mediator_nodes) from metaedges)""")
def _(s, d):
    m = current(s, d, "metaedges", "source_set", "target_set", "mediator_nodes")
    return union(*[m.select("document_id", "metaedge_id", F.lit(r).alias("role"), F.explode(c).alias("member")) for r, c in (("source", "source_set"), ("target", "target_set"), ("mediator", "mediator_nodes"))]).distinct()


@query("rich_knowledge_graph", sql("metaedges", "edges") + """select distinct document_id, source_id, target_id, kind from (select document_id, source_id, target_id, edge_type as kind from edges
union all select document_id, unnest(source_set), metaedge_id, 'metaedge_source' from metaedges union all select document_id, metaedge_id, unnest(target_set), 'metaedge_target' from metaedges) where source_id is not null and target_id is not null""")
def _(s, d):
    e = current(s, d, "edges", "source_id", "target_id", "edge_type").select("document_id", "source_id", "target_id", F.col("edge_type").alias("kind"))
    m = current(s, d, "metaedges", "source_set", "target_set")
    a = m.select("document_id", F.explode("source_set").alias("source_id"), F.col("metaedge_id").alias("target_id"), F.lit("metaedge_source").alias("kind"))
    b = m.select("document_id", F.col("metaedge_id").alias("source_id"), F.explode("target_set").alias("target_id"), F.lit("metaedge_target").alias("kind"))
    return union(e, a, b).where("source_id is not null and target_id is not null").distinct()


@query("legacy_sections", sql("formulas") + "select document_id, section_id, count(*) as n_formulas, count_if(kind = 'display_math') as n_display, count_if(coalesce(confidence, 0) < 0.5) as n_weak from formulas group by 1, 2")
def _(s, d):
    return current(s, d, "formulas", "section_id", "kind", "confidence").groupBy("document_id", "section_id").agg(F.count(F.lit(1)).alias("n_formulas"), F.count_if(F.col("kind") == "display_math").alias("n_display"), F.count_if(F.coalesce("confidence", F.lit(0.0)) < 0.5).alias("n_weak"))


@query("legacy_source_reliability", sql("formulas") + "select document_id, formula_id, case when contains(text_source, 'tex') then 0.99 when contains(text_source, 'marker') then 0.9 when contains(text_source, 'formula_net') then 0.78 when contains(text_source, 'structure') then 0.7 else 0.55 end as reliability from formulas")
def _(s, d):
    has = lambda x: F.contains("text_source", F.lit(x))
    return current(s, d, "formulas", "text_source").select("document_id", "formula_id", F.when(has("tex"), 0.99).when(has("marker"), 0.9).when(has("formula_net"), 0.78).when(has("structure"), 0.7).otherwise(0.55).alias("reliability"))


# ---- corpus -------------------------------------------------------------------------------------------------------


@query("corpus_nodes", sql("nodes") + "select document_id || '::' || node_id as id, node_type, document_id from nodes")
def _(s, d):
    return current(s, d, "nodes", "node_type").select(F.concat("document_id", F.lit("::"), "node_id").alias("id"), "node_type", "document_id")


@query("corpus_same_variable", _FSQ + "select symbol, document_id, n_formulas, min(document_id) over (partition by symbol) as class_id, docs - 1 as links from (select symbol, document_id, count(*) as n_formulas, count(*) over (partition by symbol) as docs from fs group by 1, 2) where docs >= 2")
def _(s, d):
    """Documents that share a variable: class and number of links of each document, from an aggregate for each symbol."""
    per = fs(s, d).groupBy("symbol", "document_id").agg(F.count(F.lit(1)).alias("n_formulas"))
    c = per.groupBy("symbol").agg(F.min("document_id").alias("class_id"), F.count(F.lit(1)).alias("docs")).where("docs >= 2")
    return per.join(c, "symbol").select("symbol", "document_id", "n_formulas", "class_id", (F.col("docs") - 1).alias("links"))


@query("corpus_similar_formula", sql("formulas") + """, g as (select document_id, formula_id, trim(regexp_replace(latex, '[ \\t\\r\\n]+', ' ', 'g'))[1:180] as sig from formulas where coalesce(trim(latex), '') <> ''),
c as (select sig, count(distinct document_id) as docs, min(document_id || '::' || formula_id) as class_id from g group by 1 having count(distinct document_id) >= 2)
select g.document_id, g.formula_id, c.class_id, c.docs from g join c using (sig)""")
def _(s, d):
    """Formulas with a signature that several documents have: class of each formula, no pairs."""
    from papyrine.functions.text import collapse

    g = current(s, d, "formulas", "latex").where("coalesce(trim(latex), '') <> ''").select("document_id", "formula_id", F.substring(collapse(F.col("latex")), 1, 180).alias("sig"))
    c = g.groupBy("sig").agg(F.countDistinct("document_id").alias("docs"), F.min(F.concat("document_id", F.lit("::"), "formula_id")).alias("class_id")).where("docs >= 2")
    return g.join(c, "sig").select("document_id", "formula_id", "class_id", "docs")


@query("corpus_extraction_sources", sql("formulas", "blocks") + "select source, count(*) as n, count(distinct document_id) as docs from (select document_id, coalesce(text_source, 'unknown') as source from formulas union all select document_id, coalesce(text_source, 'unknown') from blocks) group by 1")
def _(s, d):
    x = union(*[current(s, d, t, "text_source").select("document_id", F.coalesce("text_source", F.lit("unknown")).alias("source")) for t in ("formulas", "blocks")])
    return x.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("document_id").alias("docs"))


@query("corpus_metrics", _FSQ + "select count(distinct document_id) as docs, count(distinct document_id || '::' || formula_id) as formulas, count(distinct symbol) as symbols, round(count(*) / count(distinct document_id || '::' || formula_id), 4) as symbols_per_formula from fs")
def _(s, d):
    key = F.concat("document_id", F.lit("::"), "formula_id")
    return fs(s, d).agg(F.countDistinct("document_id").alias("docs"), F.countDistinct(key).alias("formulas"), F.countDistinct("symbol").alias("symbols"), F.round(F.count(F.lit(1)) / F.countDistinct(key), 4).alias("symbols_per_formula"))


@query("corpus_document_metavertices", sql("nodes") + "select document_id, count(*) as n_members, min(node_id) as first_member from nodes group by 1")
def _(s, d):
    return current(s, d, "nodes", "node_type").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_members"), F.min("node_id").alias("first_member"))


# ---- metrics ------------------------------------------------------------------------------------------------------


@query("metric_basic", sql("nodes", "edges", "metavertices", "metaedges") + "select kind, document_id, type, count(*) as n from (select 'node' as kind, document_id, node_type as type from nodes union all select 'edge', document_id, edge_type from edges union all select 'metavertex', document_id, mv_type from metavertices union all select 'metaedge', document_id, metaedge_type from metaedges) group by 1, 2, 3")
def _(s, d):
    x = union(*[current(s, d, t, c).select(F.lit(k).alias("kind"), "document_id", F.col(c).alias("type")) for k, t, c in (("node", "nodes", "node_type"), ("edge", "edges", "edge_type"), ("metavertex", "metavertices", "mv_type"), ("metaedge", "metaedges", "metaedge_type"))])
    return x.groupBy("kind", "document_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query("metric_components", sql("nodes", "edges") + """, b as (select distinct e.document_id, e.source_id as a, e.target_id as b from edges e where exists (select 1 from nodes n where n.document_id = e.document_id and n.node_id = e.source_id) and exists (select 1 from nodes n where n.document_id = e.document_id and n.node_id = e.target_id)),
e2 as (select document_id, a, b from b union select document_id, b, a from b),
r as (select document_id, node_id as a, node_id as b from nodes union select r.document_id, r.a, e2.b from r join e2 on e2.document_id = r.document_id and e2.a = r.b)
select document_id, a as node_id, min(b) as component from r group by 1, 2""")
def _(s, d):
    return graph.components(current(s, d, "nodes", "node_type"), current(s, d, "edges", "source_id", "target_id"), "document_id", "node_id")


@query("metric_isolated", sql("nodes", "edges") + "select n.document_id, n.node_id, n.node_type from nodes n where not exists (select 1 from edges e where e.document_id = n.document_id and (e.source_id = n.node_id)) and not exists (select 1 from edges e where e.document_id = n.document_id and e.target_id = n.node_id)")
def _(s, d):
    g = graph.degrees(current(s, d, "edges", "source_id", "target_id"), ["document_id"])
    return current(s, d, "nodes", "node_type").join(g, ["document_id", "node_id"], "left_anti").select("document_id", "node_id", "node_type")


@query("metric_variables_per_formula", sql("formulas") + _FS + "select document_id, round(avg(n), 6) as mean_symbols, max(n) as most from (select f.document_id, f.formula_id, count(fs.symbol) as n from formulas f left join fs on fs.document_id = f.document_id and fs.formula_id = f.formula_id group by 1, 2) group by 1")
def _(s, d):
    n = fs(s, d).groupBy("document_id", "formula_id").agg(F.count(F.lit(1)).alias("n"))
    x = current(s, d, "formulas", "ord").join(n, ["document_id", "formula_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return x.groupBy("document_id").agg(F.round(F.avg("n"), 6).alias("mean_symbols"), F.max("n").alias("most"))


@query("metric_metaedges", sql("metaedges") + "select metaedge_type, count(*) as n, round(avg(len(source_set)), 6) as mean_sources, round(avg(len(target_set)), 6) as mean_targets from metaedges group by 1")
def _(s, d):
    m = current(s, d, "metaedges", "metaedge_type", "source_set", "target_set")
    return m.groupBy("metaedge_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("source_set").isNotNull(), F.size("source_set"))), 6).alias("mean_sources"), F.round(F.avg(F.when(F.col("target_set").isNotNull(), F.size("target_set"))), 6).alias("mean_targets"))


@query("metric_inner_edges", sql("edges", "metavertices") + """, c as (select distinct document_id, metavertex_id, unnest(contains_ids) as member from metavertices)
select document_id, count(*) as n_edges, count_if(inner_edge) as n_inner from (select e.document_id, e.edge_id, exists (select 1 from c a join c b on a.document_id = b.document_id and a.metavertex_id = b.metavertex_id where a.document_id = e.document_id and a.member = e.source_id and b.member = e.target_id) as inner_edge from edges e) group by 1""")
def _(s, d):
    """Edges whose two ends lie in one metavertex."""
    c = QUERIES["rich_contains"](s, d).select("document_id", F.col("parent").alias("mv"), "child").where("child is not null")
    e = current(s, d, "edges", "source_id", "target_id")
    both = e.join(c.withColumnRenamed("child", "source_id"), ["document_id", "source_id"]).join(c.withColumnRenamed("child", "target_id"), ["document_id", "mv", "target_id"]).select("document_id", "edge_id").distinct().withColumn("i", F.lit(1))
    return e.join(both, ["document_id", "edge_id"], "left").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_edges"), F.count("i").alias("n_inner"))


@query("metric_top_variables", _FSQ + "select symbol, count(*) as n from fs group by 1 order by 2 desc, 1 limit 20")
def _(s, d):
    return fs(s, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "symbol").limit(20)


@query("metric_rollup", sql("formulas") + "select document_id, text_source, count(*) as n, round(avg(confidence), 6) as mean_confidence from formulas group by rollup (document_id, text_source)")
def _(s, d):
    return current(s, d, "formulas", "text_source", "confidence").rollup("document_id", "text_source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query("metric_definition_coverage", _DEF + "select document_id, count(distinct formula_id) as with_definition, count(distinct symbol) as defined_symbols from defs group by 1")
def _(s, d):
    return definitions(s, d).groupBy("document_id").agg(F.countDistinct("formula_id").alias("with_definition"), F.countDistinct("symbol").alias("defined_symbols"))


# ---- validation ---------------------------------------------------------------------------------------------------


@query("valid_dangling_edges", sql("nodes", "edges", "metavertices") + ", t as (select document_id, node_id as id from nodes union select document_id, metavertex_id from metavertices) select e.document_id, e.edge_id, 'dangling_target' as code from edges e where coalesce(trim(e.target_id), '') <> '' and not exists (select 1 from t where t.document_id = e.document_id and t.id = e.target_id)")
def _(s, d):
    t = union(current(s, d, "nodes", "node_type").select("document_id", F.col("node_id").alias("target_id")), current(s, d, "metavertices", "mv_type").select("document_id", F.col("metavertex_id").alias("target_id")))
    e = current(s, d, "edges", "target_id").where("coalesce(trim(target_id), '') <> ''")
    return e.join(t, ["document_id", "target_id"], "left_anti").select("document_id", "edge_id", F.lit("dangling_target").alias("code"))


@query("valid_duplicate_edges", sql("edges", "metaedges") + """select * from (select document_id, 'edge' as collection, source_id, target_id, edge_type as kind, count(*) as n from edges where source_id is not null and target_id is not null group by 1, 2, 3, 4, 5
union all select document_id, 'metaedge', array_to_string(list_sort(source_set), '|'), array_to_string(list_sort(target_set), '|'), metaedge_type, count(*) from metaedges where source_set is not null and target_set is not null group by 1, 2, 3, 4, 5) where n > 1""")
def _(s, d):
    """Edges and meta edges of one paper with the same ends and kind."""
    e = current(s, d, "edges", "source_id", "target_id", "edge_type").where("source_id is not null and target_id is not null").select("document_id", F.lit("edge").alias("collection"), "source_id", "target_id", F.col("edge_type").alias("kind"))
    ends = lambda c: F.array_join(F.array_sort(c), "|")
    m = current(s, d, "metaedges", "source_set", "target_set", "metaedge_type").where("source_set is not null and target_set is not null").select("document_id", F.lit("metaedge").alias("collection"), ends("source_set").alias("source_id"), ends("target_set").alias("target_id"), F.col("metaedge_type").alias("kind"))
    return e.unionByName(m).groupBy("document_id", "collection", "source_id", "target_id", "kind").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("valid_self_loops", sql("edges") + "select document_id, edge_id from edges where source_id = target_id")
def _(s, d):
    return current(s, d, "edges", "source_id", "target_id").where("source_id = target_id").select("document_id", "edge_id")


@query("valid_density", sql("edges", "nodes") + "select n.document_id, round(2.0 * coalesce(e.m, 0) / n.n, 6) as mean_degree, 2.0 * coalesce(e.m, 0) / n.n > 10 as dense from (select document_id, count(*) as n from nodes group by 1) n left join (select document_id, count(*) as m from edges group by 1) e on e.document_id = n.document_id")
def _(s, d):
    n = current(s, d, "nodes", "node_type").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    e = current(s, d, "edges", "edge_type").groupBy("document_id").agg(F.count(F.lit(1)).alias("m"))
    mean = 2.0 * F.coalesce("m", F.lit(0)) / F.col("n")
    return n.join(e, "document_id", "left").select("document_id", F.round(mean, 6).alias("mean_degree"), (mean > 10).alias("dense"))


# ---- projections --------------------------------------------------------------------------------------------------


_RANKED = sql("formulas", "contexts") + f""", ranked as (select f.document_id, f.formula_id, f.section_id, f.ord, round(2 * len(coalesce(f.symbols, [])) + len({_OPS}) + case when {_any(_NEAR, notation.DEFINITION_MARKERS)} then 3 else 0 end
+ case when contains(f.latex, '=') then 2 else 0 end + coalesce(f.confidence, 0.0), 6) as rank from (select * replace (coalesce(latex, '') as latex), regexp_extract_all(coalesce(latex, ''), '\\\\[A-Za-z]+') as c from formulas) f left join contexts c on c.document_id = f.document_id and c.formula_id = f.formula_id)
""".replace("list_contains(c, ", "list_contains(f.c, ")


@query("proj_formula_rank", _RANKED + "select document_id, formula_id, rank from ranked")
def _(s, d):
    return ranked(s, d).select("document_id", "formula_id", F.round("rank", 6).alias("rank"))


def ranked(s: SparkSession, d: str) -> DataFrame:
    """Formulas with their rank: symbols, operators, whether their context defines something, equality, confidence."""
    f = current(s, d, "formulas", "latex", "symbols", "confidence", "section_id", "ord").join(current(s, d, "contexts", "current_sentence"), ["document_id", "formula_id"], "left")
    n = F.coalesce(F.when(F.col("symbols").isNotNull(), F.size("symbols")), F.lit(0))
    held = F.coalesce("latex", F.lit(""))
    return f.withColumn("rank", latex.rank(n, F.size(latex.operators(held)), latex.holds_any(F.lower("current_sentence"), notation.DEFINITION_MARKERS), F.contains(held, F.lit("=")), F.col("confidence")))


@query("proj_overview_topk", _RANKED + "select document_id, section_id, formula_id, r from (select *, row_number() over (partition by document_id, section_id order by rank desc, ord nulls first, formula_id) as r from ranked where section_id is not null) where r <= 8")
def _(s, d):
    w = Window.partitionBy("document_id", "section_id").orderBy(F.desc(F.round("rank", 6)), "ord", "formula_id")
    return ranked(s, d).where("section_id is not null").withColumn("r", F.row_number().over(w)).where("r <= 8").select("document_id", "section_id", "formula_id", "r")


@query("proj_metaedge_lanes", sql("metaedges") + "select document_id, metaedge_id, size, r from (select document_id, metaedge_id, coalesce(len(source_set), 0) + coalesce(len(target_set), 0) as size, row_number() over (partition by document_id order by coalesce(len(source_set), 0) + coalesce(len(target_set), 0) desc, metaedge_type desc, metaedge_id) as r from metaedges) where r <= 12")
def _(s, d):
    n = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    w = Window.partitionBy("document_id").orderBy(F.desc("size"), F.desc("metaedge_type"), "metaedge_id")
    m = current(s, d, "metaedges", "metaedge_type", "source_set", "target_set").withColumn("size", n("source_set") + n("target_set"))
    return m.withColumn("r", F.row_number().over(w)).where("r <= 12").select("document_id", "metaedge_id", "size", "r")


@query("proj_ambiguity", sql("formulas", "contexts") + DEFS + _FS + """, m as (select document_id, symbol, count(distinct lower(trim(definition))) as meanings from defs group by 1, 2), v as (select document_id, symbol, count(distinct section_id) as sections from fs group by 1, 2)
select v.document_id, v.symbol, round(least(1.0, greatest(0.0, 0.25 * (coalesce(m.meanings, 0) - 1) + 0.12 * greatest(0, v.sections - 1))), 4) as score from v left join m on m.document_id = v.document_id and m.symbol = v.symbol""")
def _(s, d):
    """How ambiguous a variable is: a quarter for each further meaning, 0.12 for each further section."""
    m = definitions(s, d).groupBy("document_id", "symbol").agg(F.countDistinct(F.lower(F.trim("definition"))).alias("meanings"))
    v = fs(s, d).groupBy("document_id", "symbol").agg(F.countDistinct("section_id").alias("sections")).join(m, ["document_id", "symbol"], "left")
    score = 0.25 * (F.coalesce("meanings", F.lit(0)) - 1) + 0.12 * F.greatest(F.lit(0), F.col("sections") - 1)
    return v.select("document_id", "symbol", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 4).alias("score"))


@query("proj_typed_subgraph", sql("nodes", "edges") + ", k as (select document_id, node_id from nodes where node_type in ('formula', 'symbol')) select e.document_id, e.edge_id from edges e where exists (select 1 from k where k.document_id = e.document_id and k.node_id = e.source_id) and exists (select 1 from k where k.document_id = e.document_id and k.node_id = e.target_id)")
def _(s, d):
    k = current(s, d, "nodes", "node_type").where("node_type in ('formula', 'symbol')").select("document_id", "node_id")
    e = current(s, d, "edges", "source_id", "target_id")
    return e.join(k.withColumnRenamed("node_id", "source_id"), ["document_id", "source_id"], "left_semi").join(k.withColumnRenamed("node_id", "target_id"), ["document_id", "target_id"], "left_semi").select("document_id", "edge_id")


@query("proj_hidden_counts", sql("formulas") + "select document_id, greatest(0, count(*) - 80) as hidden from formulas group by 1")
def _(s, d):
    return current(s, d, "formulas", "ord").groupBy("document_id").agg(F.greatest(F.lit(0), F.count(F.lit(1)) - 80).alias("hidden"))


@query("proj_container_chain", sql("metavertices") + """, c as (select distinct document_id, metavertex_id as parent, unnest(contains_ids) as child from metavertices), a as (select document_id, child as id, parent as ancestor from c where child is not null and child <> parent union select a.document_id, a.id, c.parent from a join c on c.document_id = a.document_id and c.child = a.ancestor and c.child <> c.parent)
select document_id, id, ancestor from a""")
def _(s, d):
    """All containers of each member, level by level."""
    c = graph.cut(QUERIES["rich_contains"](s, d).where("child is not null and child <> parent"))
    level = c.select("document_id", F.col("child").alias("id"), F.col("parent").alias("ancestor"))
    every = graph.cut(level)
    up = c.select("document_id", F.col("child").alias("ancestor"), "parent")
    while True:
        level = level.join(up, ["document_id", "ancestor"]).select("document_id", "id", F.col("parent").alias("ancestor"))
        level = graph.cut(level.join(every, ["document_id", "id", "ancestor"], "left_anti").distinct())
        if level.isEmpty():
            return every
        every = graph.cut(every.unionByName(level))


# ---- persistence and status ---------------------------------------------------------------------------------------


@query("ops_formula_export", sql("formulas", "contexts") + "select f.document_id, f.formula_id, coalesce(nullif(c.formula_latex, ''), f.latex) as latex, f.kind, c.current_sentence as near from formulas f left join contexts c on c.document_id = f.document_id and c.formula_id = f.formula_id")
def _(s, d):
    c = current(s, d, "contexts", "formula_latex", "current_sentence")
    return current(s, d, "formulas", "latex", "kind").join(c, ["document_id", "formula_id"], "left").select("document_id", "formula_id", F.coalesce(F.nullif("formula_latex", F.lit("")), "latex").alias("latex"), "kind", F.col("current_sentence").alias("near"))


@query("ops_retention", "select document_id, seen, row_number() over (order by seen desc, document_id) > 30 or seen < timestamp '2024-01-01' as expired from (select document_id, max(loaded_at) as seen from paper_profiles group by 1)")
def _(s, d):
    """Papers that fall out of the newest thirty or are too old: the thirty newest come from a top-k, not from a global window."""
    p = table(s, d, "paper_profiles", "document_id", "loaded_at").groupBy("document_id").agg(F.max("loaded_at").alias("seen"))
    new = p.orderBy(F.desc("seen"), "document_id").limit(30).select("document_id", F.lit(False).alias("old"))
    return p.join(F.broadcast(new), "document_id", "left").select("document_id", "seen", (F.coalesce("old", F.lit(True)) | (F.col("seen") < F.lit("2024-01-01").cast("timestamp"))).alias("expired"))


@query("ops_route", sql("layers") + "select document_id, case when n_chars > 500 then 'text_layer' when n_chars > 0 then 'mixed' else 'ocr' end as route from (select document_id, coalesce(sum(case when text_source = 'pdf_text_layer' then length(text) end), 0) as n_chars from layers group by 1)")
def _(s, d):
    n = F.coalesce(F.sum(F.when(F.col("text_source") == "pdf_text_layer", F.length("text"))), F.lit(0))
    x = current(s, d, "layers", "text_source", "text").groupBy("document_id").agg(n.alias("n_chars"))
    return x.select("document_id", F.when(F.col("n_chars") > 500, "text_layer").when(F.col("n_chars") > 0, "mixed").otherwise("ocr").alias("route"))


@query("ops_refinement_budget", sql("formulas") + "select document_id, formula_id, r from (select document_id, formula_id, row_number() over (partition by document_id order by round(1 - coalesce(confidence, 0.0) + case when kind = 'display_math' then 0.35 else 0 end, 6) desc, formula_id) as r from formulas where coalesce(confidence, 0.0) < 0.86) where r <= 96")
def _(s, d):
    p = F.round(1 - F.coalesce("confidence", F.lit(0.0)) + F.when(F.col("kind") == "display_math", 0.35).otherwise(0.0), 6)
    w = Window.partitionBy("document_id").orderBy(F.desc(p), "formula_id")
    return current(s, d, "formulas", "confidence", "kind").where("coalesce(confidence, 0.0) < 0.86").withColumn("r", F.row_number().over(w)).where("r <= 96").select("document_id", "formula_id", "r")


@query("ops_latest_status", "select user_id, arg_max(event_type, {'t': ts, 'i': event_id}) as last_type, count(*) as n from events group by 1")
def _(s, d):
    return table(s, d, "events", "user_id", "event_type", "ts", "event_id").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count(F.lit(1)).alias("n"))


for _name, _column in _DOUBLES.items():
    SQL[_name] = f"select * replace (cast({_column} as double) as {_column}) from ({SQL[_name]})"
