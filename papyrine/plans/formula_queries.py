"""Detection, description and alignment of formulas, and further rows of the inventory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.functions import latex, notation, text
from papyrine.operators import formulas as op
from papyrine.plans.base import current, sql
from papyrine.plans.definitions import DEF
from papyrine.plans.graph_queries import _FSQ, definitions, fs
from papyrine.sources.tables import table

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


@query("latex_detect_in_text")
def _(s, d):
    return op.detected(current(s, d, "blocks", "text"), ["document_id", "block_id"], "text")


@query("latex_detect_in_documents")
def _(s, d):
    return op.detected(table(s, d, "documents", "doc_id", "text"), ["doc_id"], "text")


@query("latex_describe")
def _(s, d):
    return op.described(current(s, d, "formulas", "latex"), ["document_id", "formula_id"], "latex")


@query("latex_fragments")
def _(s, d):
    """Rows, sides and operands of every formula, with the fragment that each is part of."""
    from papyrine.operators.cleaning import applied

    joined = lambda v: ["\x01".join(f) for f in op.fragments(v)]
    x = applied(current(s, d, "formulas", "latex"), ["document_id", "formula_id"], "latex", {"f": (joined, "array<string>")}).select("document_id", "formula_id", F.explode("f").alias("f"))
    part = lambda i, name: F.split("f", "\x01")[i].alias(name)
    return x.select("document_id", "formula_id", part(0, "fragment_id"), part(1, "parent_id"), part(2, "role"), part(3, "fragment"))


@query("latex_align_sources")
def _(s, d):
    f = current(s, d, "formulas", "latex", "kind", "text_source", "section_id").where("latex is not null and section_id is not null").withColumnRenamed("formula_id", "id")
    return op.aligned(f.where("text_source <> 'tex_source'"), f.where("text_source = 'tex_source'"))


@query("tex_events")
def _(s, d):
    return op.tex_events(table(s, d, "text_blocks", "block_id", "text", "text_source").where("text_source = 'tex_source'"), "block_id", "text")


@query("merge_line_clusters")
def _(s, d):
    return op.line_clusters(current(s, d, "layers", "page_number", "bbox"), "document_id string, page_number int, block_id string, line int")


@query("merge_proximity_groups")
def _(s, d):
    return op.proximity_groups(current(s, d, "layers", "page_number", "bbox"), "document_id string, page_number int, block_id string, group int")


@query("latex_commands_normalized")
def _(s, d):
    return current(s, d, "formulas", "latex").select("document_id", "formula_id", latex.normalized(F.col("latex")).alias("normal"))


@query("latex_formula_number", sql("formulas", "contexts") + "select f.document_id, f.formula_id, coalesce(nullif(regexp_extract(f.latex, '\\\\tag\\{([^}]*)\\}', 1), ''), nullif(regexp_extract(f.latex, '\\\\label\\{([^}]*)\\}', 1), ''), nullif(regexp_extract(c.current_sentence, '\\(([0-9]+[a-z]?)\\)', 1), '')) as number from formulas f left join contexts c on c.document_id = f.document_id and c.formula_id = f.formula_id")
def _(s, d):
    own = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    j = current(s, d, "formulas", "latex").join(current(s, d, "contexts", "current_sentence"), ["document_id", "formula_id"], "left")
    return j.select("document_id", "formula_id", F.coalesce(own("latex", r"\\tag\{([^}]*)\}"), own("latex", r"\\label\{([^}]*)\}"), own("current_sentence", r"\(([0-9]+[a-z]?)\)")).alias("number"))


@query("order_document_language", sql("blocks") + """, n as (select document_id, sum(length(text)) as chars, sum(length(regexp_replace(text, '[^\\p{L}]', '', 'g'))) as letters, sum(length(regexp_replace(text, '[^\\x{0400}-\\x{04FF}]', '', 'g'))) as cyr from blocks where ord <= 120 group by 1)
select document_id, case when chars < 80 or letters < 40 then null when cyr / letters >= 0.25 then 'ru' else 'en' end as language from n""")
def _(s, d):
    """ru or en by the share of Cyrillic letters in the first 120 blocks, as the operator says; null where there is too little text."""
    b = current(s, d, "blocks", "text", "ord").where("ord <= 120")
    n = b.groupBy("document_id").agg(F.sum(F.length("text")).alias("chars"), F.sum(F.regexp_count("text", F.lit(text.LETTER))).alias("letters"), F.sum(F.regexp_count("text", F.lit(text.CYRILLIC))).alias("cyr"))
    return n.select("document_id", F.when((F.col("chars") < 80) | (F.col("letters") < 40), None).when(F.col("cyr") / F.col("letters") >= 0.25, "ru").otherwise("en").alias("language"))


@query("order_document_title", sql("layers") + "select document_id, arg_min(text, {'p': page_number, 'y': coalesce(bbox.y0, 1e7), 'b': block_id}) as title from layers where length(text) between 8 and 260 and page_number is not null group by 1")
def _(s, d):
    """Topmost text of a paper of a title's length."""
    x = current(s, d, "layers", "page_number", "text", "bbox").where("length(text) between 8 and 260 and page_number is not null")
    return x.groupBy("document_id").agg(F.min_by("text", F.struct("page_number", F.coalesce("bbox.y0", F.lit(1e7)), "block_id")).alias("title"))


@query("order_authors", "select document_id, i - 1 as pos, authors[i] as author from (select document_id, authors, unnest(range(1, least(len(authors), 12) + 1)) as i from (select document_id, any_value(authors order by loaded_at) as authors from paper_profiles group by 1))")
def _(s, d):
    p = table(s, d, "paper_profiles", "document_id", "authors", "loaded_at").groupBy("document_id").agg(F.min_by("authors", "loaded_at").alias("authors"))
    return p.select("document_id", F.posexplode("authors").alias("pos", "author")).where("pos < 12").select("document_id", F.col("pos").cast("long").alias("pos"), "author")


@query("context_ladder", sql("formulas", "contexts") + """select f.document_id, f.formula_id, case when length(coalesce(c.current_sentence, '')) > 0 then c.current_sentence when length(coalesce(c.previous_sentence, '')) > 0 then c.previous_sentence else c.next_sentence end as window_text,
case when length(coalesce(c.current_sentence, '')) > 0 then 75 when length(coalesce(c.previous_sentence, '') || coalesce(c.next_sentence, '')) > 0 then 62 else 25 end as confidence from formulas f left join contexts c on c.document_id = f.document_id and c.formula_id = f.formula_id""")
def _(s, d):
    """Best context of each formula: its own sentence, else a neighbour, with the confidence of what was found (per cent)."""
    j = current(s, d, "formulas", "ord").join(current(s, d, "contexts", "current_sentence", "previous_sentence", "next_sentence"), ["document_id", "formula_id"], "left")
    has = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    window = F.when(has("current_sentence"), F.col("current_sentence")).when(has("previous_sentence"), F.col("previous_sentence")).otherwise(F.col("next_sentence"))
    return j.select("document_id", "formula_id", window.alias("window_text"), F.when(has("current_sentence"), 75).when(has("previous_sentence") | has("next_sentence"), 62).otherwise(25).alias("confidence"))


@query("context_neighbour_blocks", sql("blocks") + "select document_id, block_id, lag(block_id) over w as before_id, lead(block_id) over w as after_id from blocks where section_id is not null window w as (partition by document_id, section_id order by ord, block_id)")
def _(s, d):
    w = Window.partitionBy("document_id", "section_id").orderBy("ord", "block_id")
    return current(s, d, "blocks", "section_id", "ord").where("section_id is not null").select("document_id", "block_id", F.lag("block_id").over(w).alias("before_id"), F.lead("block_id").over(w).alias("after_id"))


@query("context_sliding_text", sql("blocks") + "select document_id, block_id, string_agg(text, ' ') over (partition by document_id, page_number order by ord, block_id rows between current row and 3 following) as four from blocks where text is not null")
def _(s, d):
    """Text of each block with the three that follow on its page."""
    w = Window.partitionBy("document_id", "page_number").orderBy("ord", "block_id").rowsBetween(0, 3)
    return current(s, d, "blocks", "text", "page_number", "ord").where("text is not null").select("document_id", "block_id", F.array_join(F.collect_list("text").over(w), " ").alias("four"))


@query("rel_formula_of_block", sql("blocks", "formulas") + """select distinct b.document_id, b.block_id, f.formula_id from (select document_id, block_id, unnest(regexp_extract_all(text_with_tokens, '\\[FORMULA_[0-9]+\\]')) as token from blocks) b join formulas f on f.document_id = b.document_id and f.token = b.token""")
def _(s, d):
    b = current(s, d, "blocks", "text_with_tokens").select("document_id", "block_id", F.explode(text.tokens(F.col("text_with_tokens"))).alias("token"))
    return b.join(current(s, d, "formulas", "token"), ["document_id", "token"]).select("document_id", "block_id", "formula_id").distinct()


@query("rel_unmatched_tokens", sql("blocks", "formulas") + """select distinct b.document_id, b.block_id, b.token from (select document_id, block_id, unnest(regexp_extract_all(text_with_tokens, '\\[FORMULA_[0-9]+\\]')) as token from blocks) b where not exists (select 1 from formulas f where f.document_id = b.document_id and f.token = b.token)""")
def _(s, d):
    b = current(s, d, "blocks", "text_with_tokens").select("document_id", "block_id", F.explode(text.tokens(F.col("text_with_tokens"))).alias("token"))
    return b.join(current(s, d, "formulas", "token").drop("formula_id"), ["document_id", "token"], "left_anti").select("document_id", "block_id", "token").distinct()


@query("var_scope", _FSQ + "select document_id, symbol, case when count(distinct section_id) = 1 then 'section' when count(distinct section_id) = 0 then 'paragraph' else 'document' end as scope, min(section_id) as first_section from fs group by 1, 2")
def _(s, d):
    v = fs(s, d).groupBy("document_id", "symbol").agg(F.countDistinct("section_id").alias("n"), F.min("section_id").alias("first_section"))
    return v.select("document_id", "symbol", F.when(F.col("n") == 1, "section").when(F.col("n") == 0, "paragraph").otherwise("document").alias("scope"), "first_section")


@query("metric_sources_used", sql("blocks", "formulas") + "select document_id, bool_or(text_source = 'tex_source') as tex, bool_or(text_source = 'pdf_text_layer') as layer, bool_or(contains(text_source, 'ocr')) as ocr from (select document_id, text_source from blocks union all select document_id, text_source from formulas) group by 1")
def _(s, d):
    x = current(s, d, "blocks", "text_source").select("document_id", "text_source").unionByName(current(s, d, "formulas", "text_source").select("document_id", "text_source"))
    return x.groupBy("document_id").agg(F.bool_or(F.col("text_source") == "tex_source").alias("tex"), F.bool_or(F.col("text_source") == "pdf_text_layer").alias("layer"), F.bool_or(F.contains("text_source", F.lit("ocr"))).alias("ocr"))


@query("metric_section_spread", _FSQ + "select symbol, max(n) as widest, round(avg(n), 6) as mean_sections from (select document_id, symbol, count(distinct section_id) as n from fs group by 1, 2) group by 1")
def _(s, d):
    v = fs(s, d).groupBy("document_id", "symbol").agg(F.countDistinct("section_id").alias("n"))
    return v.groupBy("symbol").agg(F.max("n").alias("widest"), F.round(F.avg("n"), 6).alias("mean_sections"))


@query("metric_breakdown", sql("formulas") + "select coalesce(kind, '-') as kind, coalesce(text_source, '-') as source, count(*) as n from formulas group by 1, 2")
def _(s, d):
    return current(s, d, "formulas", "kind", "text_source").groupBy(F.coalesce("kind", F.lit("-")).alias("kind"), F.coalesce("text_source", F.lit("-")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("metric_confidence_stats", sql("formulas") + "select document_id, count(*) as n, count_if(confidence is null) as unknown, min(confidence) as least, max(confidence) as most, round(sum(confidence), 4) as total from formulas group by 1")
def _(s, d):
    return current(s, d, "formulas", "confidence").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence").isNull()).alias("unknown"), F.min("confidence").alias("least"), F.max("confidence").alias("most"), F.round(F.sum("confidence"), 4).alias("total"))


@query("corpus_concept_links", DEF + "select symbol, lower(definition) as meaning, min(document_id) as first_document, count(distinct document_id) - 1 as others from defs group by 1, 2 having count(distinct document_id) > 1")
def _(s, d):
    """Definitions that several papers give of one symbol: the first paper and how many follow, without pairs."""
    x = definitions(s, d).select("symbol", F.lower("definition").alias("meaning"), "document_id").distinct()
    return x.groupBy("symbol", "meaning").agg(F.min("document_id").alias("first_document"), (F.count(F.lit(1)) - 1).alias("others")).where("others > 0")


@query("corpus_notation_scope", _FSQ + "select symbol, count(distinct document_id) as docs, min(document_id) as first_document from fs group by 1 having count(distinct document_id) >= 2")
def _(s, d):
    return fs(s, d).groupBy("symbol").agg(F.countDistinct("document_id").alias("docs"), F.min("document_id").alias("first_document")).where("docs >= 2")


@query("proj_formula_focus", _FSQ + "select document_id, formula_id, count(*) as n_variables, string_agg(symbol, '|' order by symbol) as variables from fs group by 1, 2")
def _(s, d):
    return fs(s, d).groupBy("document_id", "formula_id").agg(F.count(F.lit(1)).alias("n_variables"), F.array_join(F.array_sort(F.collect_set("symbol")), "|").alias("variables"))


@query("proj_variable_focus", _FSQ + "select document_id, symbol, section_id, count(*) as n, min(formula_id) as first_formula from fs group by 1, 2, 3")
def _(s, d):
    return fs(s, d).groupBy("document_id", "symbol", "section_id").agg(F.count(F.lit(1)).alias("n"), F.min("formula_id").alias("first_formula"))


@query("proj_metavertex_rank")
def _(s, d):
    """Rank of metavertices: kind, mass and number of members."""
    from papyrine.plans.graph_queries import QUERIES as Q

    mass = Q["rich_container_mass"](s, d).select("document_id", F.col("id").alias("metavertex_id"), "mass")
    n = F.coalesce(F.when(F.col("contains_ids").isNotNull(), F.size("contains_ids")), F.lit(0))
    bonus = reduce(lambda a, kv: a.when(F.col("mv_type") == kv[0], kv[1]), notation.METAVERTEX_BONUS.items(), F).otherwise(12)
    x = current(s, d, "metavertices", "mv_type", "contains_ids").join(mass, ["document_id", "metavertex_id"], "left")
    return x.select("document_id", "metavertex_id", F.round(bonus + F.log1p(F.greatest(F.lit(0.0), F.coalesce("mass", F.lit(0.0)))) * 10 + n * 0.04, 5).alias("rank"))


def _node_rank_sql() -> str:
    from papyrine.plans.graph_queries import SQL as S

    weight = " ".join(f"when '{k}' then {v}" for k, v in notation.NODE_WEIGHTS.items())
    return f"""with recursive mass as ({S["rich_node_mass"]}), defined as (select distinct document_id, formula_id from ({S["def_evidence"]})), ctx as (select distinct document_id, formula_id from context_requests),
nodes as (select document_id, node_id, arg_max({{'t': node_type, 'd': deleted_at}}, loaded_at) as r from mg_nodes group by 1, 2)
select n.document_id, n.node_id, round(case n.r.t {weight} else 10 end + 8 * ln(1 + m.mass) + case when n.r.t = 'formula' and x.formula_id is not null then 4 else 0 end + case when n.r.t = 'formula' and c.formula_id is not null then 3 else 0 end, 5) as rank
from nodes n join mass m on m.document_id = n.document_id and m.node_id = n.node_id left join defined x on x.document_id = n.document_id and x.formula_id = n.node_id left join ctx c on c.document_id = n.document_id and c.formula_id = n.node_id where n.r.d is null"""


@query("proj_node_rank", _node_rank_sql())
def _(s, d):
    """Rank of nodes: kind, mass, whether their context defines something, whether they have a context."""
    from papyrine.plans.graph_queries import QUERIES as Q

    key = ["document_id", "node_id"]
    defined = definitions(s, d).select("document_id", F.col("formula_id").alias("node_id"), F.lit(4).alias("x")).distinct()
    ctx = table(s, d, "context_requests", "document_id", F.col("formula_id").alias("node_id")).distinct().withColumn("c", F.lit(3))
    n = current(s, d, "nodes", "node_type").join(Q["rich_node_mass"](s, d), key).join(defined, key, "left").join(ctx, key, "left")
    weight = reduce(lambda a, kv: a.when(F.col("node_type") == kv[0], kv[1]), notation.NODE_WEIGHTS.items(), F).otherwise(10)
    extra = F.when(F.col("node_type") == "formula", F.coalesce("x", F.lit(0)) + F.coalesce("c", F.lit(0))).otherwise(0)
    return n.select(*key, F.round(weight + F.log1p("mass") * 8 + extra, 5).alias("rank"))


@query("proj_edge_budget", sql("edges") + "select document_id, edge_id from (select document_id, edge_id, row_number() over (partition by document_id order by case edge_type when 'depends_on' then 0 when 'has_symbol' then 1 when 'has_definition' then 2 else 3 end, edge_id) as r from edges) where r <= 360")
def _(s, d):
    p = F.when(F.col("edge_type") == "depends_on", 0).when(F.col("edge_type") == "has_symbol", 1).when(F.col("edge_type") == "has_definition", 2).otherwise(3)
    w = Window.partitionBy("document_id").orderBy(p, "edge_id")
    return current(s, d, "edges", "edge_type").withColumn("r", F.row_number().over(w)).where("r <= 360").select("document_id", "edge_id")


@query("valid_tokens_in_text", sql("formulas", "blocks") + """select f.document_id, f.formula_id from formulas f where f.token is not null and not exists (select 1 from (select distinct document_id, unnest(regexp_extract_all(text_with_tokens, '\\[FORMULA_[0-9]+\\]')) as token from blocks) b where b.document_id = f.document_id and b.token = f.token)""")
def _(s, d):
    """Formulas whose token no block holds."""
    b = current(s, d, "blocks", "text_with_tokens").select("document_id", F.explode(text.tokens(F.col("text_with_tokens"))).alias("token")).distinct()
    return current(s, d, "formulas", "token").where("token is not null").join(b, ["document_id", "token"], "left_anti").select("document_id", "formula_id")


@query("valid_metaedge_sources", sql("metaedges", "nodes", "metavertices") + ", t as (select document_id, node_id as id from nodes union select document_id, metavertex_id from metavertices) select distinct m.document_id, m.metaedge_id, m.x as missing from (select document_id, metaedge_id, unnest(source_set) as x from metaedges) m where coalesce(trim(m.x), '') <> '' and not exists (select 1 from t where t.document_id = m.document_id and t.id = m.x)")
def _(s, d):
    t = current(s, d, "nodes", "node_type").select("document_id", F.col("node_id").alias("missing")).unionByName(current(s, d, "metavertices", "mv_type").select("document_id", F.col("metavertex_id").alias("missing")))
    m = current(s, d, "metaedges", "source_set").select("document_id", "metaedge_id", F.explode("source_set").alias("missing")).where("coalesce(trim(missing), '') <> ''")
    return m.join(t, ["document_id", "missing"], "left_anti").select("document_id", "metaedge_id", "missing").distinct()


@query("ops_batch_progress", "select event_type, count(*) as n, count(distinct user_id) as users, round(sum(value), 4) as total from events group by 1")
def _(s, d):
    return table(s, d, "events", "event_type", "user_id", "value").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))
