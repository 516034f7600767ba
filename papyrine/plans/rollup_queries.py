"""Roll-ups, selections and groups by the rules of the inventory that need ranks, paragraphs, pages or shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.functions import text
from papyrine.operators import geometry, graph
from papyrine.plans.base import current, sql
from papyrine.plans.definitions import DEFS, definitions
from papyrine.plans.formula_queries import QUERIES as FORMULA
from papyrine.plans.formula_queries import SQL as FORMULA_SQL
from papyrine.plans.graph_queries import _AREA, _FS, _IOU, fs
from papyrine.plans.text_queries import _BARE
from papyrine.sources.tables import table

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))

# ---- layout -------------------------------------------------------------------------------------------------------


@query("geo_neighbour_relations", sql("layers") + f"""select document_id, block_id, next_id, round({_IOU} / ({_AREA.format('a')} + {_AREA.format('b')} - ({_IOU})), 6) as iou, round({_IOU} / least({_AREA.format('a')}, {_AREA.format('b')}), 6) as overlap, round({_IOU} / {_AREA.format('a')}, 6) as coverage,
(a.x0 + a.x1) / 2 between b.x0 and b.x1 and (a.y0 + a.y1) / 2 between b.y0 and b.y1 as centre_inside, a.x0 >= b.x0 and a.x1 <= b.x1 and a.y0 >= b.y0 and a.y1 <= b.y1 as inside
from (select document_id, block_id, bbox as a, lead(block_id) over w as next_id, lead(bbox) over w as b from layers where bbox is not null window w as (partition by document_id, page_number order by bbox.y0, bbox.x0, block_id)) where next_id is not null""")
def _(s, d):
    """How neighbours of a page lie to each other: overlaps, coverage, and whether one or its centre is inside the other."""
    w = Window.partitionBy("document_id", "page_number").orderBy("bbox.y0", "bbox.x0", "block_id")
    x = current(s, d, "layers", "page_number", "bbox").where("bbox is not null").withColumn("next_id", F.lead("block_id").over(w)).withColumn("b", F.lead("bbox").over(w)).where("next_id is not null")
    a, b = F.col("bbox"), F.col("b")
    middle = ((a["x0"] + a["x1"]) / 2).between(b["x0"], b["x1"]) & ((a["y0"] + a["y1"]) / 2).between(b["y0"], b["y1"])
    inside = (a["x0"] >= b["x0"]) & (a["x1"] <= b["x1"]) & (a["y0"] >= b["y0"]) & (a["y1"] <= b["y1"])
    return x.select("document_id", "block_id", "next_id", F.round(geometry.iou(a, b), 6).alias("iou"), F.round(geometry.overlap(a, b), 6).alias("overlap"), F.round(geometry.shared(a, b) / geometry.area(a), 6).alias("coverage"), middle.alias("centre_inside"), inside.alias("inside"))


@query("merge_distinct_boxes", sql("layers") + "select document_id, block_id from (select document_id, block_id, row_number() over (partition by document_id, page_number, lower(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))), round(bbox.x0, 2), round(bbox.y0, 2), round(bbox.x1, 2), round(bbox.y1, 2) order by block_id) as r from layers where text is not null) where r = 1")
def _(s, d):
    """Blocks of a page once by text and box, the first id of each."""
    x = current(s, d, "layers", "page_number", "text", "bbox").where("text is not null")
    keys = ["document_id", "page_number", F.lower(text.collapse(F.col("text"))).alias("k"), *[F.round(f"bbox.{c}", 2).alias(c) for c in ("x0", "y0", "x1", "y1")]]
    return x.groupBy(*keys).agg(F.min("block_id").alias("block_id")).select("document_id", "block_id")


_PAGES = sql("layers") + f""", p as (select document_id, page_number, case when x = '' then 'missing' when length(x) < 300 or length(x) - length(translate(x, chr(65533) || chr(9633), '')) > 10 or length(regexp_replace(x, '[^\\p{{L}}]', '', 'g')) / length(x) < 0.35 then 'poor' else 'good' end as quality
from (select document_id, page_number, {_BARE} as x from (select document_id, page_number, string_agg(case when text_source = 'pdf_text_layer' then text end, chr(10) order by block_id) as text from layers group by 1, 2)))
"""


def _page_quality(s: SparkSession, d: str) -> DataFrame:
    """Quality of the text layer of each page: of what its blocks from that layer hold together."""
    x = current(s, d, "layers", "page_number", "text", "text_source")
    layer = F.transform(F.array_sort(F.collect_list(F.when((F.col("text_source") == "pdf_text_layer") & F.col("text").isNotNull(), F.struct("block_id", "text")))), lambda v: v["text"])
    return x.groupBy("document_id", "page_number").agg(F.array_join(layer, "\n").alias("t")).select("document_id", "page_number", text.layer_quality(F.col("t")).alias("quality"))


@query("order_layer_quality", _PAGES + "select document_id, case when bool_and(quality = 'missing') then 'missing' when bool_or(quality = 'poor') then 'poor' else 'good' end as quality, count(*) as pages, count_if(quality = 'missing') as missing, count_if(quality = 'poor') as poor from p group by 1")
def _(s, d):
    """Text layer of each document: missing if no page has one, poor if any page's is."""
    q = F.col("quality")
    whole = F.when(F.bool_and(q == "missing"), "missing").when(F.bool_or(q == "poor"), "poor").otherwise("good")
    return _page_quality(s, d).groupBy("document_id").agg(whole.alias("quality"), F.count(F.lit(1)).alias("pages"), F.count_if(q == "missing").alias("missing"), F.count_if(q == "poor").alias("poor"))


@query("order_recognition_status", sql("layers", "formulas") + "select l.document_id, case when f.n is null or f.missing = f.n then 'failed' when f.missing > 0 then 'partial' else 'ok' end as status from (select distinct document_id from layers) l left join (select document_id, count(*) as n, count_if(coalesce(latex, '') = '') as missing from formulas group by 1) f on f.document_id = l.document_id")
def _(s, d):
    """Whether the formulas of each document have LaTeX: all, some or none."""
    f = current(s, d, "formulas", "latex").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("latex", F.lit("")) == "").alias("missing"))
    x = current(s, d, "layers", "page_number").select("document_id").distinct().join(f, "document_id", "left")
    return x.select("document_id", F.when(F.col("n").isNull() | (F.col("missing") == F.col("n")), "failed").when(F.col("missing") > 0, "partial").otherwise("ok").alias("status"))


@query("order_initial_warnings", _PAGES.replace(sql("layers"), sql("layers", "formulas")) + """select document_id, code, count(*) as n from (select document_id, 'text_layer_' || quality as code from p where quality in ('missing', 'poor') union all select document_id, 'formula_recognition_partial' from formulas where coalesce(latex, '') = '') group by 1, 2""")
def _(s, d):
    """Warnings that a document starts with: pages without or with a poor text layer, formulas without LaTeX."""
    p = _page_quality(s, d).where("quality in ('missing', 'poor')").select("document_id", F.concat(F.lit("text_layer_"), "quality").alias("code"))
    f = current(s, d, "formulas", "latex").where("coalesce(latex, '') = ''").select("document_id", F.lit("formula_recognition_partial").alias("code"))
    return p.unionByName(f).groupBy("document_id", "code").agg(F.count(F.lit(1)).alias("n"))


# ---- paragraphs ---------------------------------------------------------------------------------------------------

_PARAGRAPH = """, tk as (select document_id, paragraph_id, ord, block_id, unnest(formula_tokens) as token from blocks where paragraph_id is not null), one as (select document_id, token, arg_min(paragraph_id, {'o': coalesce(ord, -1), 'b': block_id}) as paragraph_id from tk where token is not null group by 1, 2),
fp as (select f.document_id, f.formula_id, f.ord, one.paragraph_id from formulas f join one on one.document_id = f.document_id and one.token = f.token)
"""


def paragraphs(s: SparkSession, d: str) -> DataFrame:
    """(document_id, formula_id, ord, paragraph_id): the first paragraph that holds a formula's token."""
    t = current(s, d, "blocks", "paragraph_id", "ord", "formula_tokens").where("paragraph_id is not null").select("document_id", "paragraph_id", F.coalesce("ord", F.lit(-1)).alias("o"), "block_id", F.explode("formula_tokens").alias("token")).where("token is not null")
    one = t.groupBy("document_id", "token").agg(F.min_by("paragraph_id", F.struct("o", "block_id")).alias("paragraph_id"))
    return current(s, d, "formulas", "token", "ord").join(one, ["document_id", "token"]).select("document_id", "formula_id", "ord", "paragraph_id")


@query("sem_same_paragraph", sql("formulas", "blocks") + _PARAGRAPH + "select * from (select document_id, paragraph_id, formula_id as source_id, lead(formula_id) over (partition by document_id, paragraph_id order by ord nulls first, formula_id) as target_id, cast(0.5 as double) as weight from fp) where target_id is not null")
def _(s, d):
    """Neighbours in a paragraph."""
    return graph.consecutive(paragraphs(s, d), ["document_id", "paragraph_id"], ["ord", "formula_id"], "formula_id").withColumn("weight", F.lit(0.5))


@query("sem_paragraph_groups", sql("formulas", "blocks") + _PARAGRAPH + _FS + ", v as (select fp.document_id, fp.paragraph_id, fp.formula_id, fs.symbol from fp left join fs on fs.document_id = fp.document_id and fs.formula_id = fp.formula_id) select document_id, paragraph_id, string_agg(distinct formula_id, '|' order by formula_id) as units, coalesce(string_agg(distinct symbol, '|' order by symbol), '') as variables from v group by 1, 2 having count(distinct formula_id) >= 2")
def _(s, d):
    """Paragraphs with two formulas or more, their formulas and variables."""
    v = paragraphs(s, d).join(fs(s, d).select("document_id", "formula_id", "symbol"), ["document_id", "formula_id"], "left")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")  # noqa: E731  what one paragraph holds
    g = v.groupBy("document_id", "paragraph_id").agg(F.countDistinct("formula_id").alias("n"), listed("formula_id").alias("units"), listed("symbol").alias("variables"))
    return g.where("n >= 2").drop("n")


# ---- entities -----------------------------------------------------------------------------------------------------


@query("rel_entities", sql("formulas", "contexts") + DEFS + _FS + """, v as (select document_id, symbol as label, 'variable' as kind, cast(0.72 as double) as confidence from defs union all select document_id, symbol, 'variable', cast(0.45 as double) from fs where length(symbol) <= 24 union all select document_id, definition, 'concept', cast(0.62 as double) from defs)
select document_id, label, kind, max(confidence) as confidence from v group by 1, 2, 3""")
def _(s, d):
    """Variables and concepts of each document: defined ones first, then symbols of at most 24 characters that formulas only hold."""
    x = definitions(s, d)
    row = lambda df, c, kind, k: df.select("document_id", F.col(c).alias("label"), F.lit(kind).alias("kind"), F.lit(k).alias("confidence"))
    every = row(x, "symbol", "variable", 0.72).unionByName(row(fs(s, d).where(F.length("symbol") <= 24), "symbol", "variable", 0.45)).unionByName(row(x, "definition", "concept", 0.62))
    return every.groupBy("document_id", "label", "kind").agg(F.max("confidence").alias("confidence"))


# ---- metrics ------------------------------------------------------------------------------------------------------


@query("metric_metaedge_sizes", "select metaedge_type, count(*) as n, round(avg(coalesce(len(source_set), 0)), 4) as sources, round(avg(coalesce(len(target_set), 0)), 4) as targets, round(avg(try_cast(json_extract_string(attributes, '$.weight') as double)), 4) as weight from (select document_id, metaedge_id, arg_max({'metaedge_type': metaedge_type, 'source_set': source_set, 'target_set': target_set, 'attributes': attributes}, loaded_at) as r from mg_metaedges group by 1, 2), lateral (select r.metaedge_type, r.source_set, r.target_set, r.attributes) group by 1")
def _(s, d):
    """Meta edges by type: number, mean sizes of their sets, mean weight of those that state one."""
    m = current(s, d, "metaedges", "metaedge_type", "source_set", "target_set", "attributes")
    weight = F.from_json("attributes", "weight double")["weight"]
    return m.groupBy("metaedge_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(size("source_set")), 4).alias("sources"), F.round(F.avg(size("target_set")), 4).alias("targets"), F.round(F.avg(weight), 4).alias("weight"))


@query("metric_documents", sql("formulas", "contexts") + DEFS + """, x as (select f.document_id, count(*) as formulas, count(c.formula_id) as with_context, count(distinct z.formula_id) as defined from formulas f left join contexts c on c.document_id = f.document_id and c.formula_id = f.formula_id left join (select distinct document_id, formula_id from defs) z on z.document_id = f.document_id and z.formula_id = f.formula_id group by 1)
select count(*) as documents, sum(formulas) as formulas, round(avg(formulas), 4) as mean_formulas, min(formulas) as least_formulas, max(formulas) as most_formulas, round(avg(with_context / formulas), 4) as context_coverage, round(avg(defined / formulas), 4) as definition_coverage from x""")
def _(s, d):
    """Collection in one row: formulas in sum, mean, least and most, mean coverage by contexts and by definitions."""
    key = ["document_id", "formula_id"]
    c = current(s, d, "contexts", "lang_label").select(*key, F.lit(1).alias("c"))
    z = definitions(s, d).select(*key).distinct().withColumn("z", F.lit(1))
    x = current(s, d, "formulas", "ord").join(c, key, "left").join(z, key, "left").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count("c").alias("c"), F.count("z").alias("z"))
    return x.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("formulas"), F.round(F.avg("n"), 4).alias("mean_formulas"), F.min("n").alias("least_formulas"), F.max("n").alias("most_formulas"), F.round(F.avg(F.col("c") / F.col("n")), 4).alias("context_coverage"), F.round(F.avg(F.col("z") / F.col("n")), 4).alias("definition_coverage"))


@query("metric_flags", "select flag, count(*) as n, count(distinct document_id) as documents from (select document_id, block_id, unnest(quality_flags) as flag from (select document_id, block_id, arg_max({'f': quality_flags}, loaded_at).f as quality_flags from graph_text_blocks group by 1, 2)) where flag is not null group by 1")
def _(s, d):
    """How often each quality flag stands at a block, and in how many documents."""
    b = table(s, d, "graph_text_blocks", "document_id", "block_id", "quality_flags", "loaded_at").groupBy("document_id", "block_id").agg(F.max_by(F.struct("quality_flags"), "loaded_at").alias("r"))
    x = b.select("document_id", F.explode("r.quality_flags").alias("flag")).where("flag is not null")
    return x.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("document_id").alias("documents"))


# ---- selections ---------------------------------------------------------------------------------------------------


def _node_ranks() -> str:
    return f"with recursive rk as ({FORMULA_SQL['proj_node_rank']}), nt as (select document_id, node_id, arg_max({{'t': node_type}}, loaded_at).t as node_type from mg_nodes group by 1, 2)"


@query("proj_ranked_selection", _node_ranks() + " select document_id, node_type, node_id, r from (select rk.document_id, nt.node_type, rk.node_id, row_number() over (partition by rk.document_id, nt.node_type order by rk.rank desc, rk.node_id) as r from rk join nt on nt.document_id = rk.document_id and nt.node_id = rk.node_id where nt.node_type in ('formula', 'symbol', 'definition', 'context')) where r <= 40")
def _(s, d):
    """The 40 nodes of highest rank of each kind that a display shows, paper by paper."""
    n = current(s, d, "nodes", "node_type").where("node_type in ('formula', 'symbol', 'definition', 'context')")
    w = Window.partitionBy("document_id", "node_type").orderBy(F.desc("rank"), "node_id")
    return n.join(FORMULA["proj_node_rank"](s, d), ["document_id", "node_id"]).withColumn("r", F.row_number().over(w)).where("r <= 40").select("document_id", "node_type", "node_id", "r")


@query("proj_limited_elements", _node_ranks() + """, top as (select * from (select *, row_number() over (partition by document_id order by rank desc, node_id) as r from rk) where r <= 60), es as (select document_id, edge_id, arg_max({'s': source_id, 't': target_id}, loaded_at) as v from mg_edges group by 1, 2)
select document_id, edge_id from (select e.document_id, e.edge_id, row_number() over (partition by e.document_id order by e.edge_id) as n from es e join top a on a.document_id = e.document_id and a.node_id = e.v.s join top b on b.document_id = e.document_id and b.node_id = e.v.t) where n <= 120""")
def _(s, d):
    """First 120 edges between the 60 nodes of highest rank of each paper: twice as many edges as nodes."""
    w = Window.partitionBy("document_id").orderBy(F.desc("rank"), "node_id")
    top = FORMULA["proj_node_rank"](s, d).withColumn("r", F.row_number().over(w)).where("r <= 60").select("document_id", "node_id")
    e = current(s, d, "edges", "source_id", "target_id").join(top.withColumnRenamed("node_id", "source_id"), ["document_id", "source_id"], "left_semi").join(top.withColumnRenamed("node_id", "target_id"), ["document_id", "target_id"], "left_semi")
    return e.withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy("edge_id"))).where("n <= 120").select("document_id", "edge_id")


@query("corpus_display_edges", sql("nodes", "edges") + """, k as (select document_id || '::' || node_id as id from nodes order by 1 limit 260), e as (select document_id || '::' || source_id as source, document_id || '::' || target_id as target, document_id || '::' || edge_id as edge_id, edge_type from edges)
select source, target, edge_type from (select * from e where source in (select id from k) and target in (select id from k) order by edge_id limit 520)""")
def _(s, d):
    """First 520 edges between the first 260 nodes of a corpus (top-k of fixed size)."""
    id_ = lambda c: F.concat("document_id", F.lit("::"), c)
    k = current(s, d, "nodes", "node_type").select(id_("node_id").alias("id")).orderBy("id").limit(260)
    e = current(s, d, "edges", "source_id", "target_id", "edge_type").select(id_("source_id").alias("source"), id_("target_id").alias("target"), id_("edge_id").alias("edge"), "edge_type")
    shown = e.join(k.withColumnRenamed("id", "source"), "source", "left_semi").join(k.withColumnRenamed("id", "target"), "target", "left_semi")
    return shown.orderBy("edge").limit(520).select("source", "target", "edge_type")


@query("legacy_section_groups", sql("formulas") + _FS + """, f as (select document_id, section_id, string_agg(formula_id, '|' order by n) as formulas from (select document_id, section_id, formula_id, row_number() over (partition by document_id, section_id order by ord nulls first, formula_id) as n from formulas where section_id is not null) where n <= 80 group by 1, 2),
v as (select document_id, section_id, string_agg(symbol, '|' order by symbol) as variables from (select *, row_number() over (partition by document_id, section_id order by symbol) as n from (select distinct document_id, section_id, symbol from fs where section_id is not null)) where n <= 24 group by 1, 2)
select f.document_id, f.section_id, f.formulas, coalesce(v.variables, '') as variables from f left join v on v.document_id = f.document_id and v.section_id = f.section_id""")
def _(s, d):
    """Equation group and variable set of each section: its first 80 formulas and first 24 variables."""
    key = ["document_id", "section_id"]
    f = current(s, d, "formulas", "section_id", "ord").where("section_id is not null").withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("ord", "formula_id"))).where("n <= 80")
    f = f.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "formula_id"))), lambda x: x["formula_id"]), "|").alias("formulas"))
    v = fs(s, d).where("section_id is not null").select(*key, "symbol").distinct().withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("symbol"))).where("n <= 24")
    v = v.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("symbol")), "|").alias("variables"))
    return f.join(v, key, "left").select(*key, "formulas", F.coalesce("variables", F.lit("")).alias("variables"))
