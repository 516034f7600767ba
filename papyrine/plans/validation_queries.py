"""Validation of documents and metagraphs by all rules, counted by document and rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.functions import latex, notation
from papyrine.operators import graph, validation
from papyrine.plans.base import current, sql
from papyrine.plans.definitions import DEFS, definitions
from papyrine.plans.graph_queries import _FS, _RANKED, QUERIES as GRAPH, SQL as GRAPH_SQL, fs, ranked

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def _counted(df: DataFrame) -> DataFrame:
    return df.groupBy("document_id", "code").agg(F.count(F.lit(1)).alias("n"))


def _window() -> F.Column:
    return F.concat_ws(" ", "previous_sentence", "current_sentence", "next_sentence")


def _tables(s: SparkSession, d: str) -> dict[str, DataFrame]:
    f = current(s, d, "formulas", "token", "section_id", "latex", "symbols")
    number = F.nullif(F.regexp_extract("latex", r"\\tag\{([^}]*)\}", 1), F.lit(""))
    b = current(s, d, "blocks", "section_id", "text_with_tokens", "formula_tokens")
    c = current(s, d, "contexts", "previous_sentence", "current_sentence", "next_sentence").select("document_id", "formula_id", F.concat(F.lit("ctx:"), "formula_id").alias("context_id"), _window().alias("window_text"))
    own = f.select("document_id", "formula_id", "token", "section_id")
    held = b.select("document_id", "block_id", F.explode("formula_tokens").alias("token")).where("token is not null").distinct().groupBy("document_id", "token").agg(F.count(F.lit(1)).alias("n_blocks"))
    return {
        "formulas": f.select("document_id", "formula_id", "token", "section_id", number.alias("number")), "blocks": b.drop("formula_tokens"), "sections": current(s, d, "sections", "ord"),
        "contexts": c.join(own, ["document_id", "formula_id"], "left").join(held, ["document_id", "token"], "left"),
        "links": current(s, d, "edges", "source_id", "target_id", "edge_type").where("edge_type = 'depends_on'").withColumnRenamed("edge_id", "link_id"),
        "nodes": current(s, d, "nodes", "node_type"), "edges": current(s, d, "edges", "source_id", "target_id"),
    }


_TABLES = sql("formulas", "blocks", "sections", "contexts", "nodes", "edges") + """, held as (select document_id, token, count(*) as n_blocks from (select distinct document_id, block_id, unnest(formula_tokens) as token from blocks) where token is not null group by 1, 2),
c as (select x.document_id, 'ctx:' || x.formula_id as context_id, x.formula_id, concat_ws(' ', x.previous_sentence, x.current_sentence, x.next_sentence) as window_text, f.token, f.section_id, h.n_blocks from contexts x left join formulas f on f.document_id = x.document_id and f.formula_id = x.formula_id left join held h on h.document_id = x.document_id and h.token = f.token),
tok as (select distinct document_id, unnest(regexp_extract_all(text_with_tokens, '\\[FORMULA_[0-9]+\\]')) as token from blocks), fk as (select distinct document_id, formula_id from formulas), ft as (select distinct document_id, token from formulas), sk as (select distinct document_id, section_id from sections), nk as (select distinct document_id, node_id from nodes)
"""


@query("valid_document_rules", _TABLES + """, broken as (
select document_id, 'duplicate_formula_token' as code, token as object_id from formulas where token is not null group by document_id, token having count(*) > 1
union all select f.document_id, 'duplicate_formula_number', f.formula_id from formulas f join (select document_id, section_id, nullif(regexp_extract(latex, '\\\\tag\\{([^}]*)\\}', 1), '') as num from formulas group by 1, 2, 3 having count(*) > 1) m on m.document_id = f.document_id and m.section_id is not distinct from f.section_id and m.num = nullif(regexp_extract(f.latex, '\\\\tag\\{([^}]*)\\}', 1), '')
union all select document_id, 'text_with_tokens_unknown_formula', token from tok where (document_id, token) not in (select document_id, token from ft where token is not null)
union all select document_id, 'token_not_inserted', formula_id from formulas where token is not null and token <> '' and (document_id, token) not in (select document_id, token from tok)
union all select document_id, 'formula_context_missing_formula', context_id from c where (document_id, formula_id) not in (select document_id, formula_id from fk)
union all select document_id, 'formula_context_missing', formula_id from formulas where (document_id, formula_id) not in (select document_id, formula_id from contexts)
union all select document_id, 'formula_context_missing', formula_id from c where coalesce(n_blocks, 0) = 0
union all select document_id, 'formula_context_token_missing', context_id from c where token is not null and not contains(window_text, token)
union all select document_id, 'text_block_section_missing', block_id from blocks where section_id is not null and section_id <> '' and (document_id, section_id) not in (select document_id, section_id from sk)
union all select document_id, 'formula_section_missing', formula_id from formulas where section_id is not null and section_id <> '' and (document_id, section_id) not in (select document_id, section_id from sk)
union all select e.document_id, 'formula_link_missing_formula', e.edge_id from edges e where edge_type = 'depends_on' and ((source_id <> '' and (document_id, source_id) not in (select document_id, formula_id from fk)) or (target_id <> '' and (document_id, target_id) not in (select document_id, formula_id from fk)))
union all select document_id, 'graph_seed_edge_missing_node', edge_id from edges where (source_id <> '' and (document_id, source_id) not in (select document_id, node_id from nk)) or (target_id <> '' and (document_id, target_id) not in (select document_id, node_id from nk)))
select document_id, code, count(*) as n from (select distinct * from broken) group by 1, 2""")
def _(s, d):
    """Violations by rule and document; the tables hold no regions, reading order or entities, whose rules need them."""
    return _counted(validation.document(_tables(s, d)))


@query("valid_graph_ready_rules", _TABLES + _FS + """, v as (select document_id, symbol as variable_id, formula_id from fs),
known as (select document_id, formula_id as id from fk union select document_id, context_id from c union select document_id, variable_id from v union select document_id, section_id from sk union select document_id, block_id from blocks),
broken as (select document_id, 'duplicate_formula_token' as code, token as object_id from formulas where token is not null group by document_id, token having count(*) > 1
union all select document_id, 'formula_token_not_inserted', formula_id from formulas where token is not null and token <> '' and (document_id, token) not in (select document_id, token from tok)
union all select document_id, 'formula_context_missing_formula', context_id from c where (document_id, formula_id) not in (select document_id, formula_id from fk)
union all select document_id, 'formula_context_token_missing', context_id from c where token is not null and not contains(window_text, token)
union all select document_id, 'variable_reference_missing', variable_id from v where (document_id, 'ctx:' || formula_id) not in (select document_id, context_id from c)
union all select document_id, 'relation_reference_missing', edge_id from edges where (source_id <> '' and (document_id, source_id) not in (select document_id, id from known)) or (target_id <> '' and (document_id, target_id) not in (select document_id, id from known))
union all select document_id, 'section_reference_missing', block_id from blocks where section_id is not null and section_id <> '' and (document_id, section_id) not in (select document_id, section_id from sk)
union all select document_id, 'section_reference_missing', formula_id from formulas where section_id is not null and section_id <> '' and (document_id, section_id) not in (select document_id, section_id from sk)
union all select document_id, 'section_reference_missing', context_id from c where section_id is not null and section_id <> '' and (document_id, section_id) not in (select document_id, section_id from sk))
select document_id, code, count(*) as n from (select distinct * from broken) group by 1, 2""")
def _(s, d):
    """Violations of the rules of graph-ready documents; every formula of a variable is taken to name its context."""
    t = _tables(s, d)
    v = fs(s, d).select("document_id", F.col("symbol").alias("variable_id"), F.array("formula_id").alias("formula_ids"), F.array(F.concat(F.lit("ctx:"), "formula_id")).alias("context_ids"))
    return _counted(validation.graph_ready({**{k: t[k] for k in ("formulas", "blocks", "contexts", "sections")}, "variables": v, "relations": t["edges"].withColumnRenamed("edge_id", "relation_id")}))


def _ends(c: str) -> F.Column:
    return F.explode_outer(F.when(F.size(c) > 0, F.col(c)))


@query("valid_documents", sql("nodes", "edges", "formulas", "metaedges") + """, pair as (select document_id, metaedge_id as edge_id, source_id, unnest(case when len(target_set) > 0 then target_set else [null] end) as target_id, metaedge_type as kind from (select *, unnest(case when len(source_set) > 0 then source_set else [null] end) as source_id from metaedges)),
nk as (select distinct document_id, node_id from nodes), uk as (select document_id, formula_id as unit_id, len(coalesce(symbols, [])) as n from formulas),
broken as (select document_id, 'error' as level, 'edge_source_missing' as code, edge_id as object_id from edges where source_id <> '' and (document_id, source_id) not in (select document_id, node_id from nk)
union select document_id, 'error', 'edge_target_missing', edge_id from edges where target_id <> '' and (document_id, target_id) not in (select document_id, node_id from nk)
union select document_id, 'error', 'meta_edge_source_missing', edge_id from pair where source_id <> '' and (document_id, source_id) not in (select document_id, unit_id from uk)
union select document_id, 'error', 'meta_edge_target_missing', edge_id from pair where target_id <> '' and (document_id, target_id) not in (select document_id, unit_id from uk)
union select document_id, 'error', 'duplicate_edge', source_id || '|' || target_id || '|' || coalesce(edge_type, '') from edges where source_id is not null and target_id is not null group by document_id, source_id, target_id, edge_type having count(*) > 1
union select document_id, 'error', 'duplicate_meta_edge', source_id || '|' || target_id || '|' || coalesce(kind, '') from pair where source_id is not null and target_id is not null group by document_id, source_id, target_id, kind having count(*) > 1
union select document_id, 'error', 'edge_self_loop', edge_id from edges where source_id = target_id union select document_id, 'error', 'meta_edge_self_loop', edge_id from pair where source_id = target_id
union select u.document_id, 'warning', 'isolated_unit', u.unit_id from uk u where (select count(*) from uk x where x.document_id = u.document_id) > 1 and (u.document_id, u.unit_id) not in (select document_id, e from (select document_id, unnest([source_id, target_id]) as e from edges union all select document_id, unnest([source_id, target_id]) from pair) where e is not null)
union select document_id, 'warning', 'unit_without_variables', unit_id from uk where n = 0
union select document_id, 'warning', 'dense_graph', document_id from (select document_id, unnest([source_id, target_id]) as e from pair) group by document_id having count(*) > 10 * count(distinct e))
select document_id, count(*) filter (level = 'error') as errors, count(*) filter (level = 'warning') as warnings, count(*) filter (level = 'error') = 0 as valid from broken group by 1""")
def _(s, d):
    """Errors and warnings of the metagraph of each paper that has any."""
    n, e = current(s, d, "nodes", "node_type"), current(s, d, "edges", "source_id", "target_id", "edge_type").withColumnRenamed("edge_type", "kind")
    units = current(s, d, "formulas", "symbols").select("document_id", F.col("formula_id").alias("unit_id"), F.coalesce(F.when(F.col("symbols").isNotNull(), F.size("symbols")), F.lit(0)).alias("n_variables"))
    m = current(s, d, "metaedges", "source_set", "target_set", "metaedge_type")
    pair = m.select("document_id", F.col("metaedge_id").alias("edge_id"), _ends("source_set").alias("source_id"), "target_set", F.col("metaedge_type").alias("kind")).select("document_id", "edge_id", "source_id", _ends("target_set").alias("target_id"), "kind")
    x = validation.metagraph(n, e, units, pair)
    errors = F.count_if(F.col("level") == "error")
    return x.groupBy("document_id").agg(errors.alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"), (errors == 0).alias("valid"))


# ---- meta edges ---------------------------------------------------------------------------------------------------


def _pages(s: SparkSession, d: str) -> DataFrame:
    """Page of each formula: the first that its token stands on, else page one."""
    b = current(s, d, "blocks", "formula_tokens", "page_number").select("document_id", "page_number", F.explode("formula_tokens").alias("token")).where("token is not null")
    p = b.groupBy("document_id", "token").agg(F.min("page_number").alias("page"))
    return current(s, d, "formulas", "token", "ord").join(p, ["document_id", "token"], "left").select("document_id", "formula_id", "ord", F.coalesce("page", F.lit(1)).alias("page"))


@query("sem_same_page", sql("formulas", "blocks") + """, p as (select document_id, token, min(page_number) as page from (select document_id, page_number, unnest(formula_tokens) as token from blocks) where token is not null group by 1, 2), f as (select f.document_id, f.formula_id, f.ord, coalesce(p.page, 1) as page from formulas f left join p on p.document_id = f.document_id and p.token = f.token)
select * from (select document_id, page, formula_id as source_id, lead(formula_id) over (partition by document_id, page order by ord nulls first, formula_id) as target_id, cast(0.35 as double) as weight from f) where target_id is not null""")
def _(s, d):
    """Neighbours on a page; a chain gives no unit more than two such edges."""
    return graph.consecutive(_pages(s, d), ["document_id", "page"], ["ord", "formula_id"], "formula_id").withColumn("weight", F.lit(0.35))


@query("sem_limited_edges")
def _(s, d):
    """Meta edges of a paper within eight at each end, taken in the order of their relation and weight."""
    row = lambda x, relation, priority, variable=None: x.select("document_id", "source_id", "target_id", F.lit(relation).alias("relation"), F.lit(priority).alias("priority"), (F.col(variable) if variable else F.lit("")).alias("variable"))
    shared = GRAPH["rel_same_symbols"](s, d).select("document_id", F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "symbol")
    mine = definitions(s, d).select("document_id", F.col("formula_id").alias("source_id"), "symbol").distinct()
    every = row(shared, "shared_variable", 2, "symbol").unionByName(row(shared.join(mine, ["document_id", "source_id", "symbol"], "left_semi"), "possible_semantic_dependency", 1, "symbol"))
    every = every.unionByName(row(GRAPH["sem_same_context"](s, d), "same_context", 3)).unionByName(row(GRAPH["sem_sequence"](s, d), "sequence", 4))
    return graph.limited_edges(every, "document_id", ["priority", "source_id", "target_id", "variable", "relation"], 8).drop("priority")


# ---- what a display offers ----------------------------------------------------------------------------------------


_LABEL = "case when regexp_matches(coalesce(token, formula_id), 'FORMULA_[0-9]+') then 'F' || lpad(cast(cast(regexp_extract(coalesce(token, formula_id), 'FORMULA_([0-9]+)', 1) as int) as varchar), 3, '0') when length(coalesce(token, formula_id)) <= 10 then coalesce(token, formula_id) else coalesce(token, formula_id)[1:9] || '…' end"


@query("proj_available_formulas", _RANKED + f"select r.document_id, r.formula_id, f.token, {_LABEL.replace('token', 'f.token').replace('formula_id', 'f.formula_id')} as label, r.n from (select *, row_number() over (partition by document_id order by rank desc, formula_id) as n from ranked) r join formulas f on f.document_id = r.document_id and f.formula_id = r.formula_id where r.n <= 120")
def _(s, d):
    """The 120 formulas of highest rank of each paper, with the label they are offered by."""
    w = Window.partitionBy("document_id").orderBy(F.desc(F.round("rank", 6)), "formula_id")
    top = ranked(s, d).withColumn("n", F.row_number().over(w)).where("n <= 120").select("document_id", "formula_id", "n")
    name = F.coalesce("token", "formula_id")
    number = F.regexp_extract(name, r"FORMULA_([0-9]+)", 1)
    label = F.when(number != "", F.concat(F.lit("F"), F.lpad(number.cast("int").cast("string"), 3, "0"))).when(F.length(name) <= 10, name).otherwise(F.concat(F.substring(name, 1, 9), F.lit("…")))
    return top.join(current(s, d, "formulas", "token"), ["document_id", "formula_id"]).select("document_id", "formula_id", "token", label.alias("label"), "n")


@query("proj_available_variables", sql("formulas") + _FS + "select document_id, symbol, uses, n from (select document_id, symbol, uses, row_number() over (partition by document_id order by uses desc, symbol) as n from (select document_id, symbol, count(distinct formula_id) as uses from fs group by 1, 2)) where n <= 160")
def _(s, d):
    """The 160 variables of each paper with most formulas."""
    w = Window.partitionBy("document_id").orderBy(F.desc("uses"), "symbol")
    return fs(s, d).groupBy("document_id", "symbol").agg(F.countDistinct("formula_id").alias("uses")).withColumn("n", F.row_number().over(w)).where("n <= 160")


@query("proj_formula_details", sql("formulas", "contexts") + DEFS + _FS + """, v as (select document_id, formula_id, string_agg(symbol, '|' order by symbol) as variables from (select distinct document_id, formula_id, symbol from fs) group by 1, 2),
x as (select document_id, formula_id, string_agg(distinct symbol || ': ' || definition, '|' order by symbol || ': ' || definition) as definitions from defs group by 1, 2)
select f.document_id, f.formula_id, f.token, f.latex, f.kind, f.section_id, f.confidence, coalesce(v.variables, '') as variables, coalesce(x.definitions, '') as definitions, coalesce(c.previous_sentence, '') as before_text, coalesce(c.next_sentence, '') as after_text
from formulas f left join v on v.document_id = f.document_id and v.formula_id = f.formula_id left join x on x.document_id = f.document_id and x.formula_id = f.formula_id left join contexts c on c.document_id = f.document_id and c.formula_id = f.formula_id""")
def _(s, d):
    """Each formula with its variables, definitions and surrounding sentences."""
    key = ["document_id", "formula_id"]
    v = fs(s, d).groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("symbol")), "|").alias("variables"))
    x = definitions(s, d).groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set(F.concat("symbol", F.lit(": "), "definition"))), "|").alias("definitions"))
    c = current(s, d, "contexts", "previous_sentence", "next_sentence")
    j = current(s, d, "formulas", "token", "latex", "kind", "section_id", "confidence").join(v, key, "left").join(x, key, "left").join(c, key, "left")
    blank = lambda a, b: F.coalesce(a, F.lit("")).alias(b)
    return j.select(*key, "token", "latex", "kind", "section_id", "confidence", blank("variables", "variables"), blank("definitions", "definitions"), blank("previous_sentence", "before_text"), blank("next_sentence", "after_text"))


_PAYLOAD = f"""with recursive rk as (select document_id, node_id, rank from ({{rank}})), top as (select * from (select *, row_number() over (partition by document_id order by rank desc, node_id) as n from rk) where n <= 80),
edges as (select document_id, edge_id, arg_max({{{{'s': source_id, 't': target_id, 'k': edge_type}}}}, loaded_at) as r from mg_edges group by 1, 2),
e as (select * from (select e.document_id, e.edge_id, e.r.k as kind, row_number() over (partition by e.document_id order by a.n + b.n, e.edge_id) as n from edges e join top a on a.document_id = e.document_id and a.node_id = e.r.s join top b on b.document_id = e.document_id and b.node_id = e.r.t) where n <= 80),
ns as (select document_id, string_agg(node_id, '|' order by n) as nodes, count(*) as n_nodes from top group by 1), es as (select document_id, string_agg(edge_id, '|' order by n) as edges, count(*) as n_edges from e group by 1), every as (select document_id, count(*) as n from rk group by 1)
select ns.document_id, ns.nodes, coalesce(es.edges, '') as edges, every.n - ns.n_nodes as hidden from ns left join es on es.document_id = ns.document_id join every on every.document_id = ns.document_id"""


def _payload_sql() -> str:
    from papyrine.plans.formula_queries import SQL as S

    return _PAYLOAD.format(rank=S["proj_node_rank"])


@query("proj_payload", _payload_sql())
def _(s, d):
    """One payload a paper: its 80 nodes of highest rank, the 80 edges between them that join the highest, and how many nodes are hidden."""
    from papyrine.plans.formula_queries import QUERIES as Q

    rk = Q["proj_node_rank"](s, d)
    w = Window.partitionBy("document_id").orderBy(F.desc("rank"), "node_id")
    top = rk.withColumn("n", F.row_number().over(w)).where("n <= 80").select("document_id", "node_id", "n")
    end = lambda c, k: top.select("document_id", F.col("node_id").alias(c), F.col("n").alias(k))
    e = current(s, d, "edges", "source_id", "target_id").join(end("source_id", "a"), ["document_id", "source_id"]).join(end("target_id", "b"), ["document_id", "target_id"])
    e = e.withColumn("m", F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("a") + F.col("b"), "edge_id"))).where("m <= 80")
    listed = lambda i, k: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(i, k))), lambda x: x[k]), "|")  # noqa: E731  80 at most
    ns = top.groupBy("document_id").agg(listed("n", "node_id").alias("nodes"), F.count(F.lit(1)).alias("shown"))
    es = e.groupBy("document_id").agg(listed("m", "edge_id").alias("edges"))
    every = rk.groupBy("document_id").agg(F.count(F.lit(1)).alias("every"))
    return ns.join(es, "document_id", "left").join(every, "document_id").select("document_id", "nodes", F.coalesce("edges", F.lit("")).alias("edges"), (F.col("every") - F.col("shown")).alias("hidden"))
