"""Search queries, each with one value of its parameter; the operators take any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions import notation
from papyrine.operators import search
from papyrine.plans.base import current, sql
from papyrine.plans.definitions import DEFS, definitions
from papyrine.plans.graph_queries import _FS, _FSQ, fs
from papyrine.sources.tables import table

QUERIES, SQL = {}, {}
#: What the queries ask for.
VARIABLE, INDEXED, SUGGESTED, SUBSTRING, FORMULA, WORD, NODE = "λ", "x_2", "lam", "rho", "F3", "entropy", "var_0001"


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def matches(s: SparkSession, d: str, asked: str) -> DataFrame:
    contexts = current(s, d, "contexts", "current_sentence").withColumnRenamed("current_sentence", "near")
    return search.variable(fs(s, d), current(s, d, "formulas", "latex", "section_id"), contexts, current(s, d, "blocks", "text", "section_id"), asked)


def _matches_sql(asked: str, symbol: str) -> str:
    said = f"contains(text, '{symbol}')" if symbol.startswith("\\") else f"regexp_matches(text, '(^|[^A-Za-z0-9_\\\\]){symbol}($|[^A-Za-z0-9_])')"
    return f""", hits as (select distinct document_id, formula_id, section_id from fs where symbol = '{symbol}'),
own as (select h.*, c.current_sentence as near, case when c.formula_id is null then 0.78 else 0.9 end as confidence from hits h left join contexts c on c.document_id = h.document_id and c.formula_id = h.formula_id),
matches as (select document_id, 'formula' as kind, formula_id, null as block_id, section_id, near, cast(confidence as double) as confidence from own
union all select b.document_id, 'text_mention', null, b.block_id, b.section_id, b.text, cast(0.62 as double) from blocks b where {said} and b.document_id in (select document_id from hits) and not exists (select 1 from own o where o.document_id = b.document_id and o.near = b.text)
union all select f.document_id, 'fallback', f.formula_id, null, f.section_id, c.current_sentence, cast(0.55 as double) from formulas f left join contexts c on c.document_id = f.document_id and c.formula_id = f.formula_id
where (contains(f.latex, '{asked}') or contains(f.latex, '{symbol}')) and f.document_id not in (select document_id from hits))
"""


_M = sql("formulas", "contexts", "blocks") + _FS


@query("search_variable", _M + _matches_sql(VARIABLE, "\\lambda") + "select * from matches")
def _(s, d):
    return matches(s, d, VARIABLE)


@query("search_indexed_variable", _M + _matches_sql(INDEXED, INDEXED) + "select * from matches")
def _(s, d):
    return matches(s, d, INDEXED)


@query("search_corpus_variable", sql("formulas", "contexts", "blocks") + DEFS + _FS + _matches_sql(VARIABLE, "\\lambda") + """, n as (select document_id, count(distinct lower(definition)) as n from defs where symbol = '\\lambda' group by 1)
select m.*, coalesce(n.n, 0) as n_definitions, case when n_sections = 1 then 'section' else 'document' end as level from (select document_id, count(*) as n_matches, count(distinct formula_id) as n_formulas, count(distinct case when formula_id is not null then section_id end) as n_sections, max(confidence) as confidence from matches group by 1) m left join n on n.document_id = m.document_id""")
def _(s, d):
    return search.corpus_variable(matches(s, d, VARIABLE), definitions(s, d), VARIABLE)


@query("search_conflicts", sql("contexts") + DEFS + """, m as (select lower(trim(definition)) as meaning, min(document_id) as doc from defs where symbol = 'x_2' group by 1), o as (select *, row_number() over (order by doc, meaning) as r from m where meaning <> '')
select a.doc as document_a, a.meaning as meaning_a, b.doc as document_b, b.meaning as meaning_b from o a join o b on a.r = 1 and b.r between 2 and 6""")
def _(s, d):
    return search.conflicts(definitions(s, d), INDEXED)


@query("search_substring", sql("formulas") + f"select document_id, formula_id, cast(0.55 as double) as confidence from formulas where contains(latex, '{SUBSTRING}')")
def _(s, d):
    return search.substring(current(s, d, "formulas", "latex"), SUBSTRING)


@query("search_suggestions", _FSQ + f"""select symbol, cast(score as double) as score from (select symbol, round(case when contains(v, '{SUGGESTED}') then 10 else 0 end + case when v[1] = '{SUGGESTED[0]}' then 2 else 0 end - 0.1 * abs(length(v) - {len(SUGGESTED)}), 4) as score from (select symbol, lower(ltrim(symbol, '\\')) as v from (select distinct symbol from fs))) where score > 0 order by score desc, symbol desc limit 12""")
def _(s, d):
    return search.suggestions(fs(s, d), SUGGESTED)


_ALIASES = """, num as (select document_id, formula_id, token, unnest(list_filter([regexp_extract(lower(coalesce(token, '')), 'formula_([0-9]+)', 1), regexp_extract(formula_id, '([0-9]{1,4})$', 1)], lambda x: x <> '')) as n from formulas),
aliases as (select distinct document_id, formula_id, alias from (select document_id, formula_id, unnest(['f' || cast(n as int), 'f' || lpad(cast(cast(n as int) as varchar), 3, '0'), 'formula_' || cast(n as int), 'formula_' || lpad(cast(cast(n as int) as varchar), 3, '0'), cast(cast(n as int) as varchar)]) as alias from num
union all select document_id, formula_id, unnest([lower(formula_id), lower(coalesce(token, ''))]) from formulas) where alias <> '')
"""


@query("search_formula_aliases", sql("formulas") + _ALIASES + "select * from aliases")
def _(s, d):
    return search.formula_aliases(current(s, d, "formulas", "token"))


@query("search_formula_by_id", sql("formulas") + _ALIASES + f"select f.document_id, f.formula_id, f.latex, f.confidence from formulas f join (select document_id, min(formula_id) as formula_id from aliases where alias = '{FORMULA.lower()}' group by 1) a on a.document_id = f.document_id and a.formula_id = f.formula_id")
def _(s, d):
    return search.formula(current(s, d, "formulas", "token", "latex", "confidence"), FORMULA).drop("token")


@query("search_text", sql("blocks") + f"select document_id, block_id from blocks where contains(lower(text), '{WORD}')")
def _(s, d):
    return search.text(current(s, d, "blocks", "text"), WORD)


_BOTH = "pairs as (select distinct document_id, source_id as a, target_id as b from edges where source_id is not null and target_id is not null union select distinct document_id, target_id, source_id from edges where source_id is not null and target_id is not null)"


@query("proj_neighbourhood", sql("edges") + f""", seed as (select distinct document_id, node_id as id from mg_nodes where node_label = '{VARIABLE}'), {_BOTH}
select document_id, id, 0 as hop from seed union all select distinct s.document_id, o.b, 1 from seed s join pairs o on o.document_id = s.document_id and o.a = s.id where not exists (select 1 from seed t where t.document_id = s.document_id and t.id = o.b)""")
def _(s, d):
    """One step from the nodes of a variable, both ways."""
    seeds = table(s, d, "mg_nodes", "document_id", F.col("node_id").alias("id"), "node_label").where(F.col("node_label") == VARIABLE)
    return search.neighbourhood(current(s, d, "edges", "source_id", "target_id"), seeds, 1)


@query("proj_two_hops", sql("edges") + f""", {_BOTH.replace("from edges where", "from edges where edge_type = 'has_symbol' and")}, w as (select document_id, '{NODE}' as id, 0 as hop from pairs where a = '{NODE}' union select o.document_id, o.b, w.hop + 1 from w join pairs o on o.document_id = w.document_id and o.a = w.id where w.hop < 2)
select document_id, id, min(hop) as hop from w group by 1, 2""")
def _(s, d):
    """Two steps from a variable over symbol edges."""
    e = current(s, d, "edges", "source_id", "target_id", "edge_type").where("edge_type = 'has_symbol' and source_id is not null and target_id is not null")
    seeds = search.neighbourhood(e, e.select("document_id", F.explode(F.array("source_id", "target_id")).alias("id")).where(F.col("id") == NODE), 0)
    return search.neighbourhood(e, seeds, 2)


@query("proj_mode_aliases", "with recursive t(alias, mode) as (values " + ", ".join(f"('{a}', '{m}')" for a, m in notation.MODES.items()) + ") select alias, mode from t")
def _(s, d):
    return search.modes(s)
