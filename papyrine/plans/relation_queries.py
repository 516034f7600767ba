"""Relations and letters whole where the older queries of their family keep to a budget: nothing is capped, pairs come as class and count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.operators import graph
from papyrine.plans.base import current, sql
from papyrine.plans.definitions import DEFS, definitions
from papyrine.plans.graph_queries import _FS, _FSQ, fs

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


@query("rel_symbol_classes", _FSQ + """select document_id, symbol, formula_id, row_number() over (partition by document_id, symbol order by ord nulls first, formula_id) as place, row_number() over (partition by document_id, symbol order by ord nulls first, formula_id) - 1 as earlier, count(*) over (partition by document_id, symbol) as n from fs""")
def _(s, d):
    """All links by a common symbol, also those beyond the budget of rel_same_symbols: formula `place` of a class of n links to the `earlier` ones before it."""
    return graph.member_classes(fs(s, d), ["document_id", "symbol"], "formula_id", "ord")


_WHERE_DEFINED = ", defining as (select distinct document_id, formula_id, symbol from defs)\n"


def defining(s: SparkSession, d: str) -> DataFrame:
    """Formulas and the symbols that their context defines, spelled like the symbols of formulas."""
    return definitions(s, d).select("document_id", "formula_id", "symbol").distinct()


@query("sem_shared_variable", sql("formulas", "contexts") + DEFS + _FS + _WHERE_DEFINED + """select fs.document_id, fs.symbol, fs.formula_id, row_number() over w as place, count(*) over (partition by fs.document_id, fs.symbol) - row_number() over w as later, g.symbol is not null as defines
from fs left join defining g on g.document_id = fs.document_id and g.formula_id = fs.formula_id and g.symbol = fs.symbol window w as (partition by fs.document_id, fs.symbol order by fs.ord nulls first, fs.formula_id)""")
def _(s, d):
    """O6c and O6d as class and count: each formula has an edge to the `later` ones with the symbol, a possible dependency where it defines the symbol."""
    classes = graph.member_classes(fs(s, d), ["document_id", "symbol"], "formula_id", "ord")
    mine = defining(s, d).withColumn("defines", F.lit(True))
    return classes.join(mine, ["document_id", "formula_id", "symbol"], "left").select("document_id", "symbol", "formula_id", "place", (F.col("n") - F.col("place")).alias("later"), F.coalesce("defines", F.lit(False)).alias("defines"))


_NAMED = r"\(([0-9]{1,4}[a-zA-Z]?)\)"


@query("rel_of_contexts", sql("formulas", "contexts") + DEFS + _FS + _WHERE_DEFINED + f"""select 'variable_defined_in_context' as relation, fs.document_id, fs.symbol as source_id, 'ctx:' || fs.formula_id as target_id, cast(case when g.symbol is null then 0.55 else 0.72 end as double) as confidence
from fs join contexts c on c.document_id = fs.document_id and c.formula_id = fs.formula_id left join defining g on g.document_id = fs.document_id and g.formula_id = fs.formula_id and g.symbol = fs.symbol
union all select distinct 'formula_references_formula', c.document_id, c.formula_id, f.formula_id, cast(0.62 as double) from (select document_id, formula_id, unnest(regexp_extract_all(concat_ws(' ', previous_sentence, current_sentence, next_sentence), '{_NAMED}', 1)) as ref from contexts) c
join formulas own on own.document_id = c.document_id and own.formula_id = c.formula_id join formulas f on f.document_id = c.document_id and cast(f.ord as varchar) = c.ref and f.formula_id <> c.formula_id""")
def _(s, d):
    """Relations of contexts: variables to the contexts of their formulas, formulas to those whose number their context names."""
    c, f = current(s, d, "contexts", "previous_sentence", "current_sentence", "next_sentence"), current(s, d, "formulas", "ord")
    key = ["document_id", "formula_id"]
    of = fs(s, d).join(c.select(*key), key).join(defining(s, d).withColumn("g", F.lit(True)), [*key, "symbol"], "left")
    a = of.select(F.lit("variable_defined_in_context").alias("relation"), "document_id", F.col("symbol").alias("source_id"), F.concat(F.lit("ctx:"), "formula_id").alias("target_id"), F.when(F.col("g"), 0.72).otherwise(0.55).alias("confidence"))
    named = F.explode(F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "previous_sentence", "current_sentence", "next_sentence"), F.lit(_NAMED), 1))).alias("ref")
    refs = c.join(f.select(*key), key, "left_semi").select("document_id", F.col("formula_id").alias("source_id"), named)
    b = refs.join(f.select("document_id", F.col("formula_id").alias("target_id"), F.col("ord").cast("string").alias("ref")), ["document_id", "ref"]).where("source_id <> target_id").distinct()
    return a.unionByName(b.select(F.lit("formula_references_formula").alias("relation"), "document_id", "source_id", "target_id", F.lit(0.62).alias("confidence")).distinct())
