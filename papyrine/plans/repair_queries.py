"""Repairs, salvage, payloads and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyrine.functions import latex
from papyrine.plans.base import current, sql
from papyrine.plans.graph_queries import _DEF, definitions
from papyrine.sources.tables import table

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


_F = sql("formulas")
_REPAIR = "latex"
for _name, _command in latex.SPACED_NAMES.items():
    _REPAIR = f"regexp_replace({_REPAIR}, '(^|[^A-Za-z\\\\])" + "\\s+".join(_name) + f"([^A-Za-z]|$)', '\\1\\\\{_command.lstrip(chr(92))}\\2', 'g')"
_REPAIR = f"trim(regexp_replace(regexp_replace(regexp_replace({_REPAIR}, '\\\\\\\\([A-Za-z])', '\\\\\\1', 'g'), '\\.{{4,}}', '...', 'g'), '[ \\t]+', ' ', 'g'))"


@query("latex_repaired", _F + f"select document_id, formula_id, {_REPAIR} as repaired from formulas")
def _(s, d):
    return current(s, d, "formulas", "latex").select("document_id", "formula_id", latex.repaired(F.col("latex")).alias("repaired"))


@query("latex_prose_like", _F + "select document_id, formula_id, len(regexp_extract_all(regexp_replace(latex, '\\\\[A-Za-z]+', ' ', 'g'), '\\p{L}{4,}')) >= 3 and len(regexp_extract_all(latex, '[=<>+^_\\\\]')) < 5 as prose from formulas where latex is not null")
def _(s, d):
    return current(s, d, "formulas", "latex").where("latex is not null").select("document_id", "formula_id", latex.prose_like(F.col("latex")).alias("prose"))


@query("latex_best_row")
def _(s, d):
    """Row of each formula with most mathematics; ties go to the longer, then the larger row."""
    f = current(s, d, "formulas", "latex").select("document_id", "formula_id", F.explode(latex.rows(F.col("latex"))).alias("row"))
    score = F.regexp_count("row", F.lit(r"\\[A-Za-z]+|[=<>_^]"))
    return f.groupBy("document_id", "formula_id").agg(F.max_by("row", F.struct(score.alias("s"), F.length("row").alias("n"), F.col("row").alias("r"))).alias("best"))


@query("corpus_concept_classes", _DEF + "select symbol, lower(definition) as meaning, min(document_id) as first_document, count(distinct document_id) - 1 as others from defs group by 1, 2 having count(distinct document_id) > 1")
def _(s, d):
    x = definitions(s, d).groupBy("symbol", F.lower("definition").alias("meaning")).agg(F.min("document_id").alias("first_document"), (F.countDistinct("document_id") - 1).alias("others"))
    return x.where("others > 0")


@query("proj_serialized_nodes")
def _(s, d):
    """First eighty nodes of each paper by id, as JSON."""
    w = Window.partitionBy("document_id").orderBy("node_id")
    x = current(s, d, "nodes", "node_type", "node_label").withColumn("r", F.row_number().over(w)).where("r <= 80")
    return x.select("document_id", "node_id", F.to_json(F.struct(F.col("node_id").alias("id"), F.col("node_type").alias("type"), F.col("node_label").alias("label"))).alias("json"))


@query("ops_sample_papers", "select document_id from (select distinct document_id from paper_profiles where document_id is not null) order by md5(document_id), document_id limit 20")
def _(s, d):
    """A repeatable sample of papers (a sampling operator: the size is its parameter)."""
    return table(s, d, "paper_profiles", "document_id").where("document_id is not null").distinct().orderBy(F.md5("document_id"), "document_id").limit(20)


@query("ops_manual_candidates", _F + "select document_id, formula_id from (select document_id, formula_id, row_number() over (partition by document_id order by coalesce(confidence, 0.0), formula_id) as r from formulas where coalesce(confidence, 0.0) < 0.75 or coalesce(trim(latex), '') = '') where r <= 5")
def _(s, d):
    w = Window.partitionBy("document_id").orderBy(F.coalesce("confidence", F.lit(0.0)), "formula_id")
    x = current(s, d, "formulas", "confidence", "latex").where("coalesce(confidence, 0.0) < 0.75 or coalesce(trim(latex), '') = ''")
    return x.withColumn("r", F.row_number().over(w)).where("r <= 5").select("document_id", "formula_id")


@query("ops_corrections_latest", "select user_id, event_type, max(ts) as seen, arg_max(value, {'t': ts, 'i': event_id}) as value from events group by 1, 2")
def _(s, d):
    """Latest value of each key from a log of corrections."""
    e = table(s, d, "events", "user_id", "event_type", "ts", "event_id", "value")
    return e.groupBy("user_id", "event_type").agg(F.max("ts").alias("seen"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))
