"""Queries of problem 2: parent-child links to full hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.operators import hierarchy as op
from papyrine.sources.tables import table


def sections(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "graph_sections", "document_id", "section_id", "parent_id", "sec_level", "ord", "loaded_at")
    return op.cut(op.latest(rows, ["document_id", "section_id"], "loaded_at", ["parent_id", "sec_level", "ord"]))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = sections(spark, d)
    h = op.hierarchy(rows, "document_id", "section_id", "parent_id", "ord")
    level = rows.select("document_id", "section_id", "sec_level")
    both = h.join(level, F.col("tree").eqNullSafe(F.col("document_id")) & F.col("id").eqNullSafe(F.col("section_id")))
    return both.where("cyclic or sec_level <> depth").select("document_id", "section_id", F.col("root").alias("root_id"))


def p2_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth, root and number of descendants of each section."""
    h = op.cut(op.hierarchy(sections(spark, d), "document_id", "section_id", "parent_id", "ord"))
    p = op.paths(h).select(F.col("tree").alias("p_tree"), F.col("id").alias("p_id"), "path")
    both = h.join(p, F.col("tree").eqNullSafe(F.col("p_tree")) & (F.col("id") == F.col("p_id")), "left")
    return both.select(F.col("tree").alias("document_id"), F.col("id").alias("section_id"), F.col("root").alias("root_id"), "depth", "path", "n_descendants", "cyclic")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    h = op.hierarchy(sections(spark, d), "document_id", "section_id", "parent_id", "ord")
    return op.descendants(op.cut(h)).select(F.col("tree").alias("document_id"), F.col("ancestor").alias("ancestor_id"), F.col("id").alias("section_id"))


_SQL = r"""
with recursive s as (
  select document_id, section_id, r.parent_id as parent_id, r.sec_level as sec_level
  from (select document_id, section_id, arg_max({'parent_id': parent_id, 'sec_level': sec_level}, loaded_at) as r from graph_sections group by 1, 2)
),
l as (select a.document_id, a.section_id, b.section_id as parent_id, a.sec_level from s a left join s b on a.document_id = b.document_id and a.parent_id = b.section_id),
t as (
  select document_id, section_id, section_id as root_id, 1 as depth, section_id as path from l where parent_id is null
  union all
  select l.document_id, l.section_id, t.root_id, t.depth + 1, t.path || ' / ' || l.section_id from l join t on l.document_id = t.document_id and l.parent_id = t.section_id
),
lost as (select * from l where (document_id, section_id) not in (select (document_id, section_id) from t)),
reach as (
  select document_id, section_id, parent_id as at_id from lost
  union
  select r.document_id, r.section_id, x.parent_id from reach r join lost x on r.document_id = x.document_id and r.at_id = x.section_id
),
cyc as (select document_id, section_id from reach where section_id = at_id),
lostroot as (select r.document_id, r.section_id, min(r.at_id) as root_id from reach r join cyc c on r.document_id = c.document_id and r.at_id = c.section_id group by 1, 2),
anc as (
  select document_id, section_id, parent_id as ancestor_id from l where parent_id is not null and (document_id, section_id) in (select (document_id, section_id) from t)
  union all
  select a.document_id, a.section_id, l.parent_id from anc a join l on a.document_id = l.document_id and a.ancestor_id = l.section_id where l.parent_id is not null
)
"""

QUERIES = {"p2_found": p2_found, "p2_hierarchy": p2_hierarchy, "p2_descendants": p2_descendants}
SQL = {
    "p2_found": _SQL + "select t.document_id, t.section_id, t.root_id from t join l using (document_id, section_id) where l.sec_level <> t.depth union all select document_id, section_id, root_id from lostroot",
    "p2_hierarchy": _SQL
    + """select t.document_id, t.section_id, t.root_id, t.depth, t.path, coalesce(n.n, 0) as n_descendants, false as cyclic
from t left join (select document_id, ancestor_id, count(*) as n from anc group by 1, 2) n on n.document_id = t.document_id and n.ancestor_id = t.section_id
union all select document_id, section_id, root_id, null, null, null, true from lostroot""",
    "p2_descendants": _SQL + "select document_id, ancestor_id, section_id from anc",
}
