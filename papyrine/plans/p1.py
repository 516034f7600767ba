"""Queries of problem 1: references to records that do not exist."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from papyrine.operators import orphans as op
from papyrine.sources.tables import table


def all_references(spark: SparkSession, d: str) -> DataFrame:
    refs = [
        op.references(table(spark, d, "mg_edges", "document_id", "edge_id", "target_id", "loaded_at"), "mg_edges", "edge_id", "target_id"),
        op.references(table(spark, d, "mg_metaedges", "document_id", "metaedge_id", "source_set", "loaded_at"), "mg_metaedges", "metaedge_id", "source_set"),
        op.references(table(spark, d, "mg_metavertices", "document_id", "metavertex_id", "contains_ids", "loaded_at"), "mg_metavertices", "metavertex_id", "contains_ids"),
        op.references(table(spark, d, "graph_text_blocks", "document_id", "block_id", "formula_tokens", "loaded_at"), "graph_text_blocks", "block_id", "formula_tokens", "token"),
    ]
    return reduce(DataFrame.unionByName, refs)


def all_parents(spark: SparkSession, d: str) -> DataFrame:
    rows = [
        op.parents(table(spark, d, "mg_nodes", "document_id", "node_id", "loaded_at", "deleted_at"), "node_id"),
        op.parents(table(spark, d, "mg_metavertices", "document_id", "metavertex_id", "loaded_at", "deleted_at"), "metavertex_id"),
        op.parents(table(spark, d, "formula_index", "document_id", "token", "loaded_at", "deleted_at"), "token", "token"),
    ]
    return reduce(DataFrame.unionByName, rows)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Orphans as the batches of the incremental operator found them."""
    found = [batch.found.select(*op.REF) for _, _, batch in op.fold(all_references(spark, d), all_parents(spark, d))]
    return reduce(DataFrame.union, found).distinct()


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphans by referring table and month, and how many of them were answered later, in whatever month."""
    return op.orphan_counts(op.orphans(all_references(spark, d), all_parents(spark, d)).distinct())


def p1_pending(spark: SparkSession, d: str) -> DataFrame:
    """References that wait for a target at the end of each month."""
    return op.pending(all_references(spark, d), all_parents(spark, d))


_REFS_SQL = r"""
refs as (
  select ref_table, document_id, record_id, min(seen) over (partition by ref_table, document_id, record_id) as seen, ref_key
  from (
    select 'mg_edges' as ref_table, document_id, edge_id as record_id, loaded_at as seen, target_id as ref_key from mg_edges
    union all select 'mg_metaedges', document_id, metaedge_id, loaded_at, unnest(case when len(source_set) > 0 then source_set else [null] end) from mg_metaedges
    union all select 'mg_metavertices', document_id, metavertex_id, loaded_at, unnest(case when len(contains_ids) > 0 then contains_ids else [null] end) from mg_metavertices
    union all select 'graph_text_blocks', document_id, block_id, loaded_at, unnest(case when len(formula_tokens) > 0 then formula_tokens else [null] end) from graph_text_blocks
  )
),
keyed as (
  select distinct ref_table, document_id, record_id, seen, k as ref_key,
    case when ref_table <> 'graph_text_blocks' and instr(k, '::') > 0 then substr(k, 1, instr(k, '::') - 1) else document_id end as tdoc,
    case when ref_table = 'graph_text_blocks' then 't:' || regexp_replace(regexp_replace(k, '^\[|\]$', '', 'g'), '_0+([0-9])', '_\1')
         when instr(k, '::') > 0 then 'g:' || substr(k, instr(k, '::') + 2) else 'g:' || k end as tkey
  from (select *, regexp_replace(ref_key, '^\s+|\s+$', '', 'g') as k from refs) where k is not null and k <> ''
),
targets as (
  select document_id as tdoc, 'g:' || node_id as tkey, loaded_at, deleted_at from mg_nodes
  union all select document_id, 'g:' || metavertex_id, loaded_at, deleted_at from mg_metavertices
  union all select document_id, 't:' || regexp_replace(regexp_replace(token, '^\[|\]$', '', 'g'), '_0+([0-9])', '_\1'), loaded_at, deleted_at from formula_index
),
found as (
  select * from keyed k where not exists (
    select 1 from targets t where t.tdoc = k.tdoc and t.tkey = k.tkey and t.loaded_at <= k.seen and (t.deleted_at is null or t.deleted_at > k.seen))
)
"""

QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p1_pending": p1_pending}
SQL = {
    "p1_found": f"with {_REFS_SQL} select distinct ref_table, document_id, record_id, ref_key from found",
    "p1_counts": f"""with {_REFS_SQL} select ref_table, cast(date_trunc('month', seen) as timestamp) as period, count(*) as n_orphans,
count(*) filter (exists (select 1 from targets t where t.tdoc = f.tdoc and t.tkey = f.tkey and t.loaded_at > f.seen and (t.deleted_at is null or t.deleted_at > t.loaded_at))) as n_resolved
from (select distinct ref_table, document_id, record_id, ref_key, seen, tdoc, tkey from found) f group by 1, 2""",
    "p1_pending": f"""with {_REFS_SQL}, months as (select distinct ref_table, date_trunc('month', seen) as m from keyed)
select ref_table, cast(m as timestamp) as period, count(*) filter (not exists (
  select 1 from targets t where t.tdoc = k.tdoc and t.tkey = k.tkey and date_trunc('month', t.loaded_at) <= m
  and (t.deleted_at is null or t.deleted_at > t.loaded_at and date_trunc('month', t.deleted_at) > m))) as n_pending
from months join keyed k using (ref_table) where date_trunc('month', k.seen) <= m group by 1, 2""",
}
