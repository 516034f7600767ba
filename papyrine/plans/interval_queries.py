"""Interval operators over the boxes of a page and over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.operators import intervals as op
from papyrine.plans.base import current, sql
from papyrine.sources.tables import table

QUERIES, SQL = {}, {}


def _boxes(s, d):
    return current(s, d, "layers", "page_number", "bbox").select("document_id", "page_number", "block_id", F.col("bbox.y0").alias("y0"), F.col("bbox.y1").alias("y1"))


def geo_merged_bands(s, d):
    """Bands of a page that blocks cover, top to bottom."""
    return op.merged(_boxes(s, d), ["document_id", "page_number"], "y0", "y1")


def geo_overlapping_blocks(s, d):
    """Pairs of a heading and a block of its page whose boxes overlap in height."""
    x = _boxes(s, d)
    h = current(s, d, "layers", "block_role").where("block_role = 'heading'").select("document_id", "block_id")
    return op.overlapping(x.join(h, ["document_id", "block_id"], "left_semi").withColumnRenamed("block_id", "heading_id"), x, ["document_id", "page_number"], "y0", "y1", 200.0, "heading_id", "block_id").where("heading_id <> block_id")


def ops_price_as_of(s, d):
    """Each order with the last event before it: last row at or before a time, within a group."""
    e = table(s, d, "events", "user_id", "ts", "event_type").groupBy("user_id", "ts").agg(F.max("event_type").alias("event_type"))
    o = table(s, d, "orders", "o_orderkey", "o_custkey", "o_orderdate").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts")).withColumn("ts", F.col("ts").cast(e.schema["ts"].dataType))
    return op.as_of(o, e, ["user_id"], "ts", "event_type").select("o_orderkey", "event_type")


QUERIES = {"geo_merged_bands": geo_merged_bands, "geo_overlapping_blocks": geo_overlapping_blocks, "ops_last_event_before": ops_price_as_of}
_B = sql("layers") + ", b as (select document_id, page_number, block_id, block_role, bbox.y0 as y0, bbox.y1 as y1 from layers where bbox.y0 <= bbox.y1)\n"
SQL = {
    "geo_merged_bands": _B + """select document_id, page_number, min(y0) as start, max(y1) as "end", count(*) as n from (select *, sum(fresh) over (partition by document_id, page_number order by y0, y1 rows unbounded preceding) as island from
(select *, case when y0 <= max(y1) over (partition by document_id, page_number order by y0, y1 rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from b)) group by document_id, page_number, island""",
    "geo_overlapping_blocks": _B + "select h.document_id, h.page_number, h.block_id as heading_id, o.block_id from b h join b o on o.document_id = h.document_id and o.page_number = h.page_number and o.block_id <> h.block_id and h.y0 <= o.y1 and o.y0 <= h.y1 where h.block_role = 'heading'",
    "ops_last_event_before": "select o.o_orderkey, (select max(e.event_type) from events e where e.user_id = o.o_custkey and e.ts = (select max(x.ts) from events x where x.user_id = o.o_custkey and x.ts <= o.o_orderdate)) as event_type from orders o",
}
