"""References to records that do not exist.

State is kept for every key of the parent index: how many parent rows are live, which deletions are still to come, and
which references wait for a target. ``advance`` takes one batch: arrivals and deletions of the batch become, with the
live rows carried in from the state, the times at which each key starts and ceases to be answered (its flips); new
references look up the flips of their key, arriving parents resolve waiting orphans, deletions reopen them. ``fold``
runs it over the periods of tables that hold a history. Changes are added up by key and instant before anything is
shuffled, and references join the flips by key, one row for each key, so that a key with a third of all references is
split by the join like any other skewed key.

Defined results
* null and blank references are no references; a reference is trimmed of white space, otherwise taken letter for letter
* rows delivered again change nothing: two live rows of a key answer as one does
* a parent without loaded_at is never live; one deleted at or before its arrival is never live
* a record without loaded_at probes before anything arrived, so each of its references is an orphan
* a null document id is a key like any other, and a reference in a record without document matches nothing; rows
  without a record id are one record for each content, so that no group of all of them is gathered
* empty tables give an empty result; further columns of the inputs are ignored
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.operators.common import cut, trimmed

KEY = ("space", "target_document", "target_key")
REF = ("ref_table", "document_id", "record_id", "ref_key")
REF_SCHEMA = "ref_table string, document_id string, record_id string, ref_key string, space string, target_document string, target_key string, at timestamp"
PARENT_SCHEMA = "space string, target_document string, target_key string, loaded_at timestamp, deleted_at timestamp"


def token_key(token: Column) -> Column:
    """A formula token without brackets and leading zeros: ``[FORMULA_001]`` and ``FORMULA_1`` are one key."""
    bare = trimmed(F.regexp_replace(trimmed(token), r"^\[|\]$", ""))
    return F.regexp_replace(bare, r"(?<![0-9])0+(?=[0-9])", "")


def references(df: DataFrame, ref_table: str, record: str, targets: str, space: str = "graph") -> DataFrame:
    """The references of a table's records, one row each, at the first loaded_at of the record.

    targets is a string or an array of strings. With space ``graph`` a reference may name another document before
    ``::``; with ``token`` it is a formula token of the same document.
    """
    values = F.col(targets)
    if not df.schema[targets].dataType.typeName().startswith("array"):
        values = F.array(values)
    own = df.select("document_id", F.col(record).alias("record_id"), F.coalesce(values, F.array().cast("array<string>")).alias("v"), "loaded_at")
    # Deliveries of a record have one content, so its set is small; rows without an id are told apart by their content.
    apart = F.when(F.col("record_id").isNull(), F.xxhash64("v")).otherwise(F.lit(0))
    per_record = own.groupBy("document_id", "record_id", apart.alias("apart")).agg(F.min("loaded_at").alias("at"), F.collect_set("v").alias("v"))
    refs = (
        per_record.select("document_id", "record_id", "at", F.explode(F.array_distinct(F.transform(F.flatten("v"), trimmed))).alias("ref_key"))
        .where("ref_key is not null and ref_key <> ''")
        .withColumn("ref_table", F.lit(ref_table))
        .withColumn("space", F.lit(space))
    )
    if space == "token":
        doc, key = F.col("document_id"), token_key(F.col("ref_key"))
    else:
        cut_at = F.instr("ref_key", "::")
        doc = F.when(cut_at > 0, F.substring(F.col("ref_key"), F.lit(1), cut_at - 1)).otherwise(F.col("document_id"))
        key = F.when(cut_at > 0, F.substring(F.col("ref_key"), cut_at + 2, F.length("ref_key"))).otherwise(F.col("ref_key"))
    return refs.select(*REF, "space", doc.alias("target_document"), key.alias("target_key"), "at")


def parents(df: DataFrame, key: str, space: str = "graph") -> DataFrame:
    """The parent rows of a table in the shape that ``advance`` takes."""
    value = token_key(F.col(key)) if space == "token" else F.col(key)
    return df.select(F.lit(space).alias("space"), F.col("document_id").alias("target_document"), value.alias("target_key"), "loaded_at", "deleted_at")


def _deltas(parent_rows: DataFrame) -> DataFrame:
    live = parent_rows.where("loaded_at is not null and target_key is not null and target_document is not null and (deleted_at is null or deleted_at > loaded_at)")
    both = F.array(F.struct(F.col("loaded_at").alias("at"), F.lit(1).alias("delta")), F.struct(F.col("deleted_at").alias("at"), F.lit(-1).alias("delta")))
    return live.select(*KEY, F.explode(both).alias("e")).select(*KEY, "e.at", "e.delta").where("at is not null")


def flips(changes: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """(KEY, flips, live) of every key: the instants (at, live) at which it starts and ceases to be answered, in order,
    and its live rows after the last one.

    live (KEY, live) are the rows carried in; their flip has no time and comes first. Changes (KEY, at, delta) are added
    up by instant, so what is sorted for one key are the instants at which it changed.
    """
    rows = changes.groupBy(*KEY, "at").agg(F.sum("delta").alias("delta")).where("delta <> 0")
    if live is not None:
        rows = rows.unionByName(live.select(*KEY, F.lit(None).cast("timestamp").alias("at"), F.col("live").alias("delta")))
    over = Window.partitionBy(*KEY).orderBy(F.col("at").asc_nulls_first())
    rows = rows.select(*KEY, "at", "delta", F.sum("delta").over(over.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
    before = F.col("n") - F.col("delta")
    flip = F.when((F.col("n") > 0) != (before > 0), F.struct("at", (F.col("n") > 0).alias("live")))
    return rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(flip)).alias("flips"), F.sum("delta").alias("live"))


def probed(refs: DataFrame, known: DataFrame) -> DataFrame:
    """Every reference (REF, KEY, at) with whether it was answered when it came, and when it was answered next if not.

    A reference without a time came before everything. At one instant, parents go before references.
    """
    x = refs.join(known.select(*KEY, "flips"), list(KEY), "left")
    upto = F.filter("flips", lambda f: f["at"].isNull() | (f["at"] <= F.col("at")))
    after = F.filter("flips", lambda f: f["live"] & (F.col("at").isNull() & f["at"].isNotNull() | (f["at"] > F.col("at"))))
    answered = F.coalesce(F.when(F.col("at").isNotNull(), F.get(upto, F.size(upto) - 1)["live"]), F.lit(False))
    return x.select(*REF, *KEY, "at", answered.alias("answered"), F.when(~answered, F.get(after, F.lit(0))["at"]).alias("resolved_at"))


@dataclass
class OrphanState:
    """What has to be kept between batches: live rows of each key, deletions that are still to come, and the references
    that wait for a target."""

    live: DataFrame
    due: DataFrame
    waiting: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> "OrphanState":
        return OrphanState(
            spark.createDataFrame([], "space string, target_document string, target_key string, live long"),
            spark.createDataFrame([], "space string, target_document string, target_key string, at timestamp"),
            spark.createDataFrame([], REF_SCHEMA),
        )


@dataclass
class OrphanBatch:
    """What a batch changed: orphans among its new references, waiting references that a target arrived for, and
    references whose last live target was deleted."""

    found: DataFrame
    resolved: DataFrame
    reopened: DataFrame


def advance(state: OrphanState, answered: DataFrame, refs: DataFrame, arrivals: DataFrame, upto: str) -> tuple[OrphanState, OrphanBatch]:
    """One batch of the incremental operator: new references and parent rows that arrived since the last batch, all
    before ``upto``.

    New references probe the index, arriving parents resolve waiting orphans, deletions (also of parents of earlier
    batches, kept in the state until they fall due) reopen references. ``answered`` are the references of earlier
    batches that had a live target after the last one (as the caller keeps them); only keys that changed are looked up.
    """
    end = F.lit(upto).cast("timestamp")
    changes = _deltas(arrivals)
    later = changes.where((F.col("delta") < 0) & (F.col("at") >= end)).select(*KEY, "at")
    now = changes.where(F.col("at") < end).unionByName(state.due.where(F.col("at") < end).select(*KEY, "at", F.lit(-1).alias("delta")))
    known = cut(flips(now, state.live))
    found = probed(refs, known).where("not answered").select(*REF, *KEY, "at", "resolved_at")
    live = known.where("live > 0").select(*KEY, "live")
    key = list(KEY)
    columns = state.waiting.columns
    ended = state.live.select(*KEY).join(known.where("live <= 0").select(*KEY), key, "left_semi")
    resolved = state.waiting.join(live, key, "left_semi").select(*columns)
    reopened = answered.join(ended, key, "left_semi").select(*columns)
    waiting = state.waiting.unionByName(refs.select(*columns)).unionByName(reopened).join(live, key, "left_anti").select(*columns)
    due = state.due.where(F.col("at") >= end).unionByName(later)
    return OrphanState(live, due, waiting), OrphanBatch(found, resolved, reopened)


def bounds(refs: DataFrame, arrivals: DataFrame, months: int) -> list[str]:
    """Ends of the periods of so many months that the times of references and arrivals fall into."""
    both = refs.select("at").unionByName(arrivals.select(F.col("loaded_at").alias("at")))
    first, last = both.agg(F.date_trunc("month", F.min("at")), F.date_trunc("month", F.max("at"))).head()
    out: list[str] = []
    if first is not None:
        at, end = first.year * 12 + first.month - 1, last.year * 12 + last.month - 1
        while at <= end:
            at += months
            out.append(f"{at // 12:04d}-{at % 12 + 1:02d}-01 00:00:00")
    return out


def fold(refs: DataFrame, arrivals: DataFrame, months: int = 12) -> Iterator[tuple[str, OrphanState, OrphanBatch]]:
    """``advance`` over the periods of a history: (end of the period, state after it, what the batch changed).

    References without a time belong to the first batch. The state that the next batch reads is written at each
    snapshot, so that a lost executor costs no more than one batch.
    """
    spark = refs.sparkSession
    refs, arrivals = cut(refs), cut(arrivals.where("loaded_at is not null"))
    state, kept, start = OrphanState.empty(spark), refs.where("false"), None
    for end in bounds(refs, arrivals, months) or ["9999-01-01 00:00:00"]:
        inside = lambda c, start=start, end=end: f"{c} < '{end}'" + (f" and {c} >= '{start}'" if start else "")
        new = refs.where(inside("at") + ("" if start else " or at is null"))
        state, batch = advance(state, kept, new, arrivals.where(inside("loaded_at")), end)
        yield end, state, batch
        kept, start = kept.unionByName(new).unionByName(batch.resolved).join(state.live.select(*KEY), list(KEY), "left_semi").select(*refs.columns), end


def orphans(refs: DataFrame, parent_rows: DataFrame) -> DataFrame:
    """References that no live parent row answered when they came (REF, at, resolved_at), in one batch over everything."""
    return probed(refs, flips(_deltas(parent_rows))).where("not answered").select(*REF, "at", "resolved_at")


def pending(refs: DataFrame, parent_rows: DataFrame, period: str = "month") -> DataFrame:
    """(ref_table, period, n_pending): references that wait for a target at the end of each period that brought any.

    For each key and referring table, the number waiting changes only in periods with new references or flips; the
    changes are added up over all keys, then over time. References without a time are in no period.
    """
    part = lambda c: F.date_trunc(period, c)
    new = refs.where("at is not null").groupBy(*KEY, "ref_table", part("at").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    per = new.groupBy(*KEY, "ref_table").agg(F.collect_list(F.struct("period", "n")).alias("news"))
    x = per.join(flips(_deltas(parent_rows)).select(*KEY, "flips"), list(KEY), "left").withColumn("flips", F.coalesce("flips", F.array().cast("array<struct<at: timestamp, live: boolean>>")))
    periods = F.array_sort(F.array_distinct(F.concat(F.transform("news", lambda v: v["period"]), F.transform("flips", lambda f: part(f["at"])))))
    upto = lambda m: F.filter("flips", lambda f: part(f["at"]) <= m)
    answered = lambda m: F.coalesce(F.get(upto(m), F.size(upto(m)) - 1)["live"], F.lit(False))
    arrived = lambda m: F.aggregate(F.filter("news", lambda v: v["period"] <= m), F.lit(0).cast("long"), lambda s, v: s + v["n"])
    waiting = F.transform(periods, lambda m: F.struct(m.alias("period"), F.when(answered(m), F.lit(0).cast("long")).otherwise(arrived(m)).alias("n")))
    steps = x.select("ref_table", waiting.alias("w")).select("ref_table", F.posexplode("w").alias("i", "v"), "w")
    change = F.col("v.n") - F.coalesce(F.get("w", F.col("i") - 1)["n"], F.lit(0))
    by = steps.select("ref_table", F.col("v.period").alias("period"), change.alias("n")).groupBy("ref_table", "period").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("ref_table").orderBy("period").rowsBetween(Window.unboundedPreceding, 0))  # one row a period
    told = refs.where("at is not null").select("ref_table", part("at").alias("period")).distinct()
    return by.select("ref_table", "period", total.alias("n_pending")).join(told, ["ref_table", "period"], "left_semi")


def orphan_counts(found: DataFrame, period: str = "month") -> DataFrame:
    """Orphans per referring table and period of arrival, and how many of them a later parent answered."""
    return found.groupBy("ref_table", F.date_trunc(period, "at").alias("period")).agg(F.count(F.lit(1)).alias("n_orphans"), F.count("resolved_at").alias("n_resolved"))
