"""Structured Streaming: progress of documents in batches, and references that wait for their targets."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, at: str, key: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and key; rows later than ``late`` are left out."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def latest_status(events: DataFrame, key: str, at: str, status: str) -> DataFrame:
    """Latest status of each key by event time (update mode)."""
    return events.groupBy(key).agg(F.max_by(status, at).alias("status"), F.max(at).alias("seen"), F.count(F.lit(1)).alias("n"))


def batch_roll_up(latest: DataFrame) -> DataFrame:
    """Status of each batch from the latest statuses of its documents (batch_id, document_id, status, progress)."""
    bad, n = F.count_if(F.col("status") == "error"), F.count(F.lit(1))
    done = F.count_if(F.col("status").isin("ok", "error", "partial"))
    return latest.groupBy("batch_id").agg(n.alias("documents"), F.round(F.avg("progress"), 4).alias("progress"), F.when(done < n, "running").when(bad == n, "error").when(bad > 0, "partial").otherwise("ok").alias("status"))


_OUT = "target_document string, target_key string, ref_table string, document_id string, record_id string, ref_key string, event string, at timestamp"
_STATE = "live long, waiting array<string>"


def waiting_references(events: DataFrame, buckets: int = 8) -> DataFrame:
    """Changes of references over a stream of events (target_document, target_key, kind, at, ref_table, document_id,
    record_id, ref_key) with kind ``arrive``, ``delete`` or ``probe``: ``orphan`` when a reference finds no live target,
    ``resolved`` when a target arrives for a waiting one, ``reopened`` when the last live target is deleted.

    State is kept per target key and bucket of references: live targets and the references of the bucket. A key to which
    most references point is split over ``buckets`` states; its arrivals and deletions go to each of them.
    """

    def step(group: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        key = group[:2]
        live, known = state.get if state.exists else (0, [])
        refs = dict.fromkeys(known)
        order = {"arrive": 0, "delete": 1, "probe": 2}
        rows = pd.concat(list(batches))
        rows = rows.assign(o=rows["kind"].map(order)).sort_values(["at", "o"])
        out = []

        def tell(ref: str, event: str, at: Any) -> None:
            out.append((*key, *ref.split("\x01"), event, at))

        for r in rows.itertuples():
            if r.kind == "arrive":
                live += 1
                if live == 1:
                    for x in refs:
                        tell(x, "resolved", r.at)
            elif r.kind == "delete":
                live = max(0, live - 1)
                if live == 0:
                    for x in refs:
                        tell(x, "reopened", r.at)
            else:
                ref = "\x01".join(str(x) for x in (r.ref_table, r.document_id, r.record_id, r.ref_key))
                if ref not in refs:
                    refs[ref] = None
                    if live == 0:
                        tell(ref, "orphan", r.at)
        state.update((live, list(refs)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    own = F.array(F.pmod(F.xxhash64("ref_table", "document_id", "record_id", "ref_key"), F.lit(buckets)))
    split = events.withColumn("bucket", F.explode(F.when(F.col("kind") == "probe", own).otherwise(F.array(*[F.lit(i).cast("long") for i in range(buckets)]))))
    return split.groupBy("target_document", "target_key", "bucket").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
