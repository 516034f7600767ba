"""Writers: partitioned tables, JSON documents, corpus bundles, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_table(df: DataFrame, folder: str, by: list[str] | None = None) -> None:
    """Parquet, partitioned; only the partitions that df has are replaced."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*by) if by else w).parquet(folder)


def save_json(df: DataFrame, folder: str) -> None:
    """One JSON object a row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(folder)


def save_corpus(tables: dict[str, DataFrame], folder: str, corpus_id: str) -> None:
    """The tables of a corpus side by side below its id."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/corpus_id={corpus_id}/{name}")


def retained(files: DataFrame, key: str, at: str, newest: int, oldest: str, keep: str | None = None) -> DataFrame:
    """(key, seen, expired): expired if not among the newest keys or too old, never the current one."""
    seen = files.groupBy(key).agg(F.max(at).alias("seen"))
    top = seen.orderBy(F.desc("seen"), key).limit(newest).select(key, F.lit(False).alias("old"))  # bounded by `newest`
    out = seen.join(F.broadcast(top), key, "left").select(key, "seen", (F.coalesce("old", F.lit(True)) | (F.col("seen") < F.lit(oldest).cast("timestamp"))).alias("expired"))
    return out.withColumn("expired", F.col("expired") & (F.col(key) != keep)) if keep else out


#: Tables that one processing run writes, by name; fixed values.
BUNDLE = ("result", "structured", "graph_ready", "graph_input", "metagraph", "variable_index", "metagraph_validation", "formulas", "formula_interpretations", "rich_metagraph", "metagraph_metrics", "visualization")


def save_bundle(tables: dict[str, DataFrame], folder: str, by: list[str] | None = None) -> list[str]:
    """The tables of a run, each as Parquet by document and as JSON lines; the names that were written.

    A run that is repeated replaces the documents it has and leaves the others; names outside the bundle are an error.
    """
    unknown = set(tables) - set(BUNDLE)
    if unknown:
        raise ValueError(f"no part of a bundle: {sorted(unknown)}")
    for name in (n for n in BUNDLE if n in tables):
        save_table(tables[name], f"{folder}/{name}", by or ["document_id"])
        save_json(tables[name], f"{folder}/json/{name}")
    return [n for n in BUNDLE if n in tables]
