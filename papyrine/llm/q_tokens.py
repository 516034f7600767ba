"""Queries of problems 8 and 9."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm import packing, tokenizer
from papyrine.sources.tables import table


def vocabulary(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Path of a vocabulary file; the folder is a parameter, else PAPYRINE_TOKENIZERS, else where the files are installed."""
    folder = folder or os.environ.get("PAPYRINE_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", vocabulary())


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokenizer.count_tokens(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", vocabulary())
    return packing.pack(sizes, "doc_id", "n_tokens")


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """Pieces and tokens by tier, and of all tiers together (tier null) with containers and unused share."""
    placed = p9_containers(spark, d).where("container is not null")
    n = F.count(F.lit(1)).alias("pieces")
    tiers = placed.groupBy("tier").agg(n, F.sum("n_tokens").alias("tokens")).select("tier", "pieces", "tokens", F.lit(None).cast("long").alias("containers"), F.lit(None).cast("double").alias("unused"))
    whole = placed.agg(n, F.sum("n_tokens").alias("tokens"), F.countDistinct("container").alias("containers"))
    unused = F.round(1 - F.col("tokens") / (F.col("containers") * packing.CAPACITY), 6).alias("unused")
    return tiers.unionByName(whole.select(F.lit(None).cast("int").alias("tier"), "pieces", "tokens", "containers", unused))


QUERIES = {"p8_ids": p8_ids, "p9_containers": p9_containers, "p9_fill": p9_fill}
SQL: dict[str, str] = {}
