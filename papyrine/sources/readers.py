"""Readers for what papers arrive as: parsed blocks, TeX trees, JSON documents, TSV of word boxes, text lines.

All are Spark readers or Arrow functions over files, so a folder of any size is read in parallel; nothing is listed or
read on the driver. Decoding of PDF pages and images is a plug: ``decoded`` takes any function of one file's bytes.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: File suffixes of images; fixed values.
IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")


def binary(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length, content of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)


def decoded(files: DataFrame, decode: Callable[[str, bytes], list[dict]], schema: str) -> DataFrame:
    """Rows that a decoder makes of each file; files without rows vanish, a decoder's error fails the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in re.split(r",\s*(?![^<]*>)", schema)]
        for b in batches:
            rows = [r for path, content in zip(b["path"], b["content"], strict=True) for r in decode(path, bytes(content))]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def text_of(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def tex_files(spark: SparkSession, folder: str) -> DataFrame:
    """paper, path, content of the TeX files of a folder of papers: one folder a paper, with any folders inside.

    path is relative to the paper's folder, so that files of one name in several folders stay apart.
    """
    files = binary(spark, folder, "*.tex")
    root = re.escape(re.sub(r"^[a-z]+:/*", "/", folder).rstrip("/"))
    inside = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^{root}/", "")
    return files.select(F.regexp_extract(inside, "^([^/]*)/", 1).alias("paper"), F.regexp_replace(inside, "^[^/]*/", "").alias("path"), text_of(F.col("content")).alias("content"), "length")


def main_tex(files: DataFrame) -> DataFrame:
    """The main file of each paper: class and document begin count three each, size up to three more."""
    score = F.when(F.contains("content", F.lit("\\documentclass")), 3.0).otherwise(0.0) + F.when(F.contains("content", F.lit("\\begin{document}")), 3.0).otherwise(0.0) + F.least(F.lit(3.0), F.col("length") / 100000)
    w = Window.partitionBy("paper").orderBy(F.desc(score), "path")
    return files.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


_INCLUDE = re.compile(r"\\(?:input|include)\{([^}]+)\}")


def expanded_tex(files: DataFrame) -> DataFrame:
    """paper, content with \\input and \\include replaced by the files they name; missing ones and circles become empty.

    A name is looked up below the paper's folder, then below that of the file that names it, then by its last part if only
    one file has it. The files of one paper are put together in one task; a paper's source is small.
    """

    def paper(p: pd.DataFrame) -> pd.DataFrame:
        by = {re.sub(r"\.tex$", "", path): text for path, text in zip(p["path"], p["content"], strict=True)}
        last: dict[str, list[str]] = {}
        for k in by:
            last.setdefault(k.rsplit("/", 1)[-1], []).append(k)
        size = lambda k: (3 * ("\\documentclass" in by[k]) + 3 * ("\\begin{document}" in by[k]) + min(3, len(by[k]) / 1e5), k)
        main = max(sorted(by), key=size)

        def found(name: str, at: str) -> str | None:
            name = re.sub(r"\.tex$", "", name.strip())
            here = posixpath.normpath(posixpath.join(posixpath.dirname(at), name))
            same = last.get(name.rsplit("/", 1)[-1], [])
            return next((k for k in (posixpath.normpath(name), here) if k in by), same[0] if len(same) == 1 else None)

        def open_(at: str, seen: frozenset[str]) -> str:
            def inner(m: re.Match) -> str:
                k = found(m.group(1), at)
                return "" if k is None or k in seen else open_(k, seen | {k})

            return _INCLUDE.sub(inner, by[at])

        return pd.DataFrame({"paper": [p["paper"].iloc[0]], "content": [open_(main, frozenset((main,)))]})

    return files.groupBy("paper").applyInPandas(paper, "paper string, content string")


def word_boxes(lines: DataFrame) -> DataFrame:
    """Lines of text from rows of word boxes (document_id, block, par, line, left, top, width, height, conf, text).

    Words of negative confidence are left out; words are put in the order of their left edge.
    """
    kept = lines.where("conf >= 0 and trim(text) <> ''")
    words = F.array_sort(F.collect_list(F.struct("left", "text")))
    return kept.groupBy("document_id", "block", "par", "line").agg(
        F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("text"), F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1"), F.round(F.avg("conf") / 100, 4).alias("confidence")
    )


def text_lines(df: DataFrame, key: str, text: str, width: float = 595.0, height: float = 842.0) -> DataFrame:
    """One row a filled line with a box of equal height over the page, 10 points at least."""
    n = F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
    rows = df.select(key, n.alias("n"), F.posexplode(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")).alias("line", "text"))
    step = F.greatest(F.lit(10.0), F.lit(height) / F.col("n"))
    return rows.select(key, "line", F.trim("text").alias("text"), F.lit(0.0).alias("x0"), (F.col("line") * step).alias("y0"), F.lit(width).alias("x1"), ((F.col("line") + 1) * step).alias("y1"), F.lit(0.62).alias("confidence"))


def json_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON documents, one a file, with a schema (no inference over the folder); the file's name is kept."""
    return spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(folder).withColumn("file", F.col("_metadata.file_name"))


def upgraded(documents: DataFrame, version: str = "1.1") -> DataFrame:
    """Documents of an older schema brought up to date: blank strings in arrays dropped, relations once, version set.

    documents have schema_version, and may have relations (an array of structs with type, source_id, target_id); ``upgraded``
    says whether anything changed.
    """
    changed = F.coalesce(F.col("schema_version") != version, F.lit(True))
    clean: dict[str, Column] = {}
    for f in documents.schema:
        if f.dataType.simpleString() == "array<string>":
            clean[f.name] = F.filter(f.name, lambda x: x.isNotNull() & (F.trim(x) != ""))
        elif f.name == "relations":
            clean[f.name] = F.array_distinct(F.filter(f.name, lambda r: r["source_id"].isNotNull() & r["target_id"].isNotNull()))
    for name, c in clean.items():
        changed = changed | F.coalesce(F.size(c) != F.size(name), F.lit(False))
    return documents.select(*[clean.get(c, F.col(c)).alias(c) for c in documents.columns if c != "schema_version"], F.when(changed, version).otherwise(F.col("schema_version")).alias("schema_version"), changed.alias("upgraded"))
