"""Search for variables, formulas and texts, with the query as a parameter.

Inputs are link tables of formulas and their normalised symbols (document_id, formula_id, section_id, ord, symbol), texts
and definitions. A query is normalised like the symbols are; one that can be no variable gives an empty result.

Defined results: null texts and symbols match nothing; empty tables give empty results; further columns are ignored; a
formula that holds a symbol twice is one match; ties are decided by id.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.functions import latex, notation

#: Confidence of a match: a formula with its context, without one, a mention in a text, a text that only holds the query.
WITH_CONTEXT, WITHOUT_CONTEXT, MENTION, FALLBACK = 0.9, 0.78, 0.62, 0.55
#: Suggestions and conflicts that are reported at most; fixed values.
MOST_SUGGESTIONS, MOST_CONFLICTS = 12, 5


def normalized(spark: SparkSession, query: str) -> str | None:
    """The query as symbols are spelled, None if it can be no variable."""
    row = spark.range(1).select(latex.symbol(F.lit(query)).alias("s")).select("s", latex.is_variable(F.col("s")).alias("ok")).head()
    return row.s if row.s is not None and row.ok else None


def mentioned(text: Column, symbol: str) -> Column:
    """Whether a text mentions a symbol: a command anywhere, anything else as a word of its own."""
    if symbol.startswith("\\"):
        return F.contains(text, F.lit(symbol))
    return text.rlike(rf"(^|[^A-Za-z0-9_\\]){re.escape(symbol)}($|[^A-Za-z0-9_])")


def variable(links: DataFrame, formulas: DataFrame, contexts: DataFrame, blocks: DataFrame, query: str) -> DataFrame:
    """(document_id, kind, formula_id, block_id, section_id, near, confidence): every match of a variable, document by document.

    kind is ``formula`` for a formula with the symbol, ``text_mention`` for a block that mentions it in a document that has
    such formulas, and ``fallback`` for a formula whose LaTeX just holds the query in a document that has none. contexts
    have formula_id and near, blocks block_id, section_id and text.
    """
    spark = links.sparkSession
    symbol = normalized(spark, query)
    none = spark.createDataFrame([], "document_id string, kind string, formula_id string, block_id string, section_id string, near string, confidence double")
    if symbol is None:
        return none
    null = F.lit(None).cast("string")
    near = contexts.select("document_id", "formula_id", "near", F.lit(True).alias("c"))
    hits = links.where(F.col("symbol") == symbol).select("document_id", "formula_id", "section_id").distinct()
    own = hits.join(near, ["document_id", "formula_id"], "left").select("document_id", F.lit("formula").alias("kind"), "formula_id", null.alias("block_id"), "section_id", "near", F.when(F.col("c"), WITH_CONTEXT).otherwise(WITHOUT_CONTEXT).alias("confidence"))
    having = hits.select("document_id").distinct()
    said = blocks.where(mentioned(F.col("text"), symbol)).join(having, "document_id", "left_semi")
    # A text that is the context of a match already is no further one.
    seen = own.where("near is not null").select("document_id", F.col("near").alias("text")).distinct()
    said = said.join(seen, ["document_id", "text"], "left_anti")
    mention = said.select("document_id", F.lit("text_mention").alias("kind"), null.alias("formula_id"), "block_id", "section_id", F.col("text").alias("near"), F.lit(MENTION).alias("confidence"))
    holds = F.contains("latex", F.lit(query)) | F.contains("latex", F.lit(symbol))
    other = formulas.where(holds).join(having, "document_id", "left_anti").join(near.drop("c"), ["document_id", "formula_id"], "left")
    fallback = other.select("document_id", F.lit("fallback").alias("kind"), "formula_id", null.alias("block_id"), "section_id", "near", F.lit(FALLBACK).alias("confidence"))
    return own.unionByName(mention).unionByName(fallback)


def corpus_variable(matches: DataFrame, definitions: DataFrame, query: str) -> DataFrame:
    """(document_id, n_matches, n_formulas, n_sections, n_definitions, level, confidence) of each document with a match.

    level is where the variable is at home: its section if there is one, the document otherwise.
    """
    symbol = normalized(matches.sparkSession, query) or ""
    d = definitions.where(F.col("symbol") == symbol).groupBy("document_id").agg(F.countDistinct(F.lower("definition")).alias("n_definitions"))
    m = matches.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_matches"), F.countDistinct("formula_id").alias("n_formulas"), F.countDistinct(F.when(F.col("formula_id").isNotNull(), F.col("section_id"))).alias("n_sections"), F.max("confidence").alias("confidence"))
    return m.join(d, "document_id", "left").select("document_id", "n_matches", "n_formulas", "n_sections", F.coalesce("n_definitions", F.lit(0)).alias("n_definitions"), F.when(F.col("n_sections") == 1, "section").otherwise("document").alias("level"), "confidence")


def conflicts(definitions: DataFrame, query: str) -> DataFrame:
    """(document_a, meaning_a, document_b, meaning_b): the first meaning of a variable in a corpus against the next ones.

    Meanings are in the order of the first document that has them; ``MOST_CONFLICTS`` are reported, as a top-k.
    """
    symbol = normalized(definitions.sparkSession, query) or ""
    by = definitions.where(F.col("symbol") == symbol).groupBy(F.lower(F.trim("definition")).alias("meaning")).agg(F.min("document_id").alias("document")).where("meaning <> ''")
    top = by.orderBy("document", "meaning").limit(MOST_CONFLICTS + 1)
    first = top.withColumn("f", F.first(F.struct("document", "meaning")).over(Window.orderBy("document", "meaning")))  # six rows at most
    return first.where("meaning <> f.meaning").select(F.col("f.document").alias("document_a"), F.col("f.meaning").alias("meaning_a"), F.col("document").alias("document_b"), F.col("meaning").alias("meaning_b"))


def suggestions(symbols: DataFrame, query: str) -> DataFrame:
    """(symbol, score) of the variables that a query may mean: top-k by containment, first letter and length."""
    wanted = (normalized(symbols.sparkSession, query) or query.strip()).lstrip("\\").lower()
    value = F.lower(F.regexp_replace("symbol", r"^\\+", ""))
    score = F.when(F.contains(value, F.lit(wanted)) if wanted else F.lit(False), 10.0).otherwise(0.0) + F.when(F.startswith(value, F.lit(wanted[:1])), 2.0).otherwise(0.0) - 0.1 * F.abs(F.length(value) - len(wanted))
    return symbols.select("symbol").distinct().select("symbol", F.round(score, 4).alias("score")).where("score > 0").orderBy(F.desc("score"), F.desc("symbol")).limit(MOST_SUGGESTIONS)


def substring(formulas: DataFrame, query: str) -> DataFrame:
    """(document_id, formula_id, confidence) of the formulas whose LaTeX holds the query."""
    return formulas.where(F.contains("latex", F.lit(query))).select("document_id", "formula_id", F.lit(FALLBACK).alias("confidence"))


def formula_aliases(formulas: DataFrame) -> DataFrame:
    """(document_id, formula_id, alias) of every spelling by which a formula can be asked for, lower case."""
    numbers = F.array(F.regexp_extract(F.lower(F.coalesce("token", F.lit(""))), r"formula_(\d+)", 1), F.regexp_extract("formula_id", r"(\d{1,4})$", 1))
    spelled = F.flatten(F.transform(F.filter(numbers, lambda n: n != ""), lambda n: F.array(F.concat(F.lit("f"), n.cast("int").cast("string")), F.concat(F.lit("f"), F.lpad(n.cast("int").cast("string"), 3, "0")), F.concat(F.lit("formula_"), n.cast("int").cast("string")), F.concat(F.lit("formula_"), F.lpad(n.cast("int").cast("string"), 3, "0")), n.cast("int").cast("string"))))
    every = F.concat(F.array(F.lower("formula_id"), F.lower(F.coalesce("token", F.lit("")))), spelled)
    return formulas.select("document_id", "formula_id", F.explode(F.array_distinct(F.filter(every, lambda a: a != ""))).alias("alias"))


def formula(formulas: DataFrame, query: str) -> DataFrame:
    """The formula of each document that a query names, by id, token or number; the smallest id if several have the name."""
    named = formula_aliases(formulas).where(F.col("alias") == query.strip().lower()).groupBy("document_id").agg(F.min("formula_id").alias("formula_id"))
    return formulas.join(named, ["document_id", "formula_id"], "left_semi")


def text(blocks: DataFrame, query: str) -> DataFrame:
    """(document_id, block_id) of the blocks whose text holds the query, whatever the case."""
    return blocks.where(F.contains(F.lower("text"), F.lit(query.lower()))).select("document_id", "block_id")


def index_rows(links: DataFrame, contexts: DataFrame, definitions: DataFrame) -> DataFrame:
    """(document_id, symbol, formulas, contexts, definitions, related) of each variable, as lists joined by bars.

    Variables that are only defined have a row as well.
    """
    key = ["document_id", "symbol"]
    null = F.lit(None).cast("string")
    c = contexts.select("document_id", "formula_id", F.concat(F.lit("ctx:"), "formula_id").alias("context_id"))
    a = links.join(c, ["document_id", "formula_id"], "left").select(*key, "formula_id", "context_id", null.alias("definition"))
    b = definitions.select(*key, null.alias("formula_id"), F.concat(F.lit("ctx:"), "formula_id").alias("context_id"), "definition")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")  # noqa: E731  what one variable of one paper has
    rows = a.unionByName(b).groupBy(*key).agg(listed("formula_id").alias("formulas"), listed("context_id").alias("contexts"), listed("definition").alias("definitions"))
    return rows.join(related(links).groupBy(*key).agg(listed("related").alias("related")), key, "left").select(*key, "formulas", "contexts", "definitions", F.coalesce("related", F.lit("")).alias("related"))


def related(links: DataFrame) -> DataFrame:
    """(document_id, symbol, related, n): variables of the same formulas; a formula has few symbols."""
    a = links.select("document_id", "formula_id", "symbol").distinct()
    return a.join(a.withColumnRenamed("symbol", "related"), ["document_id", "formula_id"]).where("symbol <> related").groupBy("document_id", "symbol", "related").agg(F.count(F.lit(1)).alias("n"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """(document_id, id, hop): nodes within so many steps of the seeds (document_id, id), edges taken both ways; the seeds have hop 0."""
    e = edges.where("source_id is not null and target_id is not null")
    both = e.select("document_id", F.col("source_id").alias("a"), F.col("target_id").alias("b")).union(e.select("document_id", "target_id", "source_id")).distinct()
    every = seeds.select("document_id", "id").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        step = every.where(F.col("hop") == hop - 1).select("document_id", F.col("id").alias("a")).join(both, ["document_id", "a"]).select("document_id", F.col("b").alias("id")).distinct()
        every = every.unionByName(step.join(every, ["document_id", "id"], "left_anti").withColumn("hop", F.lit(hop)))
    return every


def modes(spark: SparkSession) -> DataFrame:
    """(alias, mode): every older name of a display mode with the mode it stands for at the end."""
    last = {}
    for alias in notation.MODES:
        mode = alias
        while mode in notation.MODES:
            mode = notation.MODES[mode]
        last[alias] = mode
    return spark.createDataFrame(sorted(last.items()), "alias string, mode string")
