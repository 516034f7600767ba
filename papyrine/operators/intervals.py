"""Intervals on a line: merging, overlap joins, nearest earlier row. Native windows and equi-joins on bins.

Defined results: intervals with a null or reversed bound are left out; touching intervals are merged; empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """(by, start, end, n): overlapping or touching intervals of a group as one, and how many it holds.

    A row opens a new island if it starts after everything before it has ended.
    """
    rows = df.select(*by, F.col(start).alias("a"), F.col(end).alias("b")).where("a is not null and b is not null and a <= b")
    w = Window.partitionBy(*by).orderBy("a", "b")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(before.isNull() | (F.col("a") > before), 1).otherwise(0)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "island").agg(F.min("a").alias("start"), F.max("b").alias("end"), F.count(F.lit(1)).alias("n")).drop("island")


def overlapping(left: DataFrame, right: DataFrame, by: list[str], start: str, end: str, width: float, left_id: str, right_id: str) -> DataFrame:
    """(by, left_id, right_id) of overlapping intervals: both sides are put into bins of ``width``, and a pair is kept in the
    bin where the later of the two begins, so each pair comes once."""
    bins = lambda df, i, p: df.where(f"{start} <= {end}").select(*by, F.col(i).alias(f"{p}_id"), F.col(start).alias(f"{p}_a"), F.col(end).alias(f"{p}_b"), F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))).alias("bin"))
    j = bins(left, left_id, "l").join(bins(right, right_id, "r"), [*by, "bin"])
    return j.where("l_a <= r_b and r_a <= l_b").where(F.col("bin") == F.floor(F.greatest("l_a", "r_a") / width)).select(*by, F.col("l_id").alias(left_id), F.col("r_id").alias(right_id))


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """left with the ``value`` of the last row of right at or before it (null if there is none): one union and a running
    last value, no join."""
    a = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*by, at, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    w = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").drop("_side", "_v")


def boxed_range(start: Column, end: Column, length: Column, x0: Column, x1: Column) -> Column:
    """Part of a line's box that a range of its characters takes up, in proportion."""
    k = (x1 - x0) / F.greatest(F.lit(1), length)
    return F.struct((x0 + start * k).alias("x0"), (x0 + end * k).alias("x1"))
