"""Boxes as structs (x0, y0, x1, y1): areas, overlaps, distances, reading order. Native expressions; null boxes give null."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    """Area of a box, at least one."""
    return F.greatest(F.lit(1.0), F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"]))


def shared(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])) * F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))


def iou(a: Column, b: Column) -> Column:
    return shared(a, b) / (area(a) + area(b) - shared(a, b))


def overlap(a: Column, b: Column) -> Column:
    """Shared area by the smaller of the two."""
    return shared(a, b) / F.least(area(a), area(b))


def distance(a: Column, b: Column) -> Column:
    """Distance of the centres, both ways added; very large without boxes."""
    return F.coalesce(F.abs((a["x0"] + a["x1"]) - (b["x0"] + b["x1"])) / 2 + F.abs((a["y0"] + a["y1"]) - (b["y0"] + b["y1"])) / 2, F.lit(1e7))


def scaled(b: Column, dpi: Column) -> Column:
    k = 72.0 / dpi
    return F.struct(*[(b[c] * k).alias(c) for c in ("x0", "y0", "x1", "y1")])


def reading_order(df: DataFrame, width: float = 1200.0) -> DataFrame:
    """Position of each block: by page, column, y, x and id; column 1 if it starts right of 45 % and centres right of half."""
    column = F.when((F.col("bbox.x0") > 0.45 * width) & ((F.col("bbox.x0") + F.col("bbox.x1")) / 2 > 0.5 * width), 1).otherwise(0)
    w = Window.partitionBy("document_id").orderBy("page_number", column, F.coalesce("bbox.y0", F.lit(1e7)), F.coalesce("bbox.x0", F.lit(1e7)), "block_id")
    return df.withColumn("position", F.row_number().over(w))


def greedy_regions(df: DataFrame, schema: str) -> DataFrame:
    """First-come merging of boxes of a page: a box joins the first region it overlaps by 45 % or by an IoU of 0.18.

    Regions grow as boxes join, so the order matters and a page is worked through at once; pages are small.
    """

    def page(p: pd.DataFrame) -> pd.DataFrame:
        regions: list[list[float]] = []
        out = []
        for x0, y0, x1, y1 in p[["x0", "y0", "x1", "y1"]].itertuples(index=False):
            own = max(1.0, (x1 - x0) * (y1 - y0))
            hit = -1
            for k, (a0, b0, a1, b1) in enumerate(regions):
                inter = max(0.0, min(x1, a1) - max(x0, a0)) * max(0.0, min(y1, b1) - max(y0, b0))
                other = max(1.0, (a1 - a0) * (b1 - b0))
                if inter / min(own, other) >= 0.45 or inter / (own + other - inter) >= 0.18:
                    hit = k
                    break
            if hit < 0:
                regions.append([x0, y0, x1, y1])
                hit = len(regions) - 1
            else:
                r = regions[hit]
                regions[hit] = [min(r[0], x0), min(r[1], y0), max(r[2], x1), max(r[3], y1)]
            out.append(hit + 1)
        return p.assign(region=out)[["document_id", "page_number", "block_id", "region"]]

    ordered = lambda p: page(p.sort_values(["y0", "x0", "block_id"]))
    flat = df.where("bbox is not null").select("document_id", "page_number", "block_id", *[F.col(f"bbox.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    return flat.groupBy("document_id", "page_number").applyInPandas(ordered, schema)
