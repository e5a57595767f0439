"""Joins and merges by position: containment, overlap and nearest neighbours without comparing everything with everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tiles(low: Column, high: Column, size: int) -> Column:
    """Grid cells that a stretch touches."""
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def points_in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], size: int = 64) -> DataFrame:
    """Pairs of a point (x, y) strictly inside a box (bx0, by0, bx1, by1), joined on keys and the tile of the page.

    A box is repeated for each tile it touches, so a tile's rows stay near its share of the page.
    """
    left = points.withColumns({"_tile": F.floor(F.col("x") / size), "_row": F.floor(F.col("y") / size)})
    right = boxes.withColumn("_tile", tiles(F.col("bx0"), F.col("bx1"), size)).withColumn("_row", tiles(F.col("by0"), F.col("by1"), size))
    inside = (F.col("x") > F.col("bx0")) & (F.col("x") < F.col("bx1")) & (F.col("y") > F.col("by0")) & (F.col("y") < F.col("by1"))
    return left.join(right, [*keys, "_tile", "_row"]).where(inside).drop("_tile", "_row")


def merged_stretches(df: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Overlapping or touching stretches of each key joined: a running maximum of the ends so far tells where one begins."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    before = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(before.isNull() | (F.col(low) > before), 1).otherwise(0))
    part = marked.withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy(*keys, "_part").agg(F.min(low).alias(low), F.max(high).alias(high), F.count("*").alias("n")).drop("_part")


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column) -> DataFrame:
    """Number of the run that each row belongs to; `breaks` tells whether a row starts a new one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("run", F.sum(F.when(breaks, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
