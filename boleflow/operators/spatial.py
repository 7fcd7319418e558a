"""Joins on distance, by a grid: an equi-join on cells instead of a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    return F.floor(x / F.lit(size)).cast("long"), F.floor(y / F.lit(size)).cast("long")


def around(x: Column, y: Column, size: float) -> Column:
    """The nine cells at and around a point."""
    cx, cy = cells(x, y, size)
    steps = F.sequence(F.lit(-1), F.lit(1))
    return F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.struct((cx + i).alias("cx"), (cy + j).alias("cy")))))


def reached(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """All cells that a box meets."""
    (a, b), (c, d) = cells(x0, y0, size), cells(x1, y1, size)
    return F.flatten(F.transform(F.sequence(a, c), lambda i: F.transform(F.sequence(b, d), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def overlapping(boxes: DataFrame, key: str, size: float, buffer: float) -> DataFrame:
    """(a, b), a < b: keys of boxes (x0, y0, x1, y1) that come within buffer of one another on both axes.

    Boxes meet in the cells that they reach; a pair is told in the least cell that both reach.
    """
    e = F.lit(buffer)
    wide = boxes.select(key, (F.col("x0") - e).alias("x0"), (F.col("y0") - e).alias("y0"), F.col("x1").alias("x1"), F.col("y1").alias("y1"))
    sent = wide.select("*", F.explode(reached(F.col("x0"), F.col("y0"), F.col("x1") + e, F.col("y1") + e, size)).alias("at")).select("*", "at.cx", "at.cy").drop("at")
    a, b = sent.alias("p"), sent.alias("q")
    meets = (F.col("p.x1") >= F.col("q.x0")) & (F.col("q.x1") >= F.col("p.x0")) & (F.col("p.y1") >= F.col("q.y0")) & (F.col("q.y1") >= F.col("p.y0"))
    fx, fy = cells(F.greatest("p.x0", "q.x0"), F.greatest("p.y0", "q.y0"), size)
    told = (F.col("p.cx") == fx) & (F.col("p.cy") == fy)
    pairs = a.join(b, (F.col("p.cx") == F.col("q.cx")) & (F.col("p.cy") == F.col("q.cy")) & (F.col(f"p.{key}") < F.col(f"q.{key}")) & meets & told)
    return pairs.select(F.col(f"p.{key}").alias("a"), F.col(f"q.{key}").alias("b"))


def near(a: DataFrame, b: DataFrame, ax: str, ay: str, bx: str, by: str, distance: float) -> DataFrame:
    """Pairs closer than distance. Each pair is found once: only a is sent to nine cells.

    Cells bound what a task gets where points are spread; a crowded cell is split by
    adaptive execution like any other skewed join key.
    """
    left = a.withColumn("__cell", F.explode(around(F.col(ax), F.col(ay), distance))).select("*", "__cell.cx", "__cell.cy").drop("__cell")
    bcx, bcy = cells(F.col(bx), F.col(by), distance)
    right = b.withColumns({"cx": bcx, "cy": bcy})
    gap = F.hypot(F.col(ax) - F.col(bx), F.col(ay) - F.col(by))
    return left.join(right, ["cx", "cy"]).filter(gap < F.lit(distance)).drop("cx", "cy")
