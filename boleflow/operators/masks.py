"""Masks and skeletons as relations of pixels (r, c), or as arrays of a tile.

Neighbourhoods are equi-joins with a table of offsets, never range joins: each pixel
sends itself to its eight neighbours' cells and rows meet by cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Clockwise ring from the north, as (row, column) steps.
RING = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def ring(pixels: DataFrame) -> DataFrame:
    """Every pixel with n0..n7: which of its ring are set.

    One aggregation: a pixel tells each ring cell on which side it lies. Cells that are
    no pixel themselves fall away.
    """
    told = [F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c"), F.lit((k + 4) % 8).alias("k")) for k, (dr, dc) in enumerate(RING)]
    own = F.struct(F.col("r").alias("r"), F.col("c").alias("c"), F.lit(8).alias("k"))
    sent = pixels.select(F.explode(F.array(*told, own)).alias("e")).select("e.*")
    met = sent.groupBy("r", "c").agg(*[F.max((F.col("k") == k).cast("int")).alias(f"n{k}") for k in range(9)])
    return met.filter("n8 = 1").drop("n8")


def degree(pixels: DataFrame) -> DataFrame:
    return ring(pixels).select("r", "c", sum((F.col(f"n{k}") for k in range(1, 8)), F.col("n0")).cast("long").alias("degree"))


def node_kinds(pixels: DataFrame) -> DataFrame:
    """Transitions from unset to set around the ring; 1: end, 3 or more: branch."""
    rises = sum((F.when((F.col(f"n{k}") == 0) & (F.col(f"n{(k + 1) % 8}") == 1), 1).otherwise(0) for k in range(8)), F.lit(0))
    d = ring(pixels).select("r", "c", rises.cast("long").alias("transitions"))
    return d.withColumn("kind", F.when(F.col("transitions") == 1, "end").when(F.col("transitions") >= 3, "branch"))


def dense(pixels: DataFrame) -> DataFrame:
    """Lower right pixels of 2x2 blocks that are all set."""
    return ring(pixels).filter("n0 = 1 AND n6 = 1 AND n7 = 1").select("r", "c")


def without_dense(pixels: DataFrame) -> DataFrame:
    return ring(pixels).filter("NOT (n0 = 1 AND n6 = 1 AND n7 = 1)").select("r", "c")


def without_branches(pixels: DataFrame) -> DataFrame:
    """One round: clears the 3x3 block around every branch pixel."""
    cells = [F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")) for dr, dc in [*RING, (0, 0)]]
    cleared = node_kinds(pixels).filter("kind = 'branch'").select(F.explode(F.array(*cells)).alias("e")).select("e.*").distinct()
    return pixels.join(cleared, ["r", "c"], "left_anti")


def binary_core(score: Column, width: int, crop: int, threshold: float, valid: Column | None = None) -> Column:
    """Scores of a square tile, cropped on each side and set against a threshold, row by row."""
    kept = [r * width + c for r in range(crop, width - crop) for c in range(crop, width - crop)]

    def bit(i: int) -> Column:
        on = F.get(score, F.lit(i)) >= F.lit(threshold)
        return F.when(on & F.get(valid, F.lit(i)) if valid is not None else on, 1).otherwise(0)

    return F.array(*[bit(i) for i in kept])


def valid_mask(file_mask: Column, bands: Column) -> Column:
    """Valid pixels of a tile from the file's mask and the pixels' bands (an array each).

    A mask that is set everywhere says nothing: any non-zero band then counts. Otherwise
    both must hold.
    """
    any_band = F.transform(bands, lambda b: F.exists(b, lambda v: v != 0))
    return F.when(F.forall(file_mask, lambda m: m), any_band).otherwise(F.zip_with(file_mask, any_band, lambda a, b: a & b))


def agreement(tiles: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """How far two masks (tile_id, r, c) agree on each of tiles (tile_id): pixels of either and
    of both, and intersection over union (1 where neither has a pixel)."""
    both = a.select("tile_id", "r", "c", F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select("tile_id", "r", "c", F.lit(0), F.lit(1)))
    met = both.groupBy("tile_id", "r", "c").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    n = met.groupBy("tile_id").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * F.col("b")).alias("n_both"))
    d = tiles.select("tile_id").join(n, "tile_id", "left").na.fill(0, ["n_a", "n_b", "n_both"])
    union = F.col("n_a") + F.col("n_b") - F.col("n_both")
    return d.withColumn("iou", F.when(union > 0, F.col("n_both") / union).otherwise(1.0))


def overall(agreed: DataFrame) -> DataFrame:
    """One row: pixels of either mask, their difference in percent of the second, and the worst tile."""
    n = agreed.agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.min("iou").alias("worst_iou"))
    return n.withColumn("percent", 100 * (F.col("n_a") - F.col("n_b")) / F.greatest(F.col("n_b"), F.lit(1)))


def with_foreground(tiles: DataFrame, score: str, threshold: float) -> DataFrame:
    """Tiles with any pixel at or over the threshold."""
    return tiles.filter(F.exists(score, lambda s: s >= F.lit(threshold)))


def to_float(pixel: Column) -> Column:
    """Bytes to the unit interval, in single precision."""
    return (pixel.cast("float") / F.lit(255.0).cast("float")).cast("float")


def three_channels(bands: Column) -> Column:
    """Exactly three channels: zeros are added, further ones dropped."""
    return F.slice(F.concat(bands, F.array_repeat(F.lit(0.0).cast("float"), 3)), 1, 3)
