"""From mask pixels of tiles to connected, measured stems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from . import connect, quantify, skeleton


def stems_of_tiles(pixels: DataFrame, pixel: float, c: Config = Config()) -> DataFrame:
    """pixels (tile_id, r, c) to stems (group_id, stem_id, path in metres, diameters)."""
    parts = skeleton.trace_tiles(pixels, refined=True, pixel=pixel, min_length=c.min_length)
    # a pixel's corner, no half-pixel shift; rows count downwards
    world = F.transform(F.reverse("path"), lambda p: F.struct((p["c"] * F.lit(pixel)).alias("x"), (p["r"] * F.lit(-pixel)).alias("y")))
    laid = parts.select(F.col("tile_id").alias("group_id"), world.alias("path"))
    side = lambda f, k: f(F.transform("path", lambda p: p[k]))
    part = [F.get("path", F.lit(0)).alias("start"), F.element_at("path", -1).alias("stop"), *(side(f, k).alias(f"{n}{k}") for k in "xy" for n, f in (("lo", F.array_min), ("hi", F.array_max)))]
    once = laid.groupBy("group_id", *part).agg(F.min("path").alias("path"))  # one part for each pair of ends and bounds
    fragments = once.select("group_id", "path", F.array().cast("array<double>").alias("diameters"))
    return connect.connect_groups(fragments, c)


def edt_nodes(nodes: DataFrame, pixels: DataFrame, pixel: float, clip: float | None = None) -> DataFrame:
    """nodes (group_id, stem_id, node, x, y) with d: twice the distance to the background at their pixel.

    A node's pixel is the nearest corner, halves to even; off the mask d is 0. clip bounds
    the distance. Nodes and pixels meet by tile and pixel.
    """
    far = F.col("distance") if clip is None else F.least(F.col("distance"), F.lit(float(clip)))
    asked = nodes.withColumns({"r": F.bround(-F.col("y") / F.lit(pixel)).cast("long"), "c": F.bround(F.col("x") / F.lit(pixel)).cast("long")})
    found = skeleton.distance_tiles(pixels, pixel, pixel).select(F.col("tile_id").alias("group_id"), "r", "c", (2 * far).alias("d"))
    return asked.join(found, ["group_id", "r", "c"], "left").withColumn("d", F.coalesce("d", F.lit(0.0))).drop("r", "c")


def diameters(stems: DataFrame, pixels: DataFrame, pixel: float, c: Config = Config()) -> DataFrame:
    """Nodes (stem_id, node, x, y, d) of stems, measured in their tile's mask by c.diameter_method and cleaned."""
    if c.diameter_method not in ("contour", "edt"):
        raise ValueError(f"unknown diameter method {c.diameter_method!r}")
    key = F.concat_ws("_", "group_id", "stem_id")
    nodes = stems.select("group_id", key.alias("stem_id"), F.posexplode("path").alias("node", "pt")).select("group_id", "stem_id", "node", "pt.x", "pt.y", F.lit(0.0).alias("d"))
    if c.diameter_method == "edt":
        found = edt_nodes(nodes.drop("d"), pixels, pixel, c.edt_clip_max_m).select("stem_id", "node", "x", "y", "d")
        return found.drop("d").join(quantify.clean_diameters(found), ["stem_id", "node"])
    lines = quantify.measuring_lines(nodes, c.diameter_vector_half_length_m).withColumn("line_id", F.xxhash64("stem_id", "node"))
    r, col = (lambda v: -F.col(v) / F.lit(pixel)), (lambda v: F.col(v) / F.lit(pixel))
    asked = lines.select(F.col("group_id").alias("tile_id"), "line_id", r("ay").alias("r0"), col("ax").alias("c0"), r("by").alias("r1"), col("bx").alias("c1"), r("y").alias("node_r"), col("x").alias("node_c"))
    found = skeleton.measure_tiles(asked, pixels)
    d = lines.drop("d").join(found.select(F.col("tile_id").alias("group_id"), "line_id", (F.col("d") * F.lit(pixel)).alias("d")), ["group_id", "line_id"])
    nodes = d.select("stem_id", "node", "x", "y", "d")
    return nodes.drop("d").join(quantify.clean_diameters(nodes), ["stem_id", "node"])


def measured(stems: DataFrame, pixels: DataFrame, pixel: float, c: Config = Config()) -> DataFrame:
    """Edges, length and volume of each stem by the diameters of its nodes."""
    return quantify.stem_measures(diameters(stems, pixels, pixel, c))
