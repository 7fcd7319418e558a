"""Output layers: stems, nodes and measuring vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import materialise

LAYERS = {"stems": ["stems", "stem", "trees", "tree"], "nodes": ["nodes", "node"], "vectors": ["vectors", "vector", "segments", "segment"]}
ID_COLUMNS = ["stem_id", "id", "ID", "StemID", "stemID"]


def decoded(text: Column) -> Column:
    """A JSON list of numbers; anything else gives an empty list."""
    return F.coalesce(F.from_json(text, "array<double>"), F.array().cast("array<double>"))


def stem_layer(stems: DataFrame) -> DataFrame:
    """stems with p (nodes in order): ends, length, volume and the lists as JSON."""
    n = F.size("p")
    edges = F.arrays_zip(F.slice("p", F.lit(1), n - 1).alias("a"), F.slice("p", F.lit(2), n - 1).alias("b"))
    gap = lambda e: F.sqrt((e["b"]["x"] - e["a"]["x"]) * (e["b"]["x"] - e["a"]["x"]) + (e["b"]["y"] - e["a"]["y"]) * (e["b"]["y"] - e["a"]["y"]))
    frustum = lambda e: F.lit(math.pi / 12) * (e["a"]["d"] * e["a"]["d"] + e["a"]["d"] * e["b"]["d"] + e["b"]["d"] * e["b"]["d"]) * gap(e)
    lengths, volumes = F.transform(edges, gap), F.transform(edges, frustum)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    listed = lambda v: F.to_json(F.transform(v, lambda x: F.round(x, 6)))
    first, last = F.get("p", F.lit(0)), F.element_at("p", -1)
    return stems.select(
        "stem_id",
        first["x"].alias("start_x"), first["y"].alias("start_y"), last["x"].alias("stop_x"), last["y"].alias("stop_y"),
        n.cast("long").alias("n_nodes"),
        total(lengths).alias("length"),
        total(volumes).alias("volume"),
        F.to_json(F.transform("p", lambda v: v["d"])).alias("d_json"),
        listed(lengths).alias("l_json"),
        listed(volumes).alias("v_json"),
    )


def node_layer(stems: DataFrame) -> DataFrame:
    """A row a node; the diameter is null where the list is shorter than the path."""
    d = stems.select("stem_id", "diameters", F.posexplode("path").alias("node", "pt"))
    return d.select("stem_id", F.col("node").cast("long").alias("node"), F.get("diameters", F.col("node")).alias("d"), F.col("pt.x").alias("x"), F.col("pt.y").alias("y"))


def vector_layer(lines: DataFrame) -> DataFrame:
    """Measuring lines without those that are not finite or have no length."""
    ends = ["ax", "ay", "bx", "by"]
    sound = F.lit(True)
    for c in ends:
        sound = sound & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return lines.filter(sound & ((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by"))))


def first_column(layer: DataFrame, names: list[str] = ID_COLUMNS) -> str | None:
    return next((c for c in names if c in layer.columns), None)


def numbered(stems: DataFrame, order: list[Column]) -> DataFrame:
    """Ids from 0 on in a canonical order.

    A range sort, counts by partition, and an offset each: no single task orders all. The
    sorted rows are written once, so that counts and ids speak of the same partitions.
    """
    ordered = materialise(stems.sort(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()))
    sizes = {r["__p"]: r["count"] for r in ordered.groupBy("__p").count().collect()}
    base, offsets = 0, []
    for p in sorted(sizes):
        offsets += [F.lit(p), F.lit(base)]
        base += sizes[p]
    offset = F.create_map(*offsets)[F.col("__p")] if offsets else F.lit(0)
    local = F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn("stem_id", (offset + local).cast("long")).drop("__p", "__i")

