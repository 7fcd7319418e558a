"""Measurement along stems: normals, measuring lines, diameters, lengths, volumes.

Rows are nodes (stem_id, node, x, y, d); everything is a window over a stem or a fold
over its array of nodes, so that one shuffle by stem serves all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.geometry import dist, frustum_volume, unit

IQR_FACTOR = 1.5


def by_stem() -> WindowSpec:
    return Window.partitionBy("stem_id").orderBy("node")


def edges(nodes: DataFrame) -> DataFrame:
    """Node i with node i + 1: length and frustum volume."""
    d = nodes.withColumns({f"{c}2": F.lead(c).over(by_stem()) for c in ("x", "y", "d")}).filter(F.col("x2").isNotNull())
    d = d.withColumn("length", dist(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")))
    return d.withColumn("volume", frustum_volume(F.col("d"), F.col("d2"), F.col("length")))


def stem_measures(nodes: DataFrame, min_length: float | None = None) -> DataFrame:
    """Edges, length and volume of each stem, of those longer than min_length."""
    d = edges(nodes).groupBy("stem_id").agg(F.count("*").alias("n_edges"), F.sum("length").alias("length"), F.sum("volume").alias("volume"))
    return d if min_length is None else d.filter(F.col("length") > F.lit(min_length))


def measured_paths(stems: DataFrame) -> DataFrame:
    """stems (path, diameters) with length, and volume where each node has a diameter (else null)."""
    n = F.size("path")
    nodes = F.arrays_zip(F.col("path").alias("p"), F.col("diameters").alias("d"))
    edges = F.arrays_zip(F.slice(nodes, F.lit(1), n - 1).alias("a"), F.slice(nodes, F.lit(2), n - 1).alias("b"))
    gap = lambda e: dist(e["a"]["p"]["x"], e["a"]["p"]["y"], e["b"]["p"]["x"], e["b"]["p"]["y"])
    length = F.aggregate(edges, F.lit(0.0), lambda s, e: s + gap(e))
    volume = F.aggregate(edges, F.lit(0.0), lambda s, e: s + frustum_volume(e["a"]["d"], e["b"]["d"], gap(e)))
    return stems.withColumns({"length": length, "volume": F.when(F.size("diameters") == n, volume)})


def between(low: Column, high: Column, t: Column) -> Column:
    """low (1 - t) + high t for quarters t, its first product not rounded (a fused multiply-add).

    Diameters often lie just on an outlier limit, where the last bit decides; SQL engines fuse
    here. Only 3/4 low can need rounding: it is kept as two numbers, and so is the sum.
    """
    half, quarter, rest = low * 0.5, low * 0.25, high * 0.25
    product = half + quarter
    lost = quarter - (product - half)
    total = product + rest
    back = total - product
    error = (product - (total - back)) + (rest - back)
    return F.when(t == 0.25, F.nanvl(total + (error + lost), total)).otherwise(low * (1 - t) + high * t)


def with_quartiles(stems: DataFrame, values: str) -> DataFrame:
    """q1 and q3 of an array of numbers, by linear interpolation between two of them; nulls don't count."""
    d = stems.withColumn("sorted", F.array_sort(F.array_compact(F.col(values).cast("array<double>"))))
    for q, share in (("q1", 0.25), ("q3", 0.75)):
        at = (F.size("sorted") - 1) * share
        low, high = (F.get("sorted", f(at).cast("int")) for f in (F.floor, F.ceil))
        d = d.withColumns({"at": at - F.floor(at), "low": low, "high": high})
        d = d.withColumn(q, between(F.col("low"), F.col("high"), F.col("at")))
    return d.drop("sorted", "at", "low", "high")


def quartiles(nodes: DataFrame) -> DataFrame:
    """Exact quartiles of a stem's diameters (linear interpolation)."""
    return with_quartiles(nodes.groupBy("stem_id").agg(F.collect_list("d").alias("all_d")), "all_d").select("stem_id", "q1", "q3")


def paths(nodes: DataFrame) -> DataFrame:
    """One row a stem with its nodes in order: p, an array of (node, x, y, d)."""
    return nodes.groupBy("stem_id").agg(F.array_sort(F.collect_list(F.struct("node", "x", "y", "d"))).alias("p"))


def clean_diameters(nodes: DataFrame) -> DataFrame:
    """Outlying diameters replaced by a weighted mean of the neighbours' ones.

    A fold from left to right: a value sees its left neighbour as already cleaned. Stems
    of up to four nodes stay; the last but one is never smoothed; then the ends take
    their neighbour's value if they are outliers themselves.
    """
    q = with_quartiles(paths(nodes).withColumn("all_d", F.col("p.d")), "all_d")
    spread = F.col("q3") - F.col("q1")
    q = q.withColumns({"lo": F.col("q1") - IQR_FACTOR * spread, "hi": F.col("q3") + IQR_FACTOR * spread})

    def far(v: Column) -> Column:
        return (v > F.col("hi")) | (v < F.col("lo"))

    def gap(a: Column, b: Column) -> Column:
        return dist(a["x"], a["y"], b["x"], b["y"])

    def step(done: Column, i: Column) -> Column:
        before, here, after = F.get("p", i - 1), F.get("p", i), F.get("p", i + 1)
        chord = gap(before, after)
        mean = (F.element_at(done, -1) * gap(here, after) + after["d"] * gap(before, here)) / chord
        return F.concat(done, F.array(F.when(far(here["d"]) & (chord > F.lit(2.220446049250313e-16)), mean).otherwise(here["d"])))

    n = F.size("p")
    inner = F.aggregate(F.sequence(F.lit(1), n - 3), F.array(F.get("p", F.lit(0))["d"]), step)
    original = F.transform("p", lambda v: v["d"])
    q = q.withColumn("c", F.when(n > 4, F.concat(inner, F.slice(original, n - 1, F.lit(2)))).otherwise(original))
    first = F.when(far(F.get("c", F.lit(0))), F.get("c", F.lit(1))).otherwise(F.get("c", F.lit(0)))
    last = F.when(far(F.element_at("c", -1)), F.get("c", n - 2)).otherwise(F.element_at("c", -1))
    ends = F.when(n > 4, F.concat(F.array(first), F.slice("c", F.lit(2), n - 2), F.array(last))).otherwise(F.col("c"))
    out = q.select("stem_id", F.posexplode(ends).alias("node", "d"))
    return out.select("stem_id", F.col("node").cast("long").alias("node"), "d")


def normals(nodes: DataFrame) -> DataFrame:
    """Unit normal at each node: across the chord of its neighbours; (0, 1) for a lone node."""
    before = {c: F.coalesce(F.lag(c).over(by_stem()), F.col(c)) for c in ("x", "y")}
    after = {c: F.coalesce(F.lead(c).over(by_stem()), F.col(c)) for c in ("x", "y")}
    alone = F.lag("x").over(by_stem()).isNull() & F.lead("x").over(by_stem()).isNull()
    vx, vy = unit(before["x"], before["y"], after["x"], after["y"])
    return nodes.withColumns({"nx": F.when(alone, 0.0).otherwise(-vy), "ny": F.when(alone, 1.0).otherwise(vx)})


def measuring_lines(nodes: DataFrame, half_length: float = 1.0) -> DataFrame:
    """The line across the stem at each node, from (ax, ay) to (bx, by)."""
    h = F.lit(half_length)
    return normals(nodes).withColumns(
        {"ax": F.col("x") - F.col("nx") * h, "ay": F.col("y") - F.col("ny") * h, "bx": F.col("x") + F.col("nx") * h, "by": F.col("y") + F.col("ny") * h}
    )


def lines_of_diameters(nodes: DataFrame, half_length: float = 1.0) -> DataFrame:
    """Measuring lines that reach at least as far as a node's own radius (d: its diameter)."""
    h = F.greatest(F.lit(half_length), F.coalesce(F.col("d"), F.lit(0.0)) / 2)
    return normals(nodes).withColumns({"ax": F.col("x") - F.col("nx") * h, "ay": F.col("y") - F.col("ny") * h, "bx": F.col("x") + F.col("nx") * h, "by": F.col("y") + F.col("ny") * h})


def measurement_count(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("d").alias("n"))
