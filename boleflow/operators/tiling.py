"""Tile layouts and grids: rows generated from raster metadata, without driver loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Config


def with_layout(rasters: DataFrame, c: Config = Config()) -> DataFrame:
    """Prediction layout: pixels of a tile, overlap, tile counts and output size.

    Both axes use img_width; the count is of whole steps of tile less overlap.
    """
    d = rasters.withColumns({f"px_per_tile_{a}": F.ceil(F.lit(c.tile_size) / F.abs(F.col(p))).cast("long") for a, p in (("x", "px"), ("y", "py"))})
    d = d.withColumns({f"overlap_img_{a}": F.lit(float(c.overlap_pred)) * F.col(f"px_per_tile_{a}") / F.lit(float(c.img_width)) for a in "xy"})
    step = {a: F.greatest(F.col(f"px_per_tile_{a}") - F.col(f"overlap_img_{a}"), F.lit(1.0)) for a in "xy"}
    d = d.withColumns({"x_tiles": F.ceil(F.col("width") / step["x"]).cast("long"), "y_tiles": F.ceil(F.col("height") / step["y"]).cast("long")})
    inner = c.img_width - c.overlap_pred
    return d.withColumns({"out_width": F.col("x_tiles") * inner + c.overlap_pred, "out_height": F.col("y_tiles") * inner + c.overlap_pred})


def out_pixel_size(c: Config = Config()) -> dict[str, Column]:
    """Pixel size of the output raster."""
    return {f"out_{p}": F.col(p) * F.col(f"px_per_tile_{a}") / F.lit(float(c.img_width)) for a, p in (("x", "px"), ("y", "py"))}


def tile_jobs(layout: DataFrame, c: Config = Config()) -> DataFrame:
    """One row a tile, numbered row by row; a source window is a pixel short of a tile."""
    d = layout.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("y_tiles") - 1)).alias("i"))
    d = d.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("x_tiles") - 1)).alias("j"))
    core, half = c.img_width - c.overlap_pred, c.overlap_pred // 2
    return d.select(
        "raster_id",
        (F.col("i") * F.col("x_tiles") + F.col("j")).alias("tile_index"),
        F.floor(F.col("i") * (F.col("px_per_tile_y") - F.col("overlap_img_y"))).cast("long").alias("src_row"),
        F.floor(F.col("j") * (F.col("px_per_tile_x") - F.col("overlap_img_x"))).cast("long").alias("src_col"),
        F.greatest(F.lit(1).cast("long"), F.col("px_per_tile_x") - 1).alias("src_width"),
        F.greatest(F.lit(1).cast("long"), F.col("px_per_tile_y") - 1).alias("src_height"),
        (F.col("i") * core + half).alias("dst_row"),
        (F.col("j") * core + half).alias("dst_col"),
    )


def estimated_tiles(rasters: DataFrame, c: Config = Config()) -> DataFrame:
    """Tiles of a raster, at least 1; 0 where its size is unknown."""
    known = (F.col("width") > 0) & (F.col("height") > 0) & (F.col("px") > 0) & (F.col("py") > 0)
    tiles = F.col("x_tiles") * F.col("y_tiles")
    laid = with_layout(rasters.withColumns({p: F.when(F.col(p) > 0, F.col(p)).otherwise(1.0) for p in ("px", "py")}), c)
    return laid.select("raster_id", F.when(known, F.greatest(tiles, F.lit(1).cast("long"))).otherwise(0).cast("long").alias("n_tiles"))


def metres_to_pixels(metres: float, px: Column, py: Column) -> Column:
    """Pixels that cover so many metres on the coarser axis; 0 without a pixel size."""
    coarse = F.greatest(F.abs(px), F.abs(py))
    return F.when(coarse > 0, F.ceil(F.lit(metres) / coarse)).otherwise(0).cast("long")


def vector_tiles(rasters: DataFrame, c: Config = Config()) -> DataFrame:
    """Inner windows on a regular grid, with halos clipped at the raster's edge."""
    d = rasters.withColumn("halo", metres_to_pixels(c.tile_overlap_m, F.col("px"), F.col("py")))
    step = F.lit(c.tile_inner_px).cast("long")
    zero = F.lit(0).cast("long")
    d = d.select("*", F.explode(F.sequence(zero, F.col("height") - 1, step)).alias("y0"))
    d = d.select("*", F.explode(F.sequence(zero, F.col("width") - 1, step)).alias("x0"))
    d = d.withColumns({"x1": F.least(F.col("x0") + step, F.col("width")), "y1": F.least(F.col("y0") + step, F.col("height"))})
    return d.select(
        "raster_id",
        F.format_string("raster_r%05d_c%05d", (F.col("y0") / step).cast("long"), (F.col("x0") / step).cast("long")).alias("tile_id"),
        "x0", "y0", "x1", "y1",
        F.greatest(zero, F.col("x0") - F.col("halo")).alias("hx0"),
        F.greatest(zero, F.col("y0") - F.col("halo")).alias("hy0"),
        F.least(F.col("width"), F.col("x1") + F.col("halo")).alias("hx1"),
        F.least(F.col("height"), F.col("y1") + F.col("halo")).alias("hy1"),
    )


def job_shards(jobs: DataFrame, n: int, total: Column) -> DataFrame:
    """Near-equal shards of consecutive jobs: shard i ends at round((i + 1) * total / n)."""
    ends = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.bround(i * total / F.lit(float(n))))
    return jobs.withColumn("shard", F.size(F.filter(ends, lambda e: e <= F.col("tile_index"))).cast("long"))


def shard_ranges(totals: DataFrame, n: int) -> DataFrame:
    """The same shards of totals (raster_id, total) as ranges (raster_id, shard, first, n); those without a job are left out.

    Only their ends are computed: what a raster costs does not grow with its jobs. Rows of
    one raster count together.
    """

    def end(i: Column) -> Column:
        return F.rint(i * F.col("total") / F.lit(float(n))).cast("long")

    dealt = totals.repartition("raster_id")  # a small file of rasters would be one task
    d = dealt.select("raster_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("shard"))
    d = d.select("raster_id", "shard", end(F.col("shard")).alias("first"), (end(F.col("shard") + 1) - end(F.col("shard"))).alias("n")).filter("n > 0")
    return d.groupBy("raster_id", "shard").agg(F.min("first").alias("first"), F.sum("n").alias("n"))


def content_windows(windows: DataFrame, n: int) -> DataFrame:
    """n windows (raster_id, row, col, std), spread over the ranking of a raster by contrast.

    Of the windows by falling std every (count / 3n)-th is taken, from the first, up to n.
    """
    order = Window.partitionBy("raster_id").orderBy(F.desc("std"), F.desc("col"), F.desc("row"))
    d = windows.withColumns({"place": F.row_number().over(order) - 1, "of": F.count("*").over(Window.partitionBy("raster_id"))})
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col("of") / F.lit(3 * n)).cast("long"))
    return d.filter((F.col("place") % step == 0) & (F.col("place") / step < n)).drop("of")


def written_cores(jobs: DataFrame, layout: DataFrame, c: Config = Config()) -> DataFrame:
    """What a tile's core covers of the output raster, clipped to it; cores outside go."""
    core = F.lit(c.img_width - c.overlap_pred).cast("long")
    d = jobs.join(layout.select("raster_id", "out_height", "out_width"), "raster_id")
    d = d.withColumns({"write_height": F.least(core, F.col("out_height") - F.col("dst_row")), "write_width": F.least(core, F.col("out_width") - F.col("dst_col"))})
    return d.filter("write_height > 0 AND write_width > 0").drop("out_height", "out_width")


def placed(pixels: DataFrame, cores: DataFrame) -> DataFrame:
    """Set pixels of cores (raster_id, tile_index, r, c) to pixels of the output raster (raster_id, row, col)."""
    d = pixels.join(cores, ["raster_id", "tile_index"]).filter("r < write_height AND c < write_width")
    return d.select("raster_id", (F.col("dst_row") + F.col("r")).alias("row"), (F.col("dst_col") + F.col("c")).alias("col"))


#: Side of a pixel above which results are worth a warning, in metres.
COARSE = 0.05
#: Size from which reading without overviews is worth a warning, in GB.
LARGE = 2.0


def input_check(rasters: DataFrame) -> DataFrame:
    """rasters (raster_id, width, height, bands, item_bytes, px, py, geographic, n_overviews) with
    their size in GB, whether they can be used, and what to say about them."""
    d = rasters.withColumn("gigabytes", F.col("width") * F.col("height") * F.col("bands") * F.col("item_bytes") / F.lit(float(2**30)))
    coarse = (F.abs("px") > F.lit(COARSE)) | (F.abs("py") > F.lit(COARSE))
    slow = (F.col("n_overviews") == 0) & (F.col("gigabytes") >= F.lit(LARGE))
    notes = F.filter(F.array(F.when(F.col("geographic"), "not projected"), F.when(~F.col("geographic") & coarse, "coarse pixels"), F.when(slow, "no overviews")), lambda v: v.isNotNull())
    return d.select("raster_id", "gigabytes", (~F.col("geographic")).alias("usable"), F.array_join(notes, ", ").alias("notes"))


def shifted_origin(col_off: Column, row_off: Column) -> tuple[Column, Column]:
    """World origin of a window: (x, y)."""
    return F.col("origin_x") + col_off * F.col("px"), F.col("origin_y") - row_off * F.col("py")


def pixel_to_world(r: Column, c: Column) -> tuple[Column, Column]:
    """World position of a pixel's corner: (x, y)."""
    return F.col("origin_x") + c * F.col("px"), F.col("origin_y") - r * F.col("py")
