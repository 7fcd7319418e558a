"""One raster from its pixels to result layers, and the merge of a folder's results."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batch import default_output
from .config import Config
from .operators import layers, merge, mosaic, pipeline, quantify, tiling
from .operators.segment import OnnxSegmenter, Segmenter, segment_tiles
from .plans.execution import LADDER, output_layers
from .sources import gpkg, raster
from .tables import discard, materialise

MASK = "_roi_stem_map"


def predict(spark: SparkSession, path: str, segmenter: Segmenter, c: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(layout, pixels): the output raster's frame (one row) and its set pixels (raster_id, row, col)."""
    laid = tiling.with_layout(raster.rasters(spark, [path]), c)
    jobs = tiling.tile_jobs(laid, c).join(laid.select("raster_id", "path"), "raster_id")
    tiles = raster.read_jobs(jobs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = segment_tiles(tiles, segmenter, c).select((F.col("tile_id") / (1 << 32)).cast("long").alias("raster_id"), (F.col("tile_id") % (1 << 32)).alias("tile_index"), "r", "c")
    return laid.withColumns(tiling.out_pixel_size(c)), materialise(tiling.placed(found, tiling.written_cores(jobs, laid, c)).distinct())


def vectorise(pixels: DataFrame, frame: dict, c: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(stems, tiles) for merge_tiles(): set pixels (row, col) in tiles with a halo, each traced and measured alone."""
    px, py, step = frame["out_px"], frame["out_py"], c.tile_inner_px
    halo = max(0, -int(-c.tile_overlap_m // max(abs(px), abs(py))))
    cells = lambda v: F.sequence(F.greatest(F.lit(0), F.floor((F.col(v) - halo) / step)), F.floor((F.col(v) + halo) / step))
    dealt = pixels.withColumn("tj", F.explode(cells("row"))).withColumn("ti", F.explode(cells("col")))
    dealt = dealt.filter((F.col("tj") * step < frame["out_height"]) & (F.col("ti") * step < frame["out_width"]))
    tiled = dealt.select((F.col("tj") * (1 << 20) + F.col("ti")).cast("long").alias("tile_id"), F.col("row").alias("r"), F.col("col").alias("c"))
    found = materialise(pipeline.stems_of_tiles(tiled, px, c))
    ox, oy = F.lit(frame["origin_x"]), F.lit(frame["origin_y"])
    d = pipeline.diameters(found, tiled, px, c).select("stem_id", "node", "d", (F.col("x") + ox).alias("x"), (F.col("y") + oy).alias("y"))
    tile = F.substring_index("stem_id", "_", 1).cast("long")
    stems = quantify.paths(d).select(tile.alias("tile_id"), F.transform("p", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("path"), F.transform("p", lambda v: v["d"]).alias("diameters"))
    j, i = F.floor(F.col("tile_id") / (1 << 20)) * step, F.col("tile_id") % (1 << 20) * step
    right, low = F.least(i + step + halo, F.lit(frame["out_width"])), F.least(j + step + halo, F.lit(frame["out_height"]))
    tiles = found.select(F.col("group_id").alias("tile_id")).distinct().select("tile_id", (ox + F.greatest(i - halo, F.lit(0)) * px).alias("x0"), (oy - low * py).alias("y0"), (ox + right * px).alias("x1"), (oy - F.greatest(j - halo, F.lit(0)) * py).alias("y1"))
    return stems, tiles


def result_layers(merged: DataFrame, c: Config = Config()) -> dict[str, DataFrame]:
    """The layers stems, nodes and vectors of merge_tiles()' rows."""
    first, last = F.get("path", F.lit(0)), F.element_at("path", -1)
    known = F.when(F.size("diameters") == F.size("path"), F.col("diameters")).otherwise(F.array().cast("array<double>"))
    stems = merged.select("stem_id", first["x"].alias("start_x"), first["y"].alias("start_y"), last["x"].alias("stop_x"), last["y"].alias("stop_y"), "length", F.coalesce("volume", F.lit(0.0)).alias("volume"), F.to_json(known).alias("d_json"), "path")
    nodes = layers.node_layer(merged)
    lines = (quantify.lines_of_diameters if c.diameter_method == "edt" else quantify.measuring_lines)(nodes, c.diameter_vector_half_length_m)
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return {
        "stems": stems,
        "nodes": nodes.select("stem_id", "node", "d", F.array(point("x", "y")).alias("path")),
        "vectors": layers.vector_layer(lines).select("stem_id", "node", "d", F.array(point("ax", "ay"), point("bx", "by")).alias("path")),
    }


def write_layers(path: str, merged: DataFrame, names: list[str], c: Config = Config()) -> str:
    """The layers to a file. What stood there goes first; if it is locked it stays, and a name beside it is taken."""
    try:
        os.remove(path)
    except (FileNotFoundError, PermissionError):
        pass
    found = result_layers(merged, c)
    return gpkg.write_frames(path, {n: found[n] for n in names})


def analyse_raster(spark: SparkSession, model: str | Segmenter, path: str, mask_path: str, prefix: str, kind: str, c: Config = Config()) -> str | None:
    """A raster to its mask (a TIFF) and, beyond Stems, to <prefix>.gpkg, whose name it returns. No stems: no file."""
    if kind not in LADDER:
        raise ValueError(f"unknown output {kind!r}")
    laid, pixels = predict(spark, path, OnnxSegmenter(model) if isinstance(model, str) else model, c)
    frame = laid.first().asDict()
    mosaic.write(mask_path, pixels, frame["out_width"], frame["out_height"], frame["out_px"], frame["out_py"], (frame["origin_x"], frame["origin_y"]))
    out = None
    if kind != "Stems":
        edge = lambda v: F.lit(float(v))
        whole = (edge(frame["origin_x"]), edge(frame["origin_y"] - frame["out_height"] * frame["out_py"]), edge(frame["origin_x"] + frame["out_width"] * frame["out_px"]), edge(frame["origin_y"]))
        merged = materialise(merge.merge_tiles(*vectorise(pixels, frame, c), c.tile_overlap_m, whole, c))
        if merged.limit(1).count():
            out = write_layers(f"{prefix}.gpkg", merged, output_layers(kind), c)
        discard(merged)
    discard(pixels)
    return out


def discover(folder: str, output: str | None = None) -> list[tuple[str, str, str | None]]:
    """(tile, layer file, mask file or None) of a folder's results.

    A mask goes with the one layer file, at any depth, whose name begins as the mask's does;
    without one the mask is left out, and two raise. Without masks each layer file but the
    output is a tile.
    """
    masks = sorted(n for n in os.listdir(folder) if MASK in n and n.lower().endswith((".tif", ".tiff")))
    found = []
    for name in masks:
        prefix = name[: name.index(MASK)] if name.endswith((f"{MASK}.tif", f"{MASK}.tiff")) else name
        files = sorted(map(str, Path(folder).rglob(f"{prefix}*.gpkg")))
        if len(files) > 1:
            raise RuntimeError(f"several layer files for tile {prefix!r}: {files}")
        found += [(prefix, f, os.path.join(folder, name)) for f in files]
    if not masks:
        found = [(p.stem, str(p), None) for p in sorted(Path(folder).rglob("*.gpkg")) if not output or os.path.abspath(p) != os.path.abspath(output)]
    return [(tile.removeprefix("raster_"), f, m) for tile, f, m in found]


#: Widths of the edge band where none is given: of a merge call, and of the command line's.
CALL_EDGE, COMMAND_EDGE = 1.0, 0.0


def merge_folder(spark: SparkSession, folder: str, output: str | None = None, edge: float = CALL_EDGE, mask_path: str | None = None, c: Config = Config()) -> tuple[str, int]:
    """Merges a folder's layer files into one; (file, stems). Nothing found: no file, and no failure.

    mask_path names the whole raster's mask: tile sides on its boundary are no seams.
    """
    output = output or default_output(folder)
    if os.path.exists(output):
        os.remove(output)
    found, kept, frames = discover(folder, output), None, []
    for tile, file, mask in found:
        layer = gpkg.read(spark, file, "stems")
        if "path" not in layer.columns or layers.first_column(layer) is None:
            continue
        d = layers.decoded(F.col("d_json")) if "d_json" in layer.columns else F.array().cast("array<double>")
        rows = layer.select(F.lit(tile).alias("tile_id"), "path", d.alias("diameters"))
        kept = rows if kept is None else kept.unionByName(rows)
        i = raster.info(mask) if mask else None
        frames.append((tile, i.origin_x, i.origin_y - i.height * i.py, i.origin_x + i.width * i.px, i.origin_y) if i else (tile, None, None, None, None))
    if kept is None:
        return output, 0
    tiles = spark.createDataFrame(frames, "tile_id string, x0 double, y0 double, x1 double, y1 double")
    w = raster.info(mask_path) if mask_path else None
    whole = tuple(F.lit(float(v)) for v in (w.origin_x, w.origin_y - w.height * w.py, w.origin_x + w.width * w.px, w.origin_y)) if w else None
    merged = materialise(merge.merge_tiles(kept, tiles, edge, whole, c))
    n = merged.count()
    written = write_layers(output, merged, ["stems", "nodes", "vectors"], c) if n else output
    discard(merged)
    return written, n
