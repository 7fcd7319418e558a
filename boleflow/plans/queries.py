"""The catalogue of driver queries over the engine's operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import connect, layers, masks, merge, pipeline, quantify, segment, skeleton, tiling
from ..sources.adapters import view
from ..streaming import progress
from . import execution, registry

ROUND = 6
SEAM = 1.0


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, ROUND)


def rounded(d: DataFrame, *columns: str) -> DataFrame:
    return d.withColumns({c: r6(c) for c in columns})


def nodes(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "stem_nodes")


def stem_paths(s: SparkSession, d: str) -> DataFrame:
    """Stems of two nodes or more with their path, diameters and ends."""
    p = quantify.paths(nodes(s, d)).filter("size(p) >= 2")
    first, last = F.get("p", F.lit(0)), F.element_at("p", -1)
    return p.select(
        "stem_id", "p", F.transform("p", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("path"), F.transform("p", lambda v: v["d"]).alias("diameters"),
        first["x"].alias("start_x"), first["y"].alias("start_y"), last["x"].alias("stop_x"), last["y"].alias("stop_y"),
    )


def stem_volume(s, d):
    return rounded(quantify.stem_measures(nodes(s, d), 2.0), "length", "volume")


def stem_quartiles(s, d):
    return rounded(quantify.quartiles(nodes(s, d)), "q1", "q3")


def stem_clean_diameter(s, d):
    return rounded(quantify.clean_diameters(nodes(s, d)), "d")


def stem_normals(s, d):
    return rounded(quantify.normals(nodes(s, d)).select("stem_id", "node", "nx", "ny"), "nx", "ny")


def measurement_vectors(s, d):
    lines = layers.vector_layer(quantify.measuring_lines(nodes(s, d)))
    return rounded(lines.select("stem_id", "node", "d", "ax", "ay", "bx", "by"), "ax", "ay", "bx", "by")


def stem_nodes_layer(s, d):
    return layers.node_layer(stem_paths(s, d))


def stem_layer(s, d):
    """The lists of volumes by their number and sum: engines print small numbers in different ways."""
    v = layers.decoded(F.col("v_json"))
    out = layers.stem_layer(stem_paths(s, d)).withColumns({"n_v": F.size(v).cast("long"), "v_total": F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6)})
    return rounded(out.drop("v_json"), "length", "volume")


def json_list_decode(s, d):
    text = layers.stem_layer(stem_paths(s, d)).select("stem_id", F.when(F.col("stem_id") % 7 == 0, "oops").when(F.col("stem_id") % 11 == 0, None).otherwise(F.col("d_json")).alias("t"))
    values = layers.decoded(F.col("t"))
    return text.select("stem_id", F.size(values).cast("long").alias("n"), r6(F.aggregate(values, F.lit(0.0), lambda a, x: a + x)).alias("total"))


def merge_diameters(s, d):
    p = stem_paths(s, d).select("stem_id", "diameters")
    a = p.select(F.col("stem_id").alias("a"), F.col("diameters").alias("da"), (F.col("stem_id") + 1).alias("b"))
    b = p.select(F.col("stem_id").alias("b"), F.col("diameters").alias("db"))
    j = a.join(b, "b")
    na = F.size("da") + F.when(F.col("a") % 5 == 0, 1).otherwise(0)
    merged = g.merged_diameters(F.col("da"), na, F.col("db"), F.size("db"))
    return j.select("a", "b", F.size(merged).cast("long").alias("n"), r6(F.aggregate(merged, F.lit(0.0), lambda x, y: x + y)).alias("total"))


def tile_layout(s, d):
    laid = tiling.with_layout(view(s, d, "raster_info"))
    out = laid.select("raster_id", "px_per_tile_x", "px_per_tile_y", "overlap_img_x", "overlap_img_y", "x_tiles", "y_tiles", "out_width", "out_height", *[c.alias(k) for k, c in tiling.out_pixel_size().items()])
    return rounded(out, "overlap_img_x", "overlap_img_y", "out_px", "out_py")


def tile_jobs(s, d):
    return tiling.tile_jobs(tiling.with_layout(view(s, d, "raster_info")))


def tile_estimate(s, d):
    rasters = view(s, d, "raster_info").withColumn("width", F.when(F.col("raster_id") % 9 == 0, 0).otherwise(F.col("width")))
    return tiling.estimated_tiles(rasters)


def vector_tiles(s, d):
    return tiling.vector_tiles(view(s, d, "raster_info"))


def job_shards(s, d):
    laid = tiling.with_layout(view(s, d, "raster_info"))
    return tiling.shard_ranges(laid.select("raster_id", (F.col("x_tiles") * F.col("y_tiles")).alias("total")), 7)


def pixel_to_world(s, d):
    x, y = tiling.pixel_to_world(F.col("r"), F.col("c"))
    corners = F.explode(F.array(*[F.struct(r.alias("r"), c.alias("c")) for r in (F.lit(0).cast("long"), F.col("height")) for c in (F.lit(0).cast("long"), F.col("width"))]))
    p = view(s, d, "raster_info").select("*", corners.alias("e")).select("*", "e.r", "e.c")
    return p.select("raster_id", "r", "c", r6(x).alias("x"), r6(y).alias("y"))


def binarize_core(s, d):
    valid = F.transform("score", lambda v, i: (i + F.col("tile_id")) % 5 != 0)
    core = masks.binary_core(F.col("score"), 8, 2, 0.05, valid)
    t = view(s, d, "score_tiles").select("tile_id", F.posexplode(core).alias("i", "v"))
    return t.select("tile_id", F.col("i").cast("long").alias("i"), F.col("v").cast("long").alias("v"))


def valid_mask(s, d):
    t = view(s, d, "score_tiles")
    file_mask = F.transform("score", lambda v, i: (F.col("tile_id") % 3 != 0) | (i % 4 != 0))
    bands = F.transform("score", lambda v: F.array(F.when(v > 0.1, 1).otherwise(0), F.when(v < -0.1, 1).otherwise(0)))
    valid = masks.valid_mask(file_mask, bands)
    return t.select("tile_id", F.size(F.filter(valid, lambda m: m)).cast("long").alias("n_valid"))


def empty_tile_prune(s, d):
    return masks.with_foreground(view(s, d, "score_tiles"), "score", 0.3).select("tile_id")


def neighbor_degree(s, d):
    return masks.degree(view(s, d, "mask_pixels"))


def skeleton_nodes(s, d):
    return masks.node_kinds(view(s, d, "mask_pixels"))


def dense_removal(s, d):
    return masks.without_dense(view(s, d, "mask_pixels"))


def branch_clear_round(s, d):
    return masks.without_branches(view(s, d, "mask_pixels"))


def part_canonical(s, d):
    """Parts by their key: ends and bounds, start above stop, long enough."""
    p = stem_paths(s, d).select("stem_id", "path", F.array_min(F.transform("path", lambda q: q["y"])).alias("lo_r"), F.array_min(F.transform("path", lambda q: q["x"])).alias("lo_c"), F.array_max(F.transform("path", lambda q: q["y"])).alias("hi_r"), F.array_max(F.transform("path", lambda q: q["x"])).alias("hi_c"))
    p = p.filter("size(path) - 1 >= 2")
    a, b = F.get("path", F.lit(0)), F.element_at("path", -1)
    p = p.withColumn("path", F.when(a["y"] > b["y"], F.reverse("path")).otherwise(F.col("path")))
    keys = [F.get("path", F.lit(0))["y"].alias("start_r"), F.get("path", F.lit(0))["x"].alias("start_c"), F.element_at("path", -1)["y"].alias("stop_r"), F.element_at("path", -1)["x"].alias("stop_c"), "lo_r", "lo_c", "hi_r", "hi_c"]
    return p.groupBy(*keys).agg(F.min("stem_id").alias("stem_id"))


def tiles_kept(s, d):
    t = view(s, d, "tiles")
    bounds = t.agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()  # four numbers
    whole = tuple(F.lit(v).cast("double") for v in bounds)
    return t.withColumns(merge.keep_region(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), SEAM, whole))


def keep_region(s, d):
    return tiles_kept(s, d).select("ti", "tj", "kx0", "ky0", "kx1", "ky1")


def tile_stems(s, d):
    """Stems with the tiles whose halo they reach; tiles are found by their grid cell."""
    st = view(s, d, "stems")
    # a box that only touches a halo's edge belongs to it: one cell more on the low side
    cells = lambda lo, hi: F.sequence((F.ceil((F.col(lo) - 1.0) / 5.0) - 1).cast("long"), F.floor((F.col(hi) + 1.0) / 5.0).cast("long"))
    st = st.withColumn("ti", F.explode(cells("minx", "maxx"))).withColumn("tj", F.explode(cells("miny", "maxy")))
    j = st.join(tiles_kept(s, d), ["ti", "tj"])
    return j.filter("maxx >= x0 - 1 AND minx <= x1 + 1 AND maxy >= y0 - 1 AND miny <= y1 + 1")


def kept_stems(s, d):
    """Stems whose path meets the keep-region of the tile."""
    boxed = tile_stems(s, d).filter(merge.box_meets())  # a path that meets a region has a box that does
    return boxed.join(stem_paths(s, d).select("stem_id", "path"), "stem_id").filter(merge.path_meets())


def seam_filter(s, d):
    return kept_stems(s, d).select("ti", "tj", "stem_id", "n_nodes")


def edge_band_split(s, d):
    return tile_stems(s, d).select("ti", "tj", "stem_id", merge.on_edge(SEAM).alias("on_edge"))


def child_semi_join(s, d):
    kept = kept_stems(s, d)
    return merge.children_of(kept, nodes(s, d), ["stem_id"]).select("stem_id", "node", "d")


def global_ids(s, d):
    kept = kept_stems(s, d)
    return kept.select(merge.global_ids(F.format_string("r%05d_c%05d", "tj", "ti"), F.col("stem_id")).alias("global_id"), "n_nodes")


def merge_union(s, d):
    t = tile_stems(s, d)
    inner = t.filter(~merge.on_edge(SEAM)).select("ti", "tj", "stem_id", F.lit("inner").alias("part"))
    edge = t.filter(merge.on_edge(SEAM)).select("stem_id", F.lit("edge").alias("part")).distinct()
    return merge.union_layers(inner, edge).withColumns({c: F.coalesce(c, F.lit(-1).cast("long")) for c in ("ti", "tj")})


def merge_summary(s, d):
    return merge.summary(kept_stems(s, d))


def endpoint_candidates(s, d):
    c = connect.endpoint_candidates(stem_paths(s, d), 1.0)
    return rounded(c.select("base", "other", "gap"), "gap")


def voted(s, d):
    """A wide tolerance: the adapters' paths are no real stems."""
    return connect.votes(stem_paths(s, d).select("stem_id", "path"), connect.Config(tolerance_angle=90.0, max_distance=4.0))


def connect_votes(s, d):
    return rounded(voted(s, d), "gap", "vote")


def best_candidate(s, d):
    return rounded(connect.best(voted(s, d).withColumn("vote", r6("vote"))), "vote")


def best_either(s, d):
    return rounded(connect.best(connect.either_way(voted(s, d).withColumn("vote", r6("vote")))), "vote")


def tiled_fragments(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pieces of trees in each tile of 40 x 30 m whose halo of 1 m they reach, and the tiles."""
    f = view(s, d, "fragments")
    rows = F.sequence(F.floor((F.col("y") - 1) / 30), F.floor((F.col("y") + 3.5) / 30))
    path = F.array(*[F.struct(F.col("x"), (F.col("y") + F.lit(1.25 * i)).alias("y")) for i in range(3)])
    stems = f.select("ti", F.explode(rows).alias("tj"), path.alias("path"), F.array_repeat("d", 3).alias("diameters")).withColumn("tile_id", F.format_string("r%05d_c%05d", "tj", "ti"))
    x0, y0 = (F.col("ti") * 40 - 20).cast("double"), (F.col("tj") * 30).cast("double")
    tiles = stems.select("tile_id", "ti", "tj").distinct().select("tile_id", x0.alias("x0"), y0.alias("y0"), (x0 + 40).alias("x1"), (y0 + 30).alias("y1"))
    return stems.select("tile_id", "path", "diameters"), tiles


def merge_reconnect(s, d):
    """Tiles to one layer with seams closed."""
    merged = merge.merge_tiles(*tiled_fragments(s, d), SEAM)
    return rounded(merged.select("stem_id", "tile_id", F.size("path").cast("long").alias("n_nodes"), "length", "volume"), "length", "volume")


def dedup_contained(s, d):
    """Axis-aligned intervals: a stem's box on a row goes if a longer one there holds it."""
    st = view(s, d, "stems").select("stem_id", "minx", "maxx", F.floor(F.col("miny")).cast("long").alias("row"), (F.col("maxx") - F.col("minx")).alias("len"))
    # a box goes to the stretch of its left end, and a box that may hold it to all that it reaches
    stretch = lambda c: F.floor(c / 25.0).cast("long")
    st = st.withColumn("at", stretch(F.col("minx")))
    b = st.select("row", F.explode(F.sequence(stretch(F.col("minx") - 0.3), stretch(F.col("maxx") + 0.3))).alias("at"), F.col("stem_id").alias("b_id"), F.col("minx").alias("b0"), F.col("maxx").alias("b1"), F.col("len").alias("b_len"))
    longer = (F.col("b_len") > F.col("len")) | ((F.col("b_len") == F.col("len")) & (F.col("b_id") < F.col("stem_id")))
    held = st.join(b, ["row", "at"]).filter(longer & (F.col("b0") <= F.col("minx") + 0.3) & (F.col("b1") >= F.col("maxx") - 0.3))
    return st.join(held.select("stem_id").distinct(), "stem_id", "left_anti").select("stem_id", "row")


def tile_metrics(s, d):
    m = view(s, d, "tile_metrics")
    out = m.groupBy("status").agg(F.count("*").alias("n_tiles"), F.count_if(F.col("fg_count") == 0).alias("n_empty"), F.sum("segment_count").alias("n_segments"), F.sum("stem_count").alias("n_stems"), F.avg("total_s").alias("mean_s"), F.sum("total_s").alias("sum_s"))
    return rounded(out, "mean_s", "sum_s")


def tile_timing(s, d):
    return rounded(view(s, d, "tile_metrics").groupBy("status").agg(F.median("total_s").alias("median_s")), "median_s")


def input_check(s, d):
    r = view(s, d, "raster_info").withColumns({"item_bytes": 1 + 16 * (F.col("raster_id") % 5), "geographic": F.col("raster_id") % 4 == 0, "n_overviews": F.col("raster_id") % 3})
    return rounded(tiling.input_check(r.withColumn("py", 2 * F.col("py"))), "gigabytes")


def content_windows(s, d):
    mean = F.aggregate("score", F.lit(0.0), lambda a, v: a + v) / F.size("score")
    spread = F.aggregate(F.transform("score", lambda v: (v - F.col("mean")) * (v - F.col("mean"))), F.lit(0.0), lambda a, v: a + v) / F.size("score")
    t = view(s, d, "score_tiles").withColumn("score", F.col("score").cast("array<double>")).withColumn("mean", mean)
    windows = t.select((F.col("tile_id") % 10).alias("raster_id"), F.col("tile_id").alias("row"), (F.col("tile_id") % 7).alias("col"), r6(F.sqrt(spread)).alias("std"))
    return tiling.content_windows(windows, 3).withColumn("place", F.col("place").cast("long"))


def written_cores(s, d):
    """The output rasters are smaller here than the tiles make them, so that some cores are clipped."""
    laid = tiling.with_layout(view(s, d, "raster_info"))
    cut = laid.withColumns({"out_height": F.col("out_height") - 300 * (F.col("raster_id") % 3), "out_width": F.col("out_width") - 600 * (F.col("raster_id") % 2)})
    return tiling.written_cores(tiling.tile_jobs(laid), cut).select("raster_id", "tile_index", "dst_row", "dst_col", "write_height", "write_width")


def mask_agreement(s, d):
    t = view(s, d, "score_tiles").select("tile_id", F.posexplode("score").alias("i", "v"))
    pixels = t.select("tile_id", F.floor(F.col("i") / 8).alias("r"), (F.col("i") % 8).alias("c"), "v")
    return rounded(masks.agreement(view(s, d, "score_tiles"), pixels.filter("v >= 0.05D"), pixels.filter("v <= 0.1D AND v >= 0")), "iou")


def _registry(s: SparkSession) -> DataFrame:
    families = [("Spruce", ("fp32", "fp16", "int8")), ("Beech", ("fp32", "int8")), ("General", ("fp32",))]
    rows = [(f"{f.lower()}_{p}", f, p, i != 1, 1000 * (i + 1)) for i, (f, ps) in enumerate(families) for p in ps]
    return s.createDataFrame(rows, "id string, family string, precision string, installed boolean, bytes_on_disk long")


def registry_resolve(s, d):
    names = F.array(*[F.lit(x) for x in ("Spruce", "beech", "GENERAL", "spruce_fp16", "BEECH_FP32", "Oak")])
    wants = F.array(*[F.lit(x) for x in ("fp32", "int8")])
    orders = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("request_id"), F.get(names, (F.col("o_custkey") % 6).cast("int")).alias("name"), F.get(wants, (F.col("o_orderkey") % 2).cast("int")).alias("want"))
    return registry.resolve_frame(_registry(s), orders)


def family_summary(s, d):
    return registry.family_summary(_registry(s))


def plan_mode(s, d):
    wishes = F.array(*[F.lit(x) for x in ("auto", "cpu", "single_gpu", "MULTI_GPU")])
    c = s.read.parquet(f"{d}/customer.parquet")
    t = c.select(F.col("c_custkey").alias("job_id"), F.get(wishes, (F.col("c_custkey") % 4).cast("int")).alias("backend"), (F.col("c_nationkey") % 3).cast("long").alias("gpus"))
    return t.withColumn("mode", execution.prediction_mode(F.col("backend"), F.col("gpus")))


def output_ladder(s, d):
    c = s.read.parquet(f"{d}/customer.parquet")
    t = c.select(F.col("c_custkey").alias("job_id"), *[(F.col("c_custkey") % m == 0).alias(k) for k, m in (("stem", 2), ("trees", 3), ("nodes", 5))])
    return t.select("job_id", execution.output_kind(F.col("stem"), F.col("trees"), F.col("nodes")).alias("kind"))


def progress_percent(s, d):
    return progress.percentages(view(s, d, "log_lines")).select("run_id", "line_no", "percent")


def gpu_failure_flag(s, d):
    return view(s, d, "log_lines").select("run_id", "line_no", progress.device_failed(F.col("line")).alias("failed"))


# --- image and graph algorithms: rows only, tested against brute force -----------------


def mask_tiles(s, d):
    """The mask's pixels in 16-pixel tiles with a halo of two pixels."""
    m = view(s, d, "mask_pixels")
    around = F.explode(F.array(*[F.struct(F.floor((F.col("r") + dr) / 16).alias("a"), F.floor((F.col("c") + dc) / 16).alias("b")) for dr in (-2, 2) for dc in (-2, 2)]))
    return m.select("r", "c", around.alias("t")).select((F.col("t.b") * 64 + F.col("t.a")).cast("long").alias("tile_id"), "r", "c").distinct()


def thin_mask(s, d):
    return skeleton.thin_tiles(mask_tiles(s, d))


def trace_segments(s, d):
    return skeleton.trace_tiles(skeleton.thin_tiles(mask_tiles(s, d)), 2).select("tile_id", "part", F.size("path").alias("n"))


def refine_segments(s, d):
    return skeleton.trace_tiles(mask_tiles(s, d), refined=True, pixel=0.25, min_length=2.0).select("tile_id", "part", F.size("path").alias("n"))


def edt_diameters(s, d):
    return rounded(skeleton.distance_tiles(mask_tiles(s, d)).withColumn("d", 2 * F.col("distance")).drop("distance"), "d")


def contour_diameters(s, d):
    m = mask_tiles(s, d)
    lines = m.select("tile_id", (F.col("c") * 64 + F.col("r")).alias("line_id"), F.col("r").cast("double").alias("r0"), (F.col("c") + 0.5).alias("c0"), (F.col("r") + 2.0).alias("r1"), (F.col("c") + 0.5).alias("c1"), (F.col("r") + 0.5).alias("node_r"), (F.col("c") + 0.5).alias("node_c"))
    return rounded(skeleton.measure_tiles(lines, m), "d")


def edt_nodes(s, d):
    """Nodes off their pixel's corner: some round to a pixel off the mask."""
    m = mask_tiles(s, d)
    nodes = m.select(F.col("tile_id").alias("group_id"), F.concat_ws("_", "r", "c").alias("stem_id"), F.lit(0).cast("long").alias("node"), ((F.col("c") + 0.4) * 0.25).alias("x"), ((F.col("r") + 0.6) * -0.25).alias("y"))
    return rounded(pipeline.edt_nodes(nodes, m, 0.25, 0.3).select("group_id", "stem_id", "d"), "d")


def connect_stems(s, d):
    """Stems of a plot may be connected: groups are of one size, and there are as many as plots."""
    p = stem_paths(s, d).select(F.floor(F.col("stem_id") / 16).cast("long").alias("group_id"), "path", "diameters")
    done = connect.connect_groups(p, connect.Config(max_distance=2.0, tolerance_angle=30.0))
    return done.select("group_id", "stem_id", F.size("path").alias("n_nodes"), F.size("diameters").alias("n_diameters"))


def segment_tiles(s, d):
    tiles = view(s, d, "score_tiles").select("tile_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("bands"), F.expr("unhex(array_join(transform(score, v -> lpad(hex(cast(least(255, greatest(0, round(v * 400F + 128F))) as int)), 2, '0')), ''))").alias("pixels"))
    return segment.segment_tiles(tiles, segment.PixelSegmenter([4.0, 0.0, 0.0], -2.0), connect.Config(img_width=16, overlap_pred=4))


def analyse(s, d):
    """All stages: mask, segments, connection, diameters, volumes."""
    m = mask_tiles(s, d)
    return rounded(pipeline.measured(pipeline.stems_of_tiles(m, 0.25), m, 0.25), "length", "volume")


QUERIES = {
    f.__name__: f
    for f in (
        stem_volume, stem_quartiles, stem_clean_diameter, stem_normals, measurement_vectors, stem_nodes_layer, stem_layer, json_list_decode, merge_diameters,
        tile_layout, tile_jobs, tile_estimate, vector_tiles, job_shards, pixel_to_world, binarize_core, valid_mask, empty_tile_prune, neighbor_degree, skeleton_nodes,
        dense_removal, branch_clear_round, part_canonical, keep_region, seam_filter, edge_band_split, child_semi_join, global_ids, merge_union, merge_summary,
        endpoint_candidates, connect_votes, best_candidate, best_either, merge_reconnect, dedup_contained, tile_metrics, tile_timing, input_check, content_windows, written_cores, mask_agreement, edt_nodes, registry_resolve, family_summary, plan_mode, output_ladder, progress_percent, gpu_failure_flag,
        thin_mask, trace_segments, refine_segments, edt_diameters, contour_diameters, connect_stems, segment_tiles, analyse,
    )
}
