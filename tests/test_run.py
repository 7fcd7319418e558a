"""Rasters to result files, merges of folders, and overviews."""

import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from boleflow import batch, cli, run
from boleflow.config import Config
from boleflow.operators import connect, mosaic
from boleflow.operators.segment import PixelSegmenter
from boleflow.sources import gpkg, raster


def bars(tmp_path):
    """Two bright bars on a dark ground, both over a seam and, as stems are, within the tiles' overlap."""
    img = np.full((240, 320, 3), 10, np.uint8)
    img[60:66, 80:190] = 250
    img[100:220, 50:56] = 250
    path = str(tmp_path / "field.tif")
    raster.write(path, img, 0.05, 0.05, (1000.0, 2000.0))
    return path


SMALL = Config(tile_size=4.0, img_width=80, overlap_pred=8, tile_inner_px=128, tile_overlap_m=6.0)
BRIGHT = PixelSegmenter([8.0, 0.0, 0.0], -4.0)


@pytest.mark.parametrize("method", ["contour", "edt"])
def test_raster_to_layers(spark, tmp_path, method):
    path, mask = bars(tmp_path), str(tmp_path / "field_roi_stem_map.tif")
    c = Config(**{**SMALL.to_dict(), "diameter_method": method})
    out = run.analyse_raster(spark, BRIGHT, path, mask, str(tmp_path / "field"), "Nodes", c)
    i = raster.info(mask)
    m = raster.read_window(i, 0, 0, i.height, i.width)[..., 0]
    assert set(np.unique(m)) == {0, 1} and m[62, 90:180].all() and not m[80].any()
    stems = gpkg.read(spark, out, "stems").collect()
    lengths = sorted(s["length"] for s in stems)
    assert len(stems) == 2 and abs(lengths[0] - 5.4) < 0.8 and abs(lengths[1] - 5.9) < 0.8
    assert all(1000 <= p["x"] <= 1016 and 1988 <= p["y"] <= 2000 for s in stems for p in s["path"])
    assert gpkg.read(spark, out, "nodes").count() == sum(len(s["path"]) for s in stems) == gpkg.read(spark, out, "vectors").count()
    d = [r["d"] for r in gpkg.read(spark, out, "nodes").collect()]
    assert 0.2 < float(np.median(d)) < 0.45


def test_no_stems_no_file(spark, tmp_path):
    img = np.full((100, 100, 3), 10, np.uint8)
    path = str(tmp_path / "dark.tif")
    raster.write(path, img, 0.05, 0.05)
    assert run.analyse_raster(spark, BRIGHT, path, str(tmp_path / "m.tif"), str(tmp_path / "dark"), "Trees", SMALL) is None
    assert not (tmp_path / "dark.gpkg").exists()
    with pytest.raises(ValueError):
        run.analyse_raster(spark, BRIGHT, path, "", "", "Leaves", SMALL)


def layer_file(path, stems):
    gpkg.write(str(path), {"stems": (["stem_id", "d_json"], [(i, str([0.3] * len(p)), p) for i, p in enumerate(stems)])})


def test_merge_folder(spark, tmp_path):
    for name, x in (("a", 0.0), ("b", 10.0)):
        raster.write(str(tmp_path / f"{name}_roi_stem_map.tif"), np.zeros((100, 100), np.uint8), 0.1, 0.1, (x, 10.0))
    layer_file(tmp_path / "a_trees.gpkg", [[(6.0, 5.0), (8.0, 5.0), (9.8, 5.0)], [(3.0, 3.0), (5.0, 3.0), (7.0, 3.0)]])
    (tmp_path / "deep").mkdir()
    layer_file(tmp_path / "deep" / "b_trees.gpkg", [[(10.2, 5.0), (12.0, 5.0), (14.0, 5.0)]])
    out, n = run.merge_folder(spark, str(tmp_path))
    assert n == 2 and out == batch.default_output(str(tmp_path))
    rows = sorted((r["stem_id"], [(p["x"], p["y"]) for p in r["path"]]) for r in gpkg.read(spark, out, "stems").collect())
    assert rows == [(0, [(3.0, 3.0), (5.0, 3.0), (7.0, 3.0)]), (1, [(6.0, 5.0), (8.0, 5.0), (12.0, 5.0), (14.0, 5.0)])]
    layer_file(tmp_path / "a_more.gpkg", [])
    with pytest.raises(RuntimeError):
        run.discover(str(tmp_path))


def test_empty_folder_and_misuse(spark, tmp_path, capsys):
    assert cli.main(["merge", str(tmp_path)], spark) == 0
    assert not list(tmp_path.iterdir())
    for bad in ([], ["run", "a"], ["run", "a", "b", "c", "d", "Leaves"], ["merge"], ["merge", "x", "--edge-buffer-m", "wide"], ["merge", "x", "--odd", "1"]):
        assert cli.main(bad, spark) == batch.MISUSE
    assert cli.main(["run", "model.txt", "a", "b", "c", "Trees"], spark) == batch.FAILED


def test_unframed_tiles_keep_all(spark, tmp_path):
    layer_file(tmp_path / "raster_x.gpkg", [[(0.0, 0.0), (0.0, 3.0)], [(0.0, 3.5), (0.0, 6.0)]])
    assert run.discover(str(tmp_path)) == [("x", str(tmp_path / "raster_x.gpkg"), None)]
    assert run.merge_folder(spark, str(tmp_path))[1] == 2


def test_groups_give_what_one_group_gives(spark):
    """Random stems of three points or more: connecting by components is connecting all at once."""
    rng = random.Random(7)
    stems = []
    for i in range(220):
        x, y, turn, step = rng.uniform(0, 160), rng.uniform(0, 160), rng.gauss(0, 0.05), rng.uniform(1, 2.5)
        stems.append((i, [(x + turn * step * k, y + step * k) for k in range(rng.randint(3, 8))], [0.2] * 0))
    rows = [(i, [{"x": a, "y": b} for a, b in p], d) for i, p, d in stems]
    df = spark.createDataFrame(rows, "stem_id long, path array<struct<x:double,y:double>>, diameters array<double>")
    c = Config()
    grouped = connect.seam_groups(df, c)
    assert grouped.count() == 220 and 1 < grouped.select("group_id").distinct().count() < 220
    points = lambda d: sorted(tuple((p["x"], p["y"]) for p in r["path"]) for r in d.collect())
    apart, together = points(connect.connect_groups(grouped, c)), points(connect.connect_groups(df.withColumn("group_id", F.lit(0).cast("long")), c))
    assert apart == together and len(apart) < 220


def test_overviews(spark, tmp_path):
    rng = np.random.default_rng(3)
    full = (rng.integers(1, 255, (64, 96)).astype(np.uint8) // 8 * 8).clip(1)
    half = full[::2, ::2]
    cut = lambda m: [raster.packed(np.pad(m, ((0, -m.shape[0] % 32), (0, -m.shape[1] % 32)))[r : r + 32, c : c + 32]) for r in range(0, m.shape[0], 32) for c in range(0, m.shape[1], 32)]
    path = str(tmp_path / "o.tif")
    raster.write_tiled(path, [(96, 64, cut(full)), (48, 32, cut(half))], 0.1, 0.1, (5.0, 9.0), side=32)
    i = raster.info(path)
    assert (i.width, i.height, len(i.overviews), round(i.overviews[0].px, 9), i.origin_x) == (96, 64, 1, 0.2, 5.0)
    assert (raster.read_window(i, 0, 0, 64, 96)[..., 0] == full).all()
    assert (raster.read_scaled(i, 0, 0, 32, 32, 16)[..., 0] == half[:16, :16]).all()  # no resampling needed
    assert not raster.read_scaled(i, 64, 0, 32, 32, 16).any()
    spark.dataSource.register(raster.RasterSource)
    df = spark.read.format("boleflow_raster").option("path", path).option("tile", 32).option("readStrategy", "overview").option("size", 16).load()
    r = df.filter("tile_id = 1").first()
    assert (r["height"], r["px"]) == (16, 0.2) and (np.frombuffer(r["pixels"], np.uint8).reshape(16, 16) == half[:16, 16:32]).all()
    assert raster.rasters(spark, [path]).first()["n_overviews"] == 1


def test_mosaic(spark, tmp_path):
    rng = np.random.default_rng(5)
    m = np.zeros((70, 90), np.uint8)
    m[:30] = rng.random((30, 90)) < 0.2
    rows = [(int(r), int(c)) for r, c in np.argwhere(m)] + [(69, 95), (75, 3)]
    for how in ("DEFLATE", "none", "odd"):
        path = str(tmp_path / f"{how}.tif")
        mosaic.write(path, spark.createDataFrame(rows, "row long, col long"), 90, 70, 0.1, 0.1, (0.0, 7.0), how, 32)
        assert (raster.read_window(raster.info(path), 0, 0, 70, 90)[..., 0] == m).all()
    with pytest.raises(ValueError):
        raster.compression_of("lzw")


def test_layer_reads_in_ranges(spark, tmp_path):
    path = str(tmp_path / "many.gpkg")
    gpkg.write(path, {"stems": (["stem_id", "note"], [(i, None if i % 2 else "x", [(float(i), 0.0), (i + 1.0, 0.0)]) for i in range(25)])})
    df = gpkg.read(spark, path, "stems", rows=10)
    assert df.rdd.getNumPartitions() == 3 and sorted(r["stem_id"] for r in df.collect()) == list(range(25))
    assert sqlite3.connect(path).execute("SELECT count(*) FROM stems").fetchone() == (25,)
