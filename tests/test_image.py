"""Skeletons, distances, contours, resampling and the raster and layer files."""

import duckdb
import numpy as np
import pytest

from boleflow.operators import pipeline, segment, skeleton
from boleflow.plans.oracles import ORACLES
from boleflow.plans.queries import QUERIES
from boleflow.sources import gpkg, raster


def bar(h=30, w=60, r0=12, r1=17, c0=5, c1=55):
    m = np.zeros((h, w), bool)
    m[r0:r1, c0:c1] = True
    return m


def test_a_bar_becomes_one_line():
    t = skeleton.thin(bar())
    assert (t & ~bar() == 0).all() and len(skeleton.trace(t, 3)) == 1
    assert set(np.argwhere(t)[:, 0]) == {14}


def test_a_crossing_falls_into_four():
    m = bar(60, 60, 28, 31, 4, 56) | bar(60, 60, 28, 31, 4, 56).T
    t = skeleton.without_branches(skeleton.without_blocks(skeleton.thin(m)))
    assert len(skeleton.trace(t, 5)) == 4


def test_a_ring_is_one_loop():
    m = np.zeros((20, 20), bool)
    m[4, 4:15] = m[14, 4:15] = True
    m[4:15, 4] = m[4:15, 14] = True
    m[4, 4] = m[4, 14] = m[14, 4] = m[14, 14] = False
    (loop,) = skeleton.trace(m, 3)
    assert loop[0] == loop[-1] and len(set(loop)) == m.sum()


def test_every_link_is_in_one_chain():
    rng = np.random.default_rng(7)
    m = rng.random((16, 16)) < 0.4
    links = {frozenset((tuple(map(int, p)), q)) for p in np.argwhere(m) for q in skeleton.neighbours(m, tuple(map(int, p)))}
    walked = [frozenset(e) for c in skeleton.trace(m, 0) for e in zip(c, c[1:])]
    assert len(walked) == len(set(walked)) and set(walked) == links


def test_a_turn_is_split():
    chain = [(0, c) for c in range(30)] + [(r, 29 + r) for r in range(1, 30)]
    pieces = skeleton.refine(chain, 5, 3)
    assert len(pieces) > 1 and pieces[0][0] == chain[0] and pieces[-1][-1] == chain[-1]
    assert all(a[-1] == b[0] for a, b in zip(pieces, pieces[1:], strict=False))
    assert max(len(p) for p in pieces if p[0][0] > 0) > 3  # the straight part after the turn stays whole
    assert skeleton.refine([(0, c) for c in range(30)], 5, 3)[0][-1] == (0, 29)


def test_distance_is_exact():
    m = np.random.default_rng(2).random((24, 31)) < 0.85
    m[0, 0] = False
    away = np.argwhere(~m)
    got = skeleton.distance_to_background(m, 0.5, 0.25)
    for r, c in np.argwhere(m):
        assert abs(got[r, c] - np.sqrt((((away - (r, c)) * (0.5, 0.25)) ** 2).sum(1)).min()) < 1e-9


def test_contour_diameter_is_the_bars_height():
    lines = np.array([[5.0, 20.5, 25.0, 20.5], [5.0, 58.0, 25.0, 58.0]])
    d = skeleton.contour_diameters(bar(), lines, np.array([[14.5, 20.5], [14.5, 58.0]]))
    assert d.tolist() == [5.0, 0.0]


def test_corners_do_not_join():
    m = np.zeros((8, 8), bool)
    m[2, 2] = m[3, 3] = True
    assert skeleton.components(m)[2, 2] != skeleton.components(m)[3, 3]
    d = skeleton.contour_diameters(m, np.array([[1.0, 1.0, 5.0, 5.0]]), np.array([[2.5, 2.5]]))
    assert abs(d[0] - np.sqrt(2)) < 1e-9


def test_measured_bars(spark):
    rows = [(0, int(r), int(c)) for r, c in np.argwhere(bar(40, 90, 12, 18, 5, 85))]
    pixels = spark.createDataFrame(rows, "tile_id long, r long, c long")
    stems = pipeline.stems_of_tiles(pixels, 0.1)
    assert stems.count() == 1
    m = pipeline.measured(stems, pixels, 0.1).first()
    assert 6.5 < m["length"] < 8.1 and 0.5 < m["volume"] / (np.pi / 4 * 0.6**2 * m["length"]) < 1.1


def test_resize_keeps_sums_and_masks():
    w = segment.cubic_matrix(70, 51)
    assert np.allclose(w.sum(1), 1)
    x = np.random.default_rng(0).random((2, 70, 70, 3)).astype(np.float32)
    assert segment.resize(x, 51).shape == (2, 51, 51, 3) and segment.resize(x, 70) is x
    mask = np.zeros((1, 20, 20, 1))
    mask[:, :10] = 1
    assert set(np.unique(segment.resize(mask, 8, cubic=False))) == {0, 1}


def test_scores_on_the_threshold_are_as_in_sql(spark, tmp_path):
    """Tile 1966 of sf0.1 has a sum of a half, which added by rows and columns is just below it, as SQL adds over whole tables (over few rows
    its plan is another, and so is its sum). Bytes of scores of -0.00125 less a little depend on the width of floats."""
    duck, path = duckdb.connect(), f"{tmp_path}/embeddings.parquet"
    edge = "list_resize([]::FLOAT[], 64, -0.001250001::FLOAT)"
    duck.execute(f"COPY (SELECT vec_id, embedding FROM '/root/testdata/sf0.1/embeddings.parquet' WHERE vec_id = 1966 UNION ALL SELECT 1, {edge}) TO '{path}'")
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    got = {tuple(r) for r in QUERIES["segment_tiles"](spark, str(tmp_path)).collect()}
    assert got == set(duck.execute(ORACLES["segment_tiles"]).fetchall()) - {(1966, 4, 0)}
    assert (1966, 4, 0) not in got and (1, 0, 0) in got


@pytest.mark.parametrize(("limit", "n"), [(4, 8), (1, 8), (3, 16), (2, 5)])
def test_lack_of_memory_keeps_order(limit, n):
    def score(x):
        if len(x) > limit:
            raise RuntimeError("failed to allocate memory")
        return x * 2

    assert segment.adaptive(score, np.arange(n)).tolist() == [2 * i for i in range(n)]


def test_strategies():
    assert segment.strategy(None) == "graph" == segment.strategy("onnx_gpu")
    for name, error in (("cupy", RuntimeError), ("nonsense", ValueError)):
        with pytest.raises(error):
            segment.strategy(name)


def test_raster_source(spark, tmp_path):
    img = np.random.default_rng(42).integers(1, 255, (70, 90, 3), dtype=np.uint8)
    path = str(tmp_path / "a.tif")
    raster.write(path, img, 0.05, 0.05, (400000.0, 5900000.0), rows=16)
    i = raster.info(path)
    assert (i.width, i.height, i.bands, i.origin_x, i.origin_y) == (90, 70, 3, 400000.0, 5900000.0)
    edge = raster.read_window(i, 60, 80, 30, 30)
    assert (edge[:10, :10] == img[60:, 80:]).all() and not edge[10:].any() and not edge[:, 10:].any()
    spark.dataSource.register(raster.RasterSource)
    df = spark.read.format("boleflow_raster").option("path", str(tmp_path)).option("tile", 32).option("tilesPerPartition", 2).load()
    rows = df.collect()
    assert len(rows) == 9 and df.rdd.getNumPartitions() == 5
    for r in rows:
        w = np.frombuffer(r["pixels"], np.uint8).reshape(32, 32, 3)
        part = img[r["row_off"] : r["row_off"] + 32, r["col_off"] : r["col_off"] + 32]
        assert (w[: part.shape[0], : part.shape[1]] == part).all()
    seg = segment.segment_tiles(df, segment.PixelSegmenter([4.0, 0.0, 0.0], -2.0), segment.Config(img_width=32, overlap_pred=8))
    assert 0 < seg.count() < 9 * 24 * 24


def test_layers_round_trip(spark, tmp_path):
    path = str(tmp_path / "x.gpkg")
    layers = {"tree": (["stem_id", "length", "d_json"], [(1, 2.5, "[1.0]", [(0.0, 0.0), (2.0, 1.5)])]), "nodes": (["stem_id", "node"], [(1, 0, [(0.0, 0.0)])])}
    assert gpkg.write(path, layers, 32633) == path
    s = gpkg.read(spark, path, "stems").first()
    assert (s["stem_id"], s["length"], s["d_json"], [tuple(p) for p in s["path"]]) == (1, 2.5, "[1.0]", [(0.0, 0.0), (2.0, 1.5)])
    assert gpkg.read(spark, path, "nodes").count() == 1 and gpkg.read(spark, path, "vectors").count() == 0
