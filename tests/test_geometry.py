"""Connection, duplicates and measurement on small hand-made stems, and against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from boleflow.config import Config, merge_overrides, with_overrides
from boleflow.functions import geometry as g
from boleflow.operators import connect, layers, merge, quantify, tiling
from boleflow.plans.queries import QUERIES


def test_collinear_pair_becomes_one_stem(spark):
    a = (np.array([[0.0, 0], [1, 0], [2, 0]]), [0.30, 0.28, 0.26])
    b = (np.array([[3.0, 0], [4, 0], [5, 0]]), [0.24, 0.22, 0.20])
    done = connect.connect([b, a])
    assert len(done) == 1
    path, d = done[0]
    assert path.tolist() == [[0, 0], [1, 0], [4, 0], [5, 0]]
    assert d == [0.30, 0.28, 0.22, 0.20]


def test_unmeasured_parent_gives_no_diameters():
    a = (np.array([[0.0, 0], [1, 0], [2, 0]]), [])
    b = (np.array([[3.0, 0], [4, 0], [5, 0]]), [0.24, 0.22, 0.20])
    assert connect.connect([a, b])[0][1] == []


def test_groups_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        p = rng.uniform(0, 30, 2)
        v = np.array([1.0, 0.05]) * rng.uniform(0.5, 1.5)
        rows.append((i % 3, [(float(x), float(y)) for x, y in (p + k * v for k in range(4))], []))
    df = spark.createDataFrame(rows, "group_id long, path array<struct<x:double,y:double>>, diameters array<double>")
    one = sorted(map(str, connect.connect_groups(df.repartition(1)).collect()))
    many = sorted(map(str, connect.connect_groups(df.repartition(7)).collect()))
    assert one == many


def test_duplicates_against_all_pairs():
    rng = np.random.default_rng(1234)
    paths = []
    for _ in range(120):
        p, a, n = rng.uniform(0, 12, 2), rng.uniform(0, 2 * np.pi), rng.uniform(0.2, 5)
        q = p + n * np.array([np.cos(a), np.sin(a)])
        paths.append(np.array([p, q]))
        if rng.random() < 0.4:
            paths.append(np.array([p + 0.2 * (q - p), p + 0.7 * (q - p)]))
    order = sorted(range(len(paths)), key=lambda i: -connect.length(paths[i]))
    kept = []
    for i in order:
        # straight stems: inside a convex capsule if both ends are
        if not any(connect.distance_to_path(paths[i], paths[j]).max() <= 0.3 for j in kept):
            kept.append(i)
    assert connect.without_duplicates(paths, 0.3) == kept and len(kept) < len(paths)


def test_merged_diameters(spark):
    df = spark.createDataFrame([([0.30, 0.28, 0.26], [0.26, 0.24, 0.22], 3)], "a array<double>, b array<double>, n int")
    full = df.select(g.merged_diameters(F.col("a"), F.col("n"), F.col("b"), F.col("n")).alias("d")).first()["d"]
    none = df.select(g.merged_diameters(F.col("a"), F.col("n") + 1, F.col("b"), F.col("n")).alias("d")).first()["d"]
    assert (full, none) == ([0.30, 0.28, 0.24, 0.22], [])


@pytest.mark.parametrize(
    ("box", "bounds", "want"),
    [
        ((100, 100, 200, 200), (0, 0, 1000, 1000), (102, 102, 198, 198)),
        ((0, 0, 100, 100), (0, 0, 1000, 1000), (0, 0, 98, 98)),
        ((0, 300, 100, 400), (0, 0, 1000, 1000), (0, 302, 98, 398)),
        ((0, 0, 1000, 1000), (0, 0, 1000, 1000), (0, 0, 1000, 1000)),
        ((0, 0, 1000, 1000), None, (2, 2, 998, 998)),
        ((0, 0, 3, 3), None, (0, 0, 3, 3)),
    ],
)
def test_keep_region(spark, box, bounds, want):
    whole = tuple(F.lit(float(v)) for v in bounds) if bounds else None
    cols = merge.keep_region(*(F.lit(float(v)) for v in box), 2.0, whole)
    assert tuple(spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()) == want


def test_path_meets_a_box_between_its_nodes(spark):
    df = spark.createDataFrame([(1, [(0.0, 0.0), (10.0, 10.0)]), (2, [(0.0, 5.0), (1.0, 9.0)]), (3, [(4.0, 0.0), (4.0, 9.0)])], "id int, path array<struct<x:double,y:double>>")
    box = df.withColumns({"kx0": F.lit(4.0), "ky0": F.lit(4.0), "kx1": F.lit(5.0), "ky1": F.lit(5.0)})
    assert sorted(r["id"] for r in box.filter(merge.path_meets()).collect()) == [1, 3]


def test_clean_diameters_is_a_fold(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for s in range(40):
        n = int(rng.integers(1, 12))
        xy, d = rng.uniform(0, 9, (n, 2)), rng.choice([0.2, 0.21, 0.22, 0.9], n, p=[0.3, 0.3, 0.2, 0.2])
        rows += [(s, i, float(xy[i, 0]), float(xy[i, 1]), float(d[i])) for i in range(n)]
        q1, q3 = np.quantile(d, [0.25, 0.75])
        far = lambda v, q1=q1, q3=q3: v > q3 + 1.5 * (q3 - q1) or v < q1 - 1.5 * (q3 - q1)
        c = d.tolist()
        if n > 4:
            for i in range(1, n - 2):
                if far(c[i]):
                    span = lambda a, b: float(np.hypot(*(xy[a] - xy[b])))
                    c[i] = (c[i - 1] * span(i, i + 1) + c[i + 1] * span(i - 1, i)) / span(i - 1, i + 1)
            c[0], c[-1] = (c[1] if far(c[0]) else c[0]), (c[-2] if far(c[-1]) else c[-1])
        want |= {(s, i): c[i] for i in range(n)}
    df = spark.createDataFrame(rows, "stem_id long, node long, x double, y double, d double")
    got = {(r["stem_id"], r["node"]): r["d"] for r in quantify.clean_diameters(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_quartiles_to_the_last_bit(spark):
    """Limits fall on values that occur: 0.4, the largest of the first stem (32906 at sf0.1), is an outlier in SQL by its last bit."""
    rng = np.random.default_rng(6)
    stems = [[0.07, 0.13, 0.14, 0.14, 0.16, 0.2, 0.37, 0.4], *[(rng.integers(1, 51, n) / 100).tolist() for n in rng.integers(1, 14, 400)]]
    rows = [(s, i, float(i), 0.0, d) for s, ds in enumerate(stems) for i, d in enumerate(ds)] + [(0, 8, 8.0, 0.0, None), (999, 0, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "stem_id long, node long, x double, y double, d double")
    got = {r["stem_id"]: (r["q1"], r["q3"]) for r in quantify.quartiles(df).collect()}
    assert got.pop(999) == (None, None)
    for s, ds in enumerate(stems):
        at = [divmod((len(ds) - 1) * q, 1) for q in (0.25, 0.75)]
        assert got[s] == tuple(math.fma(sorted(ds)[int(i)], 1 - t, t * sorted(ds)[min(int(i) + 1, len(ds) - 1)]) for i, t in at)
    last = quantify.clean_diameters(df.filter("stem_id = 0 AND d IS NOT NULL")).orderBy("node").collect()[-1]
    assert last["d"] == 0.37


def test_shards_are_ranges(spark):
    """Ranges are those of the jobs one by one, also where a raster comes twice; and a raster of more tiles than can be listed has its seven."""
    totals = spark.createDataFrame([(i, t) for i, t in enumerate([0, 1, 2, 5, 7, 8, 100, 1001])] + [(7, 30)], "raster_id long, total long")
    for n in (1, 2, 7, 10):  # halves of 1, 5 and 1001 are ties
        jobs = totals.filter("total > 0").select("raster_id", "total", F.explode(F.expr("sequence(0L, total - 1)")).alias("tile_index"))
        one_by_one = tiling.job_shards(jobs, n, F.col("total")).groupBy("raster_id", "shard").agg(F.min("tile_index"), F.count("*"))
        assert sorted(map(tuple, tiling.shard_ranges(totals, n).collect())) == sorted(map(tuple, one_by_one.collect()))
    huge = tiling.shard_ranges(spark.createDataFrame([(1, 7 * 10**12)], "raster_id long, total long"), 7)
    assert sorted(map(tuple, huge.collect())) == [(1, i, i * 10**12, 10**12) for i in range(7)]


def test_no_query_lists_jobs_for_their_shards(spark):
    plan = QUERIES["job_shards"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate") == 1  # one row a shard, none a tile


def test_numbered_is_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = sorted((r["stem_id"], r["k"]) for r in layers.numbered(df, [F.col("k")]).collect())
    assert got == [(i, i) for i in range(1000)]


def test_overrides():
    c = with_overrides(Config(), '{"min_length": 3.5, "unknown": 1}')
    assert c.min_length == 3.5 and with_overrides(Config(), None) == Config()
    assert merge_overrides('{"a": 1}', {"a": 2, "b": 3}) == '{"a": 1, "b": 3}'
    with pytest.raises(ValueError):
        with_overrides(Config(), "[1]")
