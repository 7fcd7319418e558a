"""Queries without an oracle read the whole tables."""

from pyspark.sql import functions as F

from boleflow.operators import connect
from boleflow.plans import queries

DATA = "/root/testdata/sf0.001"


def test_connect_stems(spark):
    p = queries.stem_paths(spark, DATA).select(F.floor(F.col("stem_id") / 16).cast("long").alias("group_id"), "path", "diameters")
    assert p.count() > 1000
    want = connect.connect_groups(p, connect.Config(max_distance=2.0, tolerance_angle=30.0))
    got = queries.connect_stems(spark, DATA)
    assert got.select("group_id").distinct().count() > 80  # groups grow in number, not in size
    assert sorted(map(tuple, got.select("group_id", "stem_id", "n_nodes").collect())) == sorted(map(tuple, want.select("group_id", "stem_id", F.size("path")).collect()))
