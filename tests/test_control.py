"""Registry, planning, progress (batch and stream) and batch runs."""

import json

import pandas as pd
import pytest

from boleflow import batch
from boleflow.plans import execution, registry
from boleflow.sources.adapters import view
from boleflow.streaming import progress


def spec(family, precision, lossless=False, hidden=False):
    return {"url": "https://example.org/m.onnx", "file": f"{family}_{precision}.onnx", "family": family, "precision": precision, "lossless": lossless, "hidden": hidden}


TEXT = json.dumps(
    {
        "schema": 2,
        "families": {"Spruce": {"label": "S", "default": "s32"}, "Beech": {"label": "B", "default": "b32"}},
        "models": {"s32": spec("Spruce", "fp32"), "s8": spec("Spruce", "int8"), "s16": spec("Spruce", "fp16", True), "b32": spec("Beech", "fp32", hidden=True)},
        "recommended": ["s8"],
    }
)


def test_resolution():
    r = registry.parse(TEXT)
    got = [r.resolve(*a).id for a in (("Spruce", "cpu"), ("spruce", "gpu"), ("Beech", "cpu"), ("S8", "gpu"), ("Spruce", "cpu", "auto"), ("Spruce", "gpu", "auto"), ("Spruce", "cpu", "fp32"))]
    assert got == ["s8", "s16", "b32", "s8", "s32", "s16", "s32"]
    assert [m.id for m in r.visible()] == ["s32", "s8", "s16"] and r.default("gpu").id == "s16"
    for args, error in ((("Oak",), KeyError), (("Beech", "cpu", "int8"), KeyError), (("Beech", "cpu", "odd"), ValueError)):
        with pytest.raises(error):
            r.resolve(*args)


def test_flat_registry_and_errors():
    assert registry.parse('{"A": "https://x/y.onnx?z"}').models["A"].file == "A.onnx"
    for bad in ("{}", '{"schema": 2}', '{"schema": 2, "models": {"a": {"url": "ftp://x", "file": "f"}}}'):
        with pytest.raises(ValueError):
            registry.parse(bad)


def test_verified(tmp_path):
    f = tmp_path / "m"
    f.write_bytes(b"abc")
    good = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert registry.verified(str(f), good.upper()) and not registry.verified(str(f), "0" * 64) and not registry.verified(str(f) + "x", "")


def test_plan():
    p = execution.plan(5.0, 5000, "Nodes", 16, 8.0)
    assert p.large and p.huge and p.shuffle_partitions == 1250
    assert execution.plan(0.1, 3, "Stems", 8, 2.0).notes
    assert execution.output_layers("Nodes") == ["stems", "vectors", "nodes"] and execution.output_layers("Stems") == []


def test_progress_bands():
    lines = pd.Series(["boot", "Written tile 1/2 | x", "Written tile 2/2 | x", "Prepared 2/4 vector tiles", "Vector tiles 4/4 | x", "Written tile 1/2 | x", "MERGE TILE READ | tile a", "MERGE TILE READ | tile b"])
    want = [0, 29, 57, 57, 95, 95, 97, 99]
    assert progress.advance(lines)[0].tolist() == want
    state, got = (0, 0, 0), []
    for at in range(0, 8, 3):  # in pieces, with the state kept
        percent, state = progress.advance(lines[at : at + 3], state)
        got += percent.tolist()
    assert got == want and progress.final(99, False) == 99 and progress.final(99, True) == 100


def test_stream_equals_batch(spark, tmp_path):
    lines = view(spark, "/root/testdata/sf0.001", "log_lines").select("run_id", "line_no", "line")
    want = {r["run_id"]: r["p"] for r in progress.percentages(lines).groupBy("run_id").agg({"percent": "max"}).toDF("run_id", "p").collect()}
    parts = [lines.filter(f"line_no >= {a} AND line_no < {b}") for a, b in ((0, 300), (300, 700), (700, 10**9))]
    for k, p in enumerate(parts):
        p.coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = progress.stream_percentages(stream).writeStream.format("memory").queryName("p").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.sql("SELECT run_id, max(percent) AS p FROM p GROUP BY run_id").collect()
    assert {r["run_id"]: r["p"] for r in rows} == want


def test_one_failure_does_not_stop_others():
    seen = []

    def run(p):
        seen.append(p)
        if "boom" in p:
            raise RuntimeError("no")

    failed = batch.process(["a", "boom", "c"], run, 2)
    assert sorted(seen) == ["a", "boom", "c"] and list(failed) == ["boom"] and batch.exit_code(failed) == 1 and batch.exit_code({}) == 0
