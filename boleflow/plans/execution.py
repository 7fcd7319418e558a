"""Planning of a run: what a job's size and a cluster's size ask for."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

LADDER = ("Stems", "Trees", "Nodes")
# A job is large from these on.
LARGE_GB, LARGE_TILES, HUGE_TILES = 4.0, 800, 1200


def scenario(gpus: int) -> str:
    return "cpu_only" if gpus <= 0 else "single_gpu" if gpus == 1 else "multi_gpu"


def prediction_mode(backend: Column, gpus: Column) -> Column:
    """How tiles are scored, from the wish and the number of accelerators."""
    wish = F.lower(backend)
    many = F.when(wish == "single_gpu", "stream").otherwise("multi_gpu_stream")
    return F.when((wish == "cpu") | (gpus <= 0), "cpu_stream").when(gpus == 1, "stream").otherwise(many)


def output_kind(stem: Column, trees: Column, nodes: Column) -> Column:
    """The highest product asked for; it implies those below."""
    return F.when(nodes, "Nodes").when(trees, "Trees").otherwise("Stems")


def output_layers(kind: str) -> list[str]:
    return {"Nodes": ["stems", "vectors", "nodes"], "Trees": ["stems"]}.get(kind, [])


@dataclass(frozen=True)
class Plan:
    scenario: str
    large: bool
    huge: bool
    shuffle_partitions: int
    arrow_rows: int
    notes: list[str] = field(default_factory=list)

    def apply(self, spark: SparkSession) -> None:
        spark.conf.set("spark.sql.shuffle.partitions", self.shuffle_partitions)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", self.arrow_rows)


def plan(input_gb: float, tiles: int, kind: str, slots: int, executor_gb: float, gpus: int = 0) -> Plan:
    """Partitions such that each task holds some tiles; Arrow batches that fit a worker."""
    if kind not in LADDER:
        raise ValueError(f"unknown output {kind!r}")
    large = input_gb >= LARGE_GB or tiles >= LARGE_TILES
    huge = kind != "Stems" and (large or tiles >= HUGE_TILES)
    notes = []
    wanted = max(slots, tiles // 4 if huge else tiles // 16)
    partitions = max(1, min(wanted, max(tiles, 1)))
    if partitions < wanted:
        notes.append(f"partitions: {wanted} to {partitions}, there are no more tiles")
    rows = max(1, min(64, int(executor_gb * 1024 // 64)))
    if rows < 64:
        notes.append(f"arrow rows: 64 to {rows}, executors have {executor_gb:g} GB")
    return Plan(scenario(gpus), large, huge, partitions, rows, notes)
