"""What the training-data operators share: shipping code, durable tables, Arrow rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..tables import discard, materialise, shared_dir, sweep, written  # noqa: F401

#: Words of the contracts: runs without the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"

#: Bytes of one Arrow batch: bounds what a Python worker holds of very long texts.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 4000
#: Tasks of a stage; what is dealt to a task is held a piece at a time, so that this bounds no result.
MOST_TASKS = 100_000


def prepare(spark: SparkSession) -> None:
    """Let executors import this package, and bound the Arrow batches by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ship(spark)


def shards_for(spark: SparkSession, docs: DataFrame, per_shard: int = 16 << 20) -> int:
    """Shards of about per_shard text bytes each, at least the shuffle partitions.

    The size comes from Catalyst's estimate of the scan, which costs no job. Shards have a
    bounded size at every size of the input; tasks_for() says how many tasks share them.
    """
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:  # no statistics: keep the session's own count
        return least
    return min(max(least, size // per_shard), (1 << 31) - 1) if size < 1 << 60 else least


def tasks_for(spark: SparkSession, n: int) -> int:
    """Partitions for n units of work that a task takes one after the other: no more than a driver can schedule."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(n, MOST_TASKS))


_HELD: dict[str, object] = {}


def held(key: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps from one task to the next: one operator's tables at a time.

    Workers outlive stages; tables of an operator that runs no more would add to those
    of the next.
    """
    if key not in _HELD:
        _HELD.clear()
        release()
        _HELD[key] = make()
    return _HELD[key]


def whole_keys(batches: Iterator[pa.RecordBatch], key: str, rows: int = 1 << 17) -> Iterator[pa.Table]:
    """Tables of about so many rows out of batches sorted by key (a long), none of whose values is cut apart."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            t = pa.Table.from_batches(held)
            k = t.column(key).to_numpy()
            cut = int(np.searchsorted(k, k[-1]))  # the last value may go on
            if cut:
                yield t.slice(0, cut)
            held = t.slice(cut).to_batches()
            size = t.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def binary(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without a decoding pass."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def release() -> None:
    """Gives what a worker has freed back to the machine: workers outlive tasks, and executors share its memory."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library alone
    if trim:
        trim(0)


def tidy(fn: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """fn for applyInArrow, after which the worker keeps nothing, not even an earlier operator's tables."""

    def run(t: pa.Table) -> pa.Table:
        _HELD.clear()
        out = fn(t)
        release()
        return out

    return run


def tidy_pair(fn: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for two groups."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return tidy(lambda t: fn(t, b))(a)

    return run


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow after prepare()."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        release()

    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(text_col: str) -> "F.Column":
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))
