"""Groups of rows for Python, by Arrow: one exchange, one sort, no call for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import shipped


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables out of batches sorted by key (a long), none of whose groups is cut apart."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(batch.schema.get_field_index(key)).to_numpy()
        if held and held[0].column(held[0].schema.get_field_index(key))[0].as_py() != k[-1]:
            cut = int(np.searchsorted(k, k[-1]))
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def spans(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of equal keys."""
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True)


def map_groups(df: DataFrame, key: str, fn: Callable[[Iterator[pa.Table]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn over tables of whole groups. Rows meet by key, in as many tasks as the session's
    shuffles have: the count is said, as small rows can be much work."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(whole_groups(batches, key))

    return shipped(df).repartition(tasks, key).sortWithinPartitions(key).mapInArrow(run, schema)


def points(path: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All points (n, 2) of a column of paths, and where each path's begin (one more than paths)."""
    flat = path.values
    return np.stack([flat.field("x").to_numpy(zero_copy_only=False), flat.field("y").to_numpy(zero_copy_only=False)], 1), path.offsets.to_numpy()


def paths(rows: list[np.ndarray]) -> pa.ListArray:
    """A column of paths from arrays (n, 2)."""
    flat = np.concatenate([np.zeros((0, 2)), *rows])
    offsets = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["x", "y"]))
