"""Progress of runs from their log lines, in batch and as a stream.

A line moves its run's percentage within the band of its phase; the percentage never
falls and stays below 100 until the run ends. In batch that is a running maximum over
each run's lines; as a stream the same state is kept for each run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..shipping import shipped

# Line formats, band ends, and marks of a failed accelerator.
PREDICT = r"^\s*(?:Written tile|Multi-GPU prediction) (\d+)/(\d+) \|"
VECTOR = r"^\s*Vector tiles (\d+)/(\d+) \|"
PREPARED = r"^\s*Prepared (\d+)/(\d+) vector tiles"
MERGE = r"^\s*MERGE TILE READ \| tile "
SETUP_END = 2
BANDS = {"Stems": (99, 99, 99), "Trees": (57, 95, 99), "Nodes": (57, 95, 99)}
MOST = 99
DEVICE_MARKS = ["cudnn", "cublas", "cufft", "curand", "cusparse", "cuda error", "cudaerror", "cuda_error"]
MEMORY_MARKS = ["out of memory", "failed to allocate memory"]


def phases(kind: str) -> list[tuple[str, int, int]]:
    """(line format, first and last percent) of what moves a run; batch and stream both go by this table."""
    ends = (SETUP_END, *BANDS[kind])
    return [(pattern, ends[k], ends[k + 1]) for k, pattern in enumerate((PREDICT, VECTOR, MERGE))]


def device_failed(line: Column) -> Column:
    """Whether a line tells of a failed accelerator; lack of memory is none."""
    low = F.lower(line)
    return low.rlike("|".join(DEVICE_MARKS)) & ~low.rlike("|".join(MEMORY_MARKS))


def percentages(lines: DataFrame, kind: str = "Trees") -> DataFrame:
    """lines (run_id, line_no, line) with percent, the run's progress after each line."""
    so_far = Window.partitionBy("run_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)

    def number(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract("line", pattern, group), F.lit("")).cast("long")

    told = F.last(number(PREPARED, 1), ignorenulls=True).over(so_far)
    d = lines.withColumns({"__told": F.coalesce(told, F.lit(0).cast("long")), "__seen": F.count_if(F.col("line").rlike(MERGE)).over(so_far)})
    value = F.lit(0).cast("long")
    for pattern, low, high in phases(kind):
        done, total = (F.col("__seen"), F.col("__told")) if pattern == MERGE else (number(pattern, 1), number(pattern, 2))
        share = F.when(total > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), done / total.cast("double")))).otherwise(F.lit(0.0))
        value = F.when(F.col("line").rlike(pattern), F.floor(F.lit(float(low)) + F.lit(float(high - low)) * share).cast("long")).otherwise(value)
    return d.withColumn("percent", F.max(F.least(F.lit(MOST).cast("long"), value)).over(so_far)).drop("__told", "__seen")


#: (percent, vector tiles that the run has told of, tiles merged): what a stream keeps of a run.
State = tuple[int, int, int]


def advance(lines: pd.Series, state: State = (0, 0, 0), kind: str = "Trees") -> tuple[pd.Series, State]:
    """The percent after each of a run's further lines, and the state after the last; by columns, as percentages() does."""
    told = lines.str.extract(PREPARED)[0].astype(float).ffill().fillna(state[1])
    seen = lines.str.match(MERGE).cumsum() + state[2]
    value = pd.Series(0.0, lines.index)
    for pattern, low, high in phases(kind):
        counted = pd.DataFrame({0: seen, 1: told}) if pattern == MERGE else lines.str.extract(pattern).astype(float)
        share = (counted[0] / counted[1].where(counted[1] > 0)).clip(0, 1).fillna(0)
        value = value.mask(lines.str.match(pattern), np.floor(low + (high - low) * share))
    percent = value.clip(upper=MOST).cummax().clip(lower=state[0]).astype(int)
    return percent, (int(percent.iloc[-1]), int(told.iloc[-1]), int(seen.iloc[-1]))


def final(percent: int, succeeded: bool) -> int:
    """What a run shows when it has ended."""
    return 100 if succeeded else percent


def stream_percentages(lines: DataFrame, kind: str = "Trees") -> DataFrame:
    """A stream of lines (run_id long, line_no long, line string): each run's percent after each batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("line_no")
        percent, kept = advance(rows["line"], state.get if state.exists else (0, 0, 0), kind)
        state.update(kept)
        yield pd.DataFrame({"run_id": [key[0]], "line_no": [int(rows["line_no"].max())], "percent": [int(percent.iloc[-1])]})

    return shipped(lines).groupBy("run_id").applyInPandasWithState(step, "run_id long, line_no long, percent long", "percent long, told long, seen long", "update", GroupStateTimeout.NoTimeout)
