"""Masks of whole rasters out of tiles' cores: packed block by block on executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.raster import compression_of, packed, write_tiled
from .groups import map_groups, spans

SIDE = 512


def blocks(pixels: DataFrame, width: int, compression: str = "DEFLATE", side: int = SIDE) -> DataFrame:
    """Set pixels (row, col) of one raster to its packed blocks (block, data); empty blocks are left out."""
    across = -(-width // side)
    keyed = pixels.select((F.floor(F.col("row") / side) * across + F.floor(F.col("col") / side)).cast("long").alias("block"), (F.col("row") % side).cast("int").alias("r"), (F.col("col") % side).cast("int").alias("c"))

    def run(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            key, r, c = (t.column(k).to_numpy() for k in ("block", "r", "c"))
            for first, end in spans(key):
                m = np.zeros((side, side), np.uint8)
                m[r[first:end], c[first:end]] = 1
                yield pa.RecordBatch.from_arrays([pa.array([key[first]], pa.int64()), pa.array([packed(m, compression)], pa.binary())], names=["block", "data"])

    return map_groups(keyed, "block", run, "block long, data binary")


def write(path: str, pixels: DataFrame, width: int, height: int, px: float, py: float, origin: tuple[float, float], compression: str | None = "DEFLATE", side: int = SIDE) -> None:
    """A mask as a tiled TIFF. Executors pack the blocks; the driver passes them on in order, a partition at a time."""
    how = compression_of(compression)
    empty, n = packed(np.zeros((side, side), np.uint8), how), -(-width // side) * -(-height // side)

    def every() -> Iterator[bytes]:
        at = 0
        for b in blocks(pixels.filter((F.col("row") < height) & (F.col("col") < width)), width, how, side).sort("block").toLocalIterator():
            yield from (empty for _ in range(at, b["block"]))
            yield bytes(b["data"])
            at = b["block"] + 1
        yield from (empty for _ in range(at, n))

    write_tiled(path, [(width, height, every())], px, py, origin, side, how)
