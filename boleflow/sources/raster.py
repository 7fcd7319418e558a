"""A data source for striped or tiled TIFF rasters, without a native library.

spark.read.format("boleflow_raster").option("path", ...) gives windows, one input
partition for each run of windows, so that a raster of any size is read in parallel and
no task holds more than its windows. Compression none and deflate, predictor 1 and 2,
pixel-interleaved bands of 8 bits.
"""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.segment import resize, strategy
from ..shipping import shipped

TILES = "raster_path string, tile_id long, row_off long, col_off long, height int, width int, bands int, origin_x double, origin_y double, px double, py double, pixels binary"
# TIFF tags and type sizes.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, BANDS, ROWS, STRIP_SIZES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, SCALE, TIE = 322, 323, 324, 325, 33550, 33922
SUBFILE, GEO_KEYS = 254, 34735
# The GeoTIFF key of the model type, and its value for degrees.
MODEL_KEY, GEOGRAPHIC = 1024, 2
FORMATS = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 12: "d", 16: "Q"}


@dataclass(frozen=True)
class Info:
    path: str
    width: int
    height: int
    bands: int
    px: float
    py: float
    origin_x: float
    origin_y: float
    compression: int
    predictor: int
    block: tuple[int, int]
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    overviews: tuple[Info, ...] = ()
    geographic: bool = False

    @property
    def gigabytes(self) -> float:
        return self.width * self.height * self.bands / 2**30


def directories(path: str) -> list[dict[int, tuple]]:
    """Tags of all directories of a TIFF, classic or big."""
    out = []
    with open(path, "rb") as f:
        head = f.read(16)
        end = {b"II": "<", b"MM": ">"}.get(head[:2])
        kind = struct.unpack(end + "H", head[2:4])[0] if end else 0
        if kind not in (42, 43):
            raise ValueError(f"not a TIFF file: {path}")
        count, entry, pointer, room = ("H", "HHI4s", "I", 4) if kind == 42 else ("Q", "HHQ8s", "Q", 8)
        (at,) = struct.unpack(end + pointer, head[4:8] if kind == 42 else head[8:16])
        get = lambda code: struct.unpack(end + code, f.read(struct.calcsize("=" + code)))
        while at:
            f.seek(at)
            tags = {}
            for tag, of, n, raw in [get(entry) for _ in range(get(count)[0])]:
                code = FORMATS.get(of)
                if not code:
                    continue
                size = struct.calcsize("=" + code) * n
                if size > room:
                    here = f.tell()
                    f.seek(struct.unpack(end + pointer, raw)[0])
                    raw = f.read(size)
                    f.seek(here)
                tags[tag] = struct.unpack(end + code * n, raw[:size])
            out.append(tags)
            (at,) = get(pointer)
    return out


def info(path: str) -> Info:
    """Metadata of a TIFF's image and of its overviews (directories marked as reduced)."""
    found = directories(path)
    one = lambda tags, t, d: tags.get(t, (d,))[0]
    scale, tie = found[0].get(SCALE, (1.0, 1.0)), found[0].get(TIE, (0.0,) * 6)
    keys = found[0].get(GEO_KEYS, ())
    model = next((keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] == MODEL_KEY), 0)

    def image(tags: dict[int, tuple], scale: tuple, overviews: tuple[Info, ...]) -> Info:
        if any(b != 8 for b in tags.get(BITS, (8,))) or one(tags, COMPRESSION, 1) not in (1, 8, 32946) or one(tags, 284, 1) != 1:
            raise ValueError(f"unsupported TIFF layout: {path}")
        tiled = TILE_OFFSETS in tags
        block = (one(tags, TILE_HEIGHT, 0), one(tags, TILE_WIDTH, 0)) if tiled else (min(one(tags, ROWS, 1 << 30), one(tags, HEIGHT, 0)), one(tags, WIDTH, 0))
        return Info(path, one(tags, WIDTH, 0), one(tags, HEIGHT, 0), one(tags, BANDS, 1), scale[0], scale[1], tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], one(tags, COMPRESSION, 1), one(tags, PREDICTOR, 1), block, tags[TILE_OFFSETS if tiled else STRIPS], tags[TILE_SIZES if tiled else STRIP_SIZES], overviews, model == GEOGRAPHIC)

    reduced = [t for t in found[1:] if one(t, SUBFILE, 0) & 1 and not one(t, SUBFILE, 0) & 4]
    width = one(found[0], WIDTH, 0)
    return image(found[0], scale, tuple(image(t, (scale[0] * width / one(t, WIDTH, 1), scale[1] * width / one(t, WIDTH, 1)), ()) for t in reduced))


def read_window(i: Info, row: int, col: int, height: int, width: int) -> np.ndarray:
    """A window as (height, width, bands); what lies outside is 0. Only the blocks it meets are read."""
    out = np.zeros((height, width, i.bands), np.uint8)
    bh, bw = i.block
    across = -(-i.width // bw)
    with open(i.path, "rb") as f:
        for br in range(max(row, 0) // bh, -(-min(row + height, i.height) // bh)):
            for bc in range(max(col, 0) // bw, -(-min(col + width, i.width) // bw)):
                k = br * across + bc
                f.seek(i.offsets[k])
                raw = f.read(i.sizes[k])
                data = np.frombuffer(zlib.decompress(raw) if i.compression != 1 else raw, np.uint8)
                block = data[: data.size // (bw * i.bands) * bw * i.bands].reshape(-1, bw, i.bands)
                if i.predictor == 2:
                    block = np.cumsum(block, axis=1, dtype=np.uint8)
                r0, c0 = max(row, br * bh), max(col, bc * bw)
                r1, c1 = min(row + height, i.height, br * bh + len(block)), min(col + width, i.width, bc * bw + bw)
                if r0 < r1 and c0 < c1:
                    out[r0 - row : r1 - row, c0 - col : c1 - col] = block[r0 - br * bh : r1 - br * bh, c0 - bc * bw : c1 - bc * bw]
    return out


def write(path: str, pixels: np.ndarray, px: float = 1.0, py: float = 1.0, origin: tuple[float, float] = (0.0, 0.0), rows: int = 64) -> None:
    """A deflated, striped TIFF with a geographic frame; published by renaming."""
    pixels = pixels[..., None] if pixels.ndim == 2 else pixels
    h, w, b = pixels.shape
    strips = [zlib.compress(pixels[r : r + rows].tobytes(), 1) for r in range(0, h, rows)]
    offsets = np.cumsum([8, *map(len, strips)])[:-1].tolist()
    tags = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8] * b), (COMPRESSION, 3, [8]), (262, 3, [2 if b >= 3 else 1]), (STRIPS, 4, offsets), (BANDS, 3, [b]), (ROWS, 4, [rows]), (STRIP_SIZES, 4, [len(s) for s in strips]), (284, 3, [1]), (SCALE, 12, [px, py, 0.0]), (TIE, 12, [0.0, 0.0, 0.0, *origin, 0.0])]
    at = 8 + sum(map(len, strips))
    extra_at, extra, rows_out = at + 2 + 12 * len(tags) + 4, b"", b""
    for tag, kind, values in tags:
        raw = struct.pack("<" + FORMATS[kind] * len(values), *values)
        if len(raw) > 4:
            field, extra = struct.pack("<I", extra_at + len(extra)), extra + raw
        else:
            field = raw.ljust(4, b"\0")
        rows_out += struct.pack("<HHI", tag, kind, len(values)) + field
    with open(path + ".tmp", "wb") as f:
        f.write(b"II" + struct.pack("<HI", 42, at) + b"".join(strips) + struct.pack("<H", len(tags)) + rows_out + struct.pack("<I", 0) + extra)
    os.replace(path + ".tmp", path)


def read_scaled(i: Info, row: int, col: int, height: int, width: int, size: int) -> np.ndarray:
    """A window as (size, size, bands): from the smallest overview that has as many pixels,
    cubic; what the nearest pixel says is empty stays 0, and nothing else becomes so."""
    fits = [o for o in (i, *i.overviews) if min(height, width) * o.width / i.width >= size]
    level = min(fits, key=lambda o: o.width, default=i)
    f = level.width / i.width
    w = read_window(level, round(row * f), round(col * f), max(1, round(height * f)), max(1, round(width * f)))
    valid = resize((w != 0).any(-1)[None, ..., None].astype(np.uint8), size, False)[0, ..., 0] > 0
    x = np.clip(np.rint(resize(w[None].astype(np.float32), size)[0]), 0, 255).astype(np.uint8)
    x[valid & ~x.any(-1)] = 1
    return np.where(valid[..., None], x, 0).astype(np.uint8)


def packed(block: np.ndarray, compression: str = "DEFLATE") -> bytes:
    """A block (rows, columns) of one band as a file holds it: differences along rows, deflated; or plain."""
    if compression == "NONE":
        return block.tobytes()
    return zlib.compress(np.diff(block, axis=1, prepend=block[:, :1] * 0).astype(np.uint8).tobytes(), 1)


def compression_of(name: str | None) -> str:
    """DEFLATE unless none is asked for; forms that other libraries have are refused."""
    n = (name or "NONE").upper()
    if n in ("LZW", "ZSTD"):
        raise ValueError(f"compression {n} is not built in")
    return "NONE" if n in ("NONE", "OFF", "FALSE", "0") else "DEFLATE"


def write_tiled(path: str, levels: list[tuple[int, int, Iterable[bytes]]], px: float, py: float, origin: tuple[float, float], side: int = 512, compression: str = "DEFLATE") -> None:
    """A big tiled TIFF of one 8-bit band; levels: width, height and packed blocks row by row.

    The first level is the image, others are its overviews. Blocks stream to the file, which
    is published by renaming.
    """
    plain = compression == "NONE"
    with open(path + ".tmp", "wb") as f:
        f.write(b"II" + struct.pack("<HHHQ", 43, 8, 0, 0))
        link = 8
        for k, (width, height, blocks) in enumerate(levels):
            offsets, sizes = [], []
            for b in blocks:
                offsets.append(f.tell())
                sizes.append(f.write(b))
            if len(offsets) != -(-width // side) * -(-height // side):
                raise ValueError(f"{len(offsets)} blocks for {width} x {height} pixels")
            tags = [(SUBFILE, 4, [int(k > 0)]), (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [1 if plain else 8]), (262, 3, [1]), (BANDS, 3, [1]), (284, 3, [1]), (PREDICTOR, 3, [1 if plain else 2]), (TILE_WIDTH, 4, [side]), (TILE_HEIGHT, 4, [side]), (TILE_OFFSETS, 16, offsets), (TILE_SIZES, 4, sizes)]
            tags += [] if k else [(SCALE, 12, [px, py, 0.0]), (TIE, 12, [0.0, 0.0, 0.0, *origin, 0.0])]
            entries = []
            for tag, kind, values in tags:
                raw = struct.pack("<" + FORMATS[kind] * len(values), *values)
                if len(raw) > 8:
                    raw, at = struct.pack("<Q", f.tell()), f.write(raw)
                entries.append(struct.pack("<HHQ", tag, kind, len(values)) + raw.ljust(8, b"\0"))
            here = f.tell()
            f.write(struct.pack("<Q", len(entries)) + b"".join(entries))
            tail = f.tell()
            f.write(struct.pack("<Q", 0))
            f.seek(link)
            f.write(struct.pack("<Q", here))
            f.seek(0, os.SEEK_END)
            link = tail
    os.replace(path + ".tmp", path)


def rasters(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Metadata of rasters, read by the executors: what tilings and checks start from."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [(int(k), i.path, i.width, i.height, i.bands, 1, i.px, i.py, i.origin_x, i.origin_y, i.geographic, len(i.overviews)) for k, i in zip(f["raster_id"], map(info, f["path"]), strict=True)]
            yield pd.DataFrame(found, columns=[c.split()[0] for c in RASTERS.split(", ")])

    listed = spark.createDataFrame(list(enumerate(paths)), "raster_id long, path string").repartition(max(1, len(paths)))
    return shipped(listed).mapInPandas(run, RASTERS)


RASTERS = "raster_id long, path string, width long, height long, bands long, item_bytes long, px double, py double, origin_x double, origin_y double, geographic boolean, n_overviews long"


def read_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs (path, raster_id, tile_index, src_row, src_col, src_height, src_width) to tiles for the
    segmenter; tile_id counts through all rasters. A task reads its own windows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Info] = {}
        for f in frames:
            for j in f.itertuples(index=False):
                if j.path not in held:
                    held[j.path] = info(j.path)
                i = held[j.path]
                w = read_window(i, j.src_row, j.src_col, j.src_height, j.src_width)
                yield pd.DataFrame({"tile_id": [(j.raster_id << 32) + j.tile_index], "height": [j.src_height], "width": [j.src_width], "bands": [i.bands], "pixels": [w.tobytes()]})

    return shipped(jobs).mapInPandas(run, "tile_id long, height int, width int, bands int, pixels binary")


def list_rasters(folder: str) -> list[str]:
    return sorted(p for p in glob.glob(os.path.join(folder, "*")) if p.lower().endswith((".tif", ".tiff")))


class Windows(InputPartition):
    def __init__(self, meta: Info, first: int, last: int, step: int, halo: int):
        self.meta, self.first, self.last, self.step, self.halo = meta, first, last, step, halo


class RasterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = list_rasters(options["path"]) if os.path.isdir(options["path"]) else [options["path"]]
        self.step, self.halo = int(options.get("tile", 512)), int(options.get("halo", 0))
        self.each = int(options.get("tilesPerPartition", 16))
        self.size = int(options.get("size", 0)) if strategy(options.get("readstrategy")) == "overview" else 0

    def partitions(self) -> list[Windows]:
        out = []
        for p in self.paths:
            i = info(p)
            n = -(-i.width // self.step) * -(-i.height // self.step)
            out += [Windows(i, k, min(k + self.each, n), self.step, self.halo) for k in range(0, n, self.each)]
        return out

    def read(self, part: Windows) -> Iterator[tuple]:
        i, s, halo = part.meta, part.step, part.halo
        across = -(-i.width // s)
        for k in range(part.first, part.last):
            row, col = k // across * s - halo, k % across * s - halo
            size = s + 2 * halo
            n = self.size or size
            w = read_scaled(i, row, col, size, size, n) if self.size else read_window(i, row, col, size, size)
            yield (i.path, k, row, col, n, n, i.bands, i.origin_x + col * i.px, i.origin_y - row * i.py, i.px * size / n, i.py * size / n, w.tobytes())


class RasterSource(DataSource):
    """Options: path (a file or a folder), tile, halo, tilesPerPartition; with readStrategy overview
    and size, windows come as so many pixels a side, from an overview where there is one."""

    @classmethod
    def name(cls) -> str:
        return "boleflow_raster"

    def schema(self) -> str:
        return TILES

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options)
