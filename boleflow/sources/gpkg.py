"""GeoPackage layers: an SQLite file of tables with a geometry column."""

from __future__ import annotations

import os
import sqlite3
import struct
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators.layers import LAYERS
from ..shipping import shipped


def wkb(points: list[tuple[float, float]]) -> bytes:
    """Little-endian WKB of a point or a line."""
    flat = [v for p in points for v in p]
    if len(points) == 1:
        return struct.pack("<BIdd", 1, 1, *flat)
    return struct.pack(f"<BII{len(flat)}d", 1, 2, len(points), *flat)


def points_of(blob: bytes) -> list[tuple[float, float]]:
    """Points of a GeoPackage geometry; an unknown or empty one gives none."""
    if not blob or blob[:2] != b"GP":
        return []
    body = blob[8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] :]
    end = "<" if body[0] else ">"
    (kind,) = struct.unpack(end + "I", body[1:5])
    if kind == 1:
        return [struct.unpack(end + "dd", body[5:21])]
    if kind != 2:
        return []
    (n,) = struct.unpack(end + "I", body[5:9])
    v = struct.unpack(f"{end}{2 * n}d", body[9 : 9 + 16 * n])
    return list(zip(v[::2], v[1::2], strict=True))


def write(path: str, layers: dict[str, tuple[list[str], Iterable[tuple]]], srs: int = 0) -> str:
    """Layers as (column names, rows); the last value of a row is its list of points.

    The file appears by renaming; if the name is locked, a free one beside it is taken
    and returned.
    """
    temporary = f"{path}.tmp"
    if os.path.exists(temporary):
        os.remove(temporary)
    db = sqlite3.connect(temporary)
    db.executescript(
        """PRAGMA application_id = 1196444487;
        CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT, description TEXT);
        CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, description TEXT, last_change TEXT, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
        CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z TINYINT, m TINYINT);"""
    )
    db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, '', '')", (f"EPSG:{srs}", srs, srs))
    for name, (columns, rows) in layers.items():
        quoted = ", ".join(f'"{c}"' for c in columns)
        db.execute(f'CREATE TABLE "{name}" (fid INTEGER PRIMARY KEY AUTOINCREMENT, {quoted}, geom BLOB)')
        marks = ", ".join("?" * (len(columns) + 1))
        head = b"GP\x00\x01" + struct.pack("<i", srs)
        db.executemany(f'INSERT INTO "{name}" ({quoted}, geom) VALUES ({marks})', ((*r[:-1], head + wkb(r[-1])) for r in rows))
        kind = "POINT" if name == "nodes" else "LINESTRING"
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (name, name, srs))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, ?, 0, 0)", (name, kind, srs))
    db.commit()
    db.close()
    base, ext = os.path.splitext(path)
    for target in (path, f"{base}_new{ext}", f"{base}_new_{os.getpid()}{ext}"):
        try:
            os.replace(temporary, target)
            return target
        except PermissionError:
            continue
    raise PermissionError(path)


def write_frames(path: str, frames: dict[str, DataFrame], srs: int = 0) -> str:
    """Result layers of one product to one file: rows stream through the driver, a partition at a time.

    frames' last column is an array of points (x, y). Large results belong in Parquet.
    """

    def rows(df: DataFrame) -> Iterable[tuple]:
        for r in df.toLocalIterator():
            yield (*r[:-1], [(p["x"], p["y"]) for p in r[-1]])

    return write(path, {k: (df.columns[:-1], rows(df)) for k, df in frames.items()}, srs)


def layer_of(path: str, layer: str) -> tuple[str, list[tuple[str, str]], int, int] | None:
    """A layer by any of its usual names: its table, columns with their types, least and largest row id."""
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    there = {r[0] for r in db.execute("SELECT table_name FROM gpkg_contents")}
    name = next((n for n in LAYERS.get(layer, [layer]) if n in there), None)
    if name is None:
        return None
    columns = [(r[1], r[2].upper()) for r in db.execute(f'PRAGMA table_info("{name}")') if r[1] not in ("geom", "fid")]
    held = []
    for c, kind in columns:  # columns without a type have that of their values
        used = {r[0] for r in db.execute(f'SELECT DISTINCT typeof("{c}") FROM "{name}"')}
        held.append((c, "string" if kind.startswith("TEXT") or "text" in used else "double" if "real" in used else "long"))
    lo, hi = db.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{name}"').fetchone()
    db.close()
    return name, held, lo, hi


def read(spark: SparkSession, path: str, layer: str, rows: int = 50_000) -> DataFrame:
    """A layer by any of its usual names: its columns and path; none found: no rows.

    Executors read ranges of row ids, so that no layer passes through the driver.
    """
    found = layer_of(path, layer)
    if found is None:
        return spark.createDataFrame([], "path array<struct<x:double,y:double>>")
    name, columns, lo, hi = found
    quoted = ", ".join(f'"{c}"' for c, _ in columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for start, end in zip(f["lo"], f["hi"], strict=True):
                db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
                got = db.execute(f'SELECT {quoted}{", " if quoted else ""}geom FROM "{name}" WHERE rowid BETWEEN ? AND ?', (int(start), int(end))).fetchall()
                db.close()
                data = {c: pd.Series([r[k] for r in got], dtype=object) for k, (c, _) in enumerate(columns)}
                yield pd.DataFrame(data | {"path": pd.Series([[{"x": x, "y": y} for x, y in points_of(r[-1])] for r in got], dtype=object)})

    ranges = [(a, min(a + rows - 1, hi)) for a in range(lo, hi + 1, rows)]
    schema = ", ".join([*(f"`{c}` {k}" for c, k in columns), "path array<struct<x:double,y:double>>"])
    listed = spark.createDataFrame(ranges, "lo long, hi long").repartition(max(1, len(ranges)))
    return shipped(listed).mapInPandas(run, schema)
