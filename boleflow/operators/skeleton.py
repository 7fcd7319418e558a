"""Thinning, tracing and refining of a tile's mask, on numpy arrays; one call a tile.

Tiles are independent: rows (tile_id, r, c) meet by tile and each tile is one group. A
tile's size bounds a group, whatever the raster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import map_groups, spans

#: Neighbours in scan order, as (row, column) steps.
SCAN = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
CLOCKWISE = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
# Degrees at which a walk is split: first step, last step, elsewhere.
SPLIT_FIRST, SPLIT_LAST, SPLIT_INNER = 10.0, 10.0, 30.0


def shifted(m: np.ndarray, dr: int, dc: int) -> np.ndarray:
    """At each place, the value at (r + dr, c + dc); False outside."""
    p = np.pad(m, 1)
    return p[1 + dr : 1 + dr + m.shape[0], 1 + dc : 1 + dc + m.shape[1]]


def thin(mask: np.ndarray) -> np.ndarray:
    """Two-subiteration parallel thinning to lines one pixel wide (Zhang and Suen, 1984)."""
    m = mask.astype(bool).copy()
    while True:
        before = m.copy()
        for first in (True, False):
            n = [shifted(m, *s) for s in CLOCKWISE]
            count = sum(x.astype(np.int8) for x in n)
            rises = sum((~n[k] & n[(k + 1) % 8]).astype(np.int8) for k in range(8))
            north, east, south, west = n[0], n[2], n[4], n[6]
            gate = ~(north & east & south) & ~(east & south & west) if first else ~(north & east & west) & ~(north & south & west)
            m = m & ~((count >= 2) & (count <= 6) & (rises == 1) & gate)
        if (m == before).all():
            return m


def without_blocks(m: np.ndarray) -> np.ndarray:
    """Clears the lower right pixel of every full 2x2 block."""
    return m & ~(shifted(m, -1, 0) & shifted(m, 0, -1) & shifted(m, -1, -1))


def transitions(m: np.ndarray) -> np.ndarray:
    n = [shifted(m, *s) for s in CLOCKWISE]
    return np.where(m, sum((~n[k] & n[(k + 1) % 8]).astype(int) for k in range(8)), 0)


def without_branches(m: np.ndarray) -> np.ndarray:
    """Clears blocks around branch pixels until there are none."""
    while (branch := transitions(m) >= 3).any():
        around = branch.copy()
        for s in CLOCKWISE:
            around |= shifted(branch, *s)
        m = m & ~around
    return m


def neighbours(m: np.ndarray, p: tuple[int, int]) -> list[tuple[int, int]]:
    at = ((p[0] + dr, p[1] + dc) for dr, dc in SCAN)
    return [q for q in at if 0 <= q[0] < m.shape[0] and 0 <= q[1] < m.shape[1] and m[q]]


def trace(m: np.ndarray, min_steps: int) -> list[list[tuple[int, int]]]:
    """Edge-disjoint chains of pixels: from ends and junctions first, then what is left (loops).

    A chain starts at its upper end. Chains with fewer than min_steps steps are dropped.
    """
    pixels = [tuple(map(int, p)) for p in np.argwhere(m)]
    links = {p: neighbours(m, p) for p in pixels}
    used: set[frozenset] = set()

    def walk(a: tuple[int, int], b: tuple[int, int], through: bool) -> list[tuple[int, int]]:
        path = [a, b]
        used.add(frozenset((a, b)))
        while path[-1] != a and (through or len(links[path[-1]]) == 2):
            ahead = [q for q in links[path[-1]] if q != path[-2] and frozenset((path[-1], q)) not in used]
            if not ahead:
                break
            used.add(frozenset((path[-1], ahead[0])))
            path.append(ahead[0])
        return path

    chains = [walk(p, q, False) for p in pixels if len(links[p]) != 2 for q in links[p] if frozenset((p, q)) not in used]
    chains += [walk(p, q, True) for p in pixels for q in links[p][:1] if frozenset((p, q)) not in used]
    kept = [c for c in chains if len(c) >= 2 and len(c) - 1 >= min_steps]
    return [c[::-1] if c[0][0] > c[-1][0] else c for c in kept]


def _turn(a: tuple, b: tuple, c: tuple, d: tuple) -> float:
    """Degrees between a to b and c to d."""
    u, v = np.subtract(b, a), np.subtract(d, c)
    n = np.hypot(*u) * np.hypot(*v)
    return float(np.degrees(np.arccos(np.clip(u @ v / n, -1, 1)))) if n else 0.0


def refine(chain: list[tuple[int, int]], spacing: float, min_chord: float) -> list[list[tuple[int, int]]]:
    """Samples a chain at every spacing pixels and splits it where it turns too far.

    The first sample is set against the chord to the end, later ones against the sample
    before. A split starts a new piece from the last good sample; pieces whose ends are
    nearer than min_chord are dropped. Each chain is refined alone, so that the result
    does not depend on the order of chains.
    """
    todo, out = [chain], []
    while todo:
        c = todo.pop(0)
        end, at, kept, last = len(c) - 1, 0, [c[0]], (c[0], c[-1])
        i = 1
        while i <= end:
            p = c[i]
            turn = _turn(c[at], p, *last)
            if i == end:
                if turn > SPLIT_LAST and at > 0:
                    todo.append(c[at:])
                else:
                    kept.append(p)
                break
            if np.hypot(p[0] - c[at][0], p[1] - c[at][1]) > spacing:
                if at == 0 and turn > SPLIT_FIRST:
                    kept.append(p)
                    todo.append(c[i:])
                    break
                if at > 0 and turn > SPLIT_INNER:
                    todo.append(c[at:])
                    break
                kept.append(p)
                last, at = (c[at], p), i
            i += 1
        if len(kept) >= 2 and np.hypot(kept[0][0] - kept[-1][0], kept[0][1] - kept[-1][1]) >= min_chord:
            out.append(kept[::-1] if kept[0][0] > kept[-1][0] else kept)
    return out


def segments(mask: np.ndarray, pixel: float, min_length: float = 2.0, spacing_m: float = 0.5) -> list[list[tuple[int, int]]]:
    """A tile's mask to refined chains."""
    least = int(min_length / 4 / pixel)
    m = thin(without_branches(without_blocks(thin(mask))))
    step = int(min(min_length, spacing_m) / pixel)
    return [r for c in trace(m, least // 4) for r in refine(c, step, least)]


def distance_to_background(mask: np.ndarray, py: float = 1.0, px: float = 1.0) -> np.ndarray:
    """Exact distance of each set pixel to the nearest unset one, by two separable passes.

    Columns first, by running counts; then each row's lower envelope of parabolas, by
    brute force over offsets that can still be nearer. A full mask has no background: inf.
    """
    m = mask.astype(bool)
    rows = np.arange(m.shape[0])[:, None]
    up = np.maximum.accumulate(np.where(m, -(10**9), rows), axis=0)
    down = np.minimum.accumulate(np.where(m, 10**9, rows)[::-1], axis=0)[::-1]
    column = np.minimum(rows - up, down - rows).astype(float)
    column[column > 10**8] = np.inf
    best = (column * py) ** 2
    squared = best.copy()
    for k in range(1, m.shape[1]):
        reach = (k * px) ** 2
        if not (squared > reach).any():
            break
        squared[:, k:] = np.minimum(squared[:, k:], best[:, :-k] + reach)
        squared[:, :-k] = np.minimum(squared[:, :-k], best[:, k:] + reach)
    return np.sqrt(squared)


def components(mask: np.ndarray) -> np.ndarray:
    """4-connected labels from 1 on; 0 is background. Rounds of least-label spreading."""
    m = mask.astype(bool)
    label = np.where(m, np.arange(1, m.size + 1).reshape(m.shape), 0)
    while True:
        least = np.where(m, label, m.size + 1)
        for dr, dc in ((-1, 0), (1, 0), (0, -1), (0, 1)):
            near = shifted(label, dr, dc)
            least = np.where(m & (near > 0), np.minimum(least, near), least)
        new = np.where(m, least, 0)
        flat = new.ravel()
        new = np.where(m, flat[np.maximum(new, 1) - 1], 0)  # jump to the label of the label
        if (new == label).all():
            return label
        label = new


def contour_diameters(mask: np.ndarray, lines: np.ndarray, nodes: np.ndarray, tolerance: float = 0.01) -> np.ndarray:
    """Longest piece of each measuring line inside a component that reaches the line's node.

    In pixels: lines is (n, 4) with (row, column) of either end, nodes is (n, 2); pixel
    (r, c) covers the square from (r, c) to (r + 1, c + 1). A line is cut at all grid
    lines it crosses; consecutive pieces of one component join.
    """
    label = components(mask)
    out = np.zeros(len(lines))
    for i, (r0, c0, r1, c1) in enumerate(lines):
        d = np.array([r1 - r0, c1 - c0])
        total = np.hypot(*d)
        if not total:
            continue
        cuts = [0.0, 1.0]
        for a, b, step in ((r0, r1, d[0]), (c0, c1, d[1])):
            if step:
                grid = np.arange(np.floor(min(a, b)) + 1, np.ceil(max(a, b)))
                cuts += ((grid - a) / step).tolist()
        t = np.unique(np.clip(cuts, 0, 1))
        mid = (t[1:] + t[:-1]) / 2
        r, c = np.floor(r0 + mid * d[0]).astype(int), np.floor(c0 + mid * d[1]).astype(int)
        inside = (r >= 0) & (r < label.shape[0]) & (c >= 0) & (c < label.shape[1])
        of = np.where(inside, label[np.clip(r, 0, label.shape[0] - 1), np.clip(c, 0, label.shape[1] - 1)], 0)
        ends = np.flatnonzero(np.append(of[1:] != of[:-1], True))
        starts = np.append(0, ends[:-1] + 1)
        node = ((nodes[i] - (r0, c0)) @ d) / total**2
        for a, b in zip(starts, ends, strict=True):
            if of[a] and max(t[a] - node, node - t[b + 1], 0) * total < tolerance:
                out[i] = max(out[i], (t[b + 1] - t[a]) * total)
    return out


def as_mask(r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(mask, row, column of its origin) of a group's pixels, with a margin of one."""
    r0, c0 = int(r.min()) - 1, int(c.min()) - 1
    m = np.zeros((int(r.max()) - r0 + 2, int(c.max()) - c0 + 2), bool)
    m[r - r0, c - c0] = True
    return m, r0, c0


def each_tile(pixels: DataFrame, fn: Callable[[int, np.ndarray, np.ndarray], list], schema: str) -> DataFrame:
    """fn(tile, rows, columns) gives the columns of schema after tile_id, as arrays or lists, for each tile."""
    kinds = [pa.field(n, k) for n, k in COLUMNS.items()]
    out = pa.schema([next(f for f in kinds if f.name == x.split()[0]) for x in schema.split(", ")])

    def run(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            key, r, c = (t.column(k).to_numpy() for k in ("tile_id", "r", "c"))
            for first, end in spans(key):
                columns = fn(int(key[first]), r[first:end], c[first:end])
                yield pa.RecordBatch.from_arrays([pa.array([int(key[first])] * len(columns[0]), pa.int64()), *(pa.array(v, f.type) for v, f in zip(columns, list(out)[1:], strict=True))], schema=out)

    return map_groups(pixels.select(*(F.col(k).cast("long").alias(k) for k in ("tile_id", "r", "c"))), "tile_id", run, schema)


PIXELS = "tile_id long, r long, c long"
PARTS = "tile_id long, part long, path array<struct<r:int,c:int>>"
COLUMNS = {"tile_id": pa.int64(), "r": pa.int64(), "c": pa.int64(), "part": pa.int64(), "path": pa.list_(pa.struct([("r", pa.int32()), ("c", pa.int32())])), "distance": pa.float64()}


def thin_tiles(pixels: DataFrame) -> DataFrame:
    """pixels (tile_id, r, c) to the thinned ones."""

    def one(_: int, r: np.ndarray, c: np.ndarray) -> list:
        m, r0, c0 = as_mask(r, c)
        at = np.argwhere(thin(m))
        return [at[:, 0] + r0, at[:, 1] + c0]

    return each_tile(pixels, one, PIXELS)


def trace_tiles(pixels: DataFrame, min_steps: int = 0, refined: bool = False, pixel: float = 0.1, min_length: float = 2.0) -> DataFrame:
    """Chains of each tile; with refined, all of segments()."""

    def one(_: int, r: np.ndarray, c: np.ndarray) -> list:
        m, r0, c0 = as_mask(r, c)
        found = segments(m, pixel, min_length) if refined else trace(m, min_steps)
        return [range(len(found)), [[{"r": y + r0, "c": x + c0} for y, x in p] for p in found]]

    return each_tile(pixels, one, PARTS)


def distance_tiles(pixels: DataFrame, py: float = 1.0, px: float = 1.0) -> DataFrame:
    """pixels (tile_id, r, c) with their distance to the background."""

    def one(_: int, r: np.ndarray, c: np.ndarray) -> list:
        m, r0, c0 = as_mask(r, c)
        return [r, c, distance_to_background(m, py, px)[r - r0, c - c0]]

    return each_tile(pixels, one, "tile_id long, r long, c long, distance double")


def measure_tiles(lines: DataFrame, pixels: DataFrame) -> DataFrame:
    """lines (tile_id, line_id, r0, c0, r1, c1, node_r, node_c) with d, in pixels; both sides meet by tile."""
    ends = ["r0", "c0", "r1", "c1", "node_r", "node_c"]
    asked = lines.select("tile_id", "line_id", *(F.col(e).cast("double").alias(e) for e in ends))
    both = asked.unionByName(pixels.select("tile_id", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")), allowMissingColumns=True)

    def run(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            for first, end in spans(t.column("tile_id").to_numpy()):
                of = t.slice(first, end - first)
                is_pixel = pc.is_valid(of.column("r"))
                ps, ls = of.filter(is_pixel), of.filter(pc.invert(is_pixel))
                d = np.zeros(ls.num_rows)
                if ps.num_rows and ls.num_rows:
                    m, r0, c0 = as_mask(ps.column("r").to_numpy(), ps.column("c").to_numpy())
                    at = np.stack([ls.column(e).to_numpy() for e in ends], 1) - (r0, c0, r0, c0, r0, c0)
                    d = contour_diameters(m, at[:, :4], at[:, 4:])
                yield pa.RecordBatch.from_arrays([ls.column("tile_id").combine_chunks(), ls.column("line_id").combine_chunks(), pa.array(d)], names=["tile_id", "line_id", "d"])

    return map_groups(both, "tile_id", run, "tile_id long, line_id long, d double")
