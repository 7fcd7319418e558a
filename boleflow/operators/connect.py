"""Connecting stem fragments: candidates, votes, greedy growth, and removal of duplicates.

Candidates and votes are expressions over a grid join. The greedy part depends on order;
it runs over connected groups of stems that could ever meet, each in one Python call, in
a canonical order, so that results don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.geometry import angle, direction, dist, end_lines, gap_factor, unit, vote
from .components import components
from .groups import map_groups, paths, points, spans
from .spatial import near, overlapping


def endpoint_candidates(stems: DataFrame, distance: float) -> DataFrame:
    """(base, other) where the other's start lies within distance of the base's stop."""
    a = stems.select(F.col("stem_id").alias("base"), F.col("stop_x").alias("ax"), F.col("stop_y").alias("ay"))
    b = stems.select(F.col("stem_id").alias("other"), F.col("start_x").alias("bx"), F.col("start_y").alias("by"))
    return near(a, b, "ax", "ay", "bx", "by", distance).filter("base <> other").withColumn("gap", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")))


def votes(stems: DataFrame, c: Config = Config()) -> DataFrame:
    """(base, other, vote) of connections from a base's stop to another's start that the
    gates let pass. stems: stem_id and path, an array of points."""
    first, last = F.get("path", F.lit(0)), F.element_at("path", -1)
    sl0, sl1, el0, el1 = end_lines("path")
    lines = {k: v for name, (x, y) in (("s", direction(sl0, sl1)), ("e", direction(el0, el1))) for k, v in ((name + "x", x), (name + "y", y))}
    s = stems.withColumns(lines | {"inner_stop": F.element_at("path", -2), "inner_start": F.get("path", F.lit(1))})
    a = s.select(F.col("stem_id").alias("base"), first["x"].alias("far_x"), first["y"].alias("far_y"), last["x"].alias("ax"), last["y"].alias("ay"), "ex", "ey", F.col("inner_stop.x").alias("px"), F.col("inner_stop.y").alias("py"))
    b = s.select(F.col("stem_id").alias("other"), first["x"].alias("bx"), first["y"].alias("by"), last["x"].alias("end_x"), last["y"].alias("end_y"), "sx", "sy", F.col("inner_start.x").alias("qx"), F.col("inner_start.y").alias("qy"))
    d = near(a, b, "ax", "ay", "bx", "by", c.max_distance).filter("base <> other")
    stop_line, start_line = (F.col("ex"), F.col("ey")), (F.col("sx"), F.col("sy"))
    mx, my = unit(F.col("px"), F.col("py"), F.col("qx"), F.col("qy"))
    # directions of a stem's own lines come from before the join; gates are passed one by one
    d = d.withColumns({"gap": dist(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")), "a1": angle(stop_line, start_line)}).filter(F.col("a1") < F.lit(c.tolerance_angle))
    d = d.withColumns({"mx": mx, "my": my})
    missing = (F.col("mx"), F.col("my"))
    d = d.withColumns({"a2": angle(stop_line, missing), "a3": angle(missing, start_line), "extent": dist(F.col("far_x"), F.col("far_y"), F.col("end_x"), F.col("end_y"))})
    limit = F.lit(c.tolerance_angle) * gap_factor(F.col("gap"), c.max_distance)
    d = d.filter((F.col("a1") < limit) & (F.col("a2") < limit) & (F.col("a3") < limit) & (F.col("extent") < F.lit(c.max_tree_height)))
    return d.withColumn("vote", vote(F.col("a1"), F.col("a2"), F.col("a3"), F.col("extent"), F.col("gap"), c.tolerance_angle)).select("base", "other", "gap", "vote")


def either_way(voted: DataFrame) -> DataFrame:
    """Votes of both orientations: the other goes on from the base's stop, or the base from the other's."""
    return voted.withColumn("forward", F.lit(True)).unionByName(voted.select(F.col("other").alias("base"), F.col("base").alias("other"), "gap", "vote", F.lit(False).alias("forward")))


def best(voted: DataFrame) -> DataFrame:
    """The least vote of each base; ties go to the lesser id."""
    return voted.groupBy("base").agg(F.min(F.struct("vote", "other")).alias("m")).select("base", "m.other", "m.vote")


# --- the greedy part, on plain arrays -------------------------------------------------


def _unit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    v = b - a
    return v / (np.hypot(*v) + 2.220446049250313e-16)


def _angle(u: np.ndarray, v: np.ndarray) -> float:
    return float(np.degrees(np.arccos(np.clip(u @ v, -1, 1))))


def _lines(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions of the start and the stop line."""
    n = len(p)
    if n < 4:
        return _unit(p[0], p[-1]), _unit(p[0], p[-1])
    i = min(n - 2, 6)
    return _unit(p[1], p[i]), _unit(p[-i - 1], p[-2])


def _join(a: np.ndarray, b: np.ndarray, c: Config) -> float | None:
    """The vote for a path that goes through a and then b, or None if a gate is shut."""
    gap = float(np.hypot(*(a[-1] - b[0])))
    if gap >= c.max_distance:
        return None
    stop, start, missing = _lines(a)[1], _lines(b)[0], _unit(a[-2], b[1])
    angles = (_angle(stop, start), _angle(stop, missing), _angle(missing, start))
    extent = float(np.hypot(*(a[0] - b[-1])))
    if max(angles) >= c.tolerance_angle * (1 - (3 + c.max_distance - gap) ** -0.5) or extent >= c.max_tree_height:
        return None
    w = (1 + sum(angles)) / c.tolerance_angle
    return w * extent**2 + gap**2 * w


def distance_to_path(points: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Least distance of each point to a polyline."""
    a, d = path[:-1], np.diff(path, axis=0)
    n = np.maximum((d * d).sum(1), 1e-300)
    t = np.clip(((points[:, None] - a) * d).sum(2) / n, 0, 1)
    return np.sqrt((((a + t[..., None] * d) - points[:, None]) ** 2).sum(2)).min(1)


def contained(inner: np.ndarray, outer: np.ndarray, buffer: float) -> bool:
    """Whether a path lies within buffer of another; edges are looked at every buffer / 3."""
    if ((inner.min(0) < outer.min(0) - buffer) | (inner.max(0) > outer.max(0) + buffer)).any():
        return False
    d = np.diff(inner, axis=0)
    k = np.maximum(1, np.ceil(np.hypot(d[:, 0], d[:, 1]) / (buffer / 3)).astype(int))
    between = [inner[i] + d[i] * (np.arange(k[i])[:, None] / k[i]) for i in range(len(d))]
    return bool((distance_to_path(np.concatenate([*between, inner[-1:]]), outer) <= buffer).all())


def length(p: np.ndarray) -> float:
    return float(np.hypot(*np.diff(p, axis=0).T).sum())


def without_duplicates(lines: list[np.ndarray], buffer: float) -> list[int]:
    """Indices that stay, longest first: a path inside a longer kept one goes."""
    order = sorted(range(len(lines)), key=lambda i: -length(lines[i]))
    kept: list[int] = []
    gone: set[int] = set()
    for at, i in enumerate(order):
        if i in gone:
            continue
        kept.append(i)
        gone.update(j for j in order[at + 1 :] if j not in gone and contained(lines[j], lines[i], buffer))
    return kept


def connect(stems: list[tuple[np.ndarray, list[float]]], c: Config = Config()) -> list[tuple[np.ndarray, list[float]]]:
    """Grows each stem, in order, by the best fragment until none fits; cycles until nothing changes.

    A stem is (path, diameters). A fragment is looked for by the ends that it and the
    base had when the cycle began and have now, as the base grows.
    """
    stems, changed, reach = list(stems), True, (1.001 * c.max_distance) ** 2
    while changed:
        changed = False
        held, left, out = list(stems), dict.fromkeys(range(len(stems))), []
        while left:
            base = next(iter(left))
            while True:
                path, d = held[base]
                found = []
                (x0, y0), (x1, y1) = path[0], path[-1]
                for i in left:
                    if i == base:
                        continue
                    other, od = held[i]
                    (u0, v0), (u1, v1) = other[0], other[-1]
                    if (u0 - x1) ** 2 + (v0 - y1) ** 2 > reach and (u1 - x0) ** 2 + (v1 - y0) ** 2 > reach:
                        continue  # neither gap is short enough
                    if (v := _join(path, other, c)) is not None:
                        found.append((v, i, path, d, other, od))
                    if (v := _join(other, path, c)) is not None:
                        found.append((v, i, other, od, path, d))
                if not found:
                    break
                _, i, a, da, b, db = min(found, key=lambda f: f[0])
                full = len(da) == len(a) and len(db) == len(b)
                held[base] = (np.concatenate([a[:-1], b[1:]]), [*da[:-1], *db[1:]] if full else [])
                del left[i]
                changed = True
                for j in [j for j in left if j != base and contained(held[j][0], held[base][0], c.duplicate_buffer_m)]:
                    del left[j]
            out.append(held[base])
            del left[base]
        stems = out
    long = [s for s in stems if length(s[0]) > c.min_length]
    return [long[i] for i in without_duplicates([p for p, _ in long], c.duplicate_buffer_m)]


def seam_groups(stems: DataFrame, c: Config = Config()) -> DataFrame:
    """stems (stem_id, path) with group_id: stems of different groups have nothing to do with each other.

    A group is a connected component of stems one of which starts within reach of the
    other's stop, or whose boxes come within the duplicates' buffer. Links are equi-joins on
    grid cells. Two-point stems are the exception: joining them bridges over their own ends,
    and a stem of another group that only lies along such a bridge is not found there.
    """
    first, last = F.get("path", F.lit(0)), F.element_at("path", -1)
    ends = stems.select("stem_id", first["x"].alias("sx"), first["y"].alias("sy"), last["x"].alias("tx"), last["y"].alias("ty"))
    a, b = ends.select(F.col("stem_id").alias("a"), "tx", "ty"), ends.select(F.col("stem_id").alias("b"), "sx", "sy")
    follows = near(a, b, "tx", "ty", "sx", "sy", c.max_distance + c.duplicate_buffer_m).select("a", "b")
    side = lambda f, k: f(F.transform("path", lambda p: p[k]))
    boxes = stems.select("stem_id", side(F.array_min, "x").alias("x0"), side(F.array_min, "y").alias("y0"), side(F.array_max, "x").alias("x1"), side(F.array_max, "y").alias("y1"))
    linked = components(follows.union(overlapping(boxes, "stem_id", c.max_tree_height, c.duplicate_buffer_m)))
    return stems.join(linked.select(F.col("a").alias("stem_id"), F.col("b").alias("group_id")), "stem_id", "left").withColumn("group_id", F.coalesce("group_id", "stem_id"))


CONNECTED = "group_id long, stem_id long, path array<struct<x:double,y:double>>, diameters array<double>"


def connect_groups(stems: DataFrame, c: Config = Config()) -> DataFrame:
    """connect() for each group_id. stems: group_id, path, diameters.

    A group is what may be connected at all: a tile, or a component of seam stems. Paths of
    fewer than two points go; missing diameters are none.
    """

    def run(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            keys = t.column("group_id").to_numpy()
            xy, at = points(t.column("path").combine_chunks())
            given = t.column("diameters").to_pylist()
            ids, places, found = [], [], []
            for first, end in spans(keys):
                rows = [(xy[at[i] : at[i + 1]], given[i]) for i in range(first, end)]
                rows.sort(key=lambda s: (*s[0][0], *s[0][-1], len(s[0]), s[0].tobytes(), s[1]))
                done = connect(rows, c)
                ids += [keys[first]] * len(done)
                places += range(len(done))
                found += done
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(places, pa.int64()), paths([p for p, _ in found]), pa.array([[float(v) for v in d] for _, d in found], pa.list_(pa.float64()))],
                names=["group_id", "stem_id", "path", "diameters"],
            )

    point = lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))
    asked = stems.filter("size(path) >= 2").select(F.col("group_id").cast("long").alias("group_id"), F.transform("path", point).alias("path"), F.coalesce(F.col("diameters").cast("array<double>"), F.array().cast("array<double>")).alias("diameters"))
    return map_groups(asked, "group_id", run, CONNECTED)
