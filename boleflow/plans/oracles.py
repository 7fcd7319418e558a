"""The same results as the catalogue's queries, in SQL for DuckDB."""

from __future__ import annotations

from ..sources.adapters import ctes


def sql(views: str, body: str, *more: str, recursive: bool = False) -> str:
    """WITH the views and further named parts (name: text), then the body."""
    parts = [ctes(*views.split())] if views else []
    parts += [f"{more[i]} AS ({more[i + 1]})" for i in range(0, len(more), 2)]
    head = f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" if parts else ""
    return head + body


D = "CAST({} AS DOUBLE)"
LINKED = "SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(d) OVER w AS d2, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM stem_nodes WINDOW w AS (PARTITION BY stem_id ORDER BY node)"
EDGES = "SELECT *, sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y)) AS len FROM linked WHERE x2 IS NOT NULL"
STEMS_P = "SELECT stem_id, list({'node': node, 'x': x, 'y': y, 'd': d} ORDER BY node) AS p FROM stem_nodes GROUP BY stem_id HAVING count(*) >= 2"
ENDS = "SELECT stem_id, p, p[1].x AS start_x, p[1].y AS start_y, p[-1].x AS stop_x, p[-1].y AS stop_y, len(p) AS n FROM sp"

NORMALS = f"""SELECT stem_id, node, d, x, y, CASE WHEN x0 IS NULL AND x2 IS NULL THEN 0.0 ELSE -(vy / n) END AS nx, CASE WHEN x0 IS NULL AND x2 IS NULL THEN 1.0 ELSE vx / n END AS ny
 FROM (SELECT *, sqrt(vx*vx+vy*vy) + {D.format('2.220446049250313e-16')} AS n FROM (SELECT *, coalesce(x2,x)-coalesce(x0,x) AS vx, coalesce(y2,y)-coalesce(y0,y) AS vy FROM linked))"""

Q_BOUNDS = "SELECT stem_id, count(*) AS n, quantile_cont(d, 0.25) AS q1, quantile_cont(d, 0.75) AS q3 FROM stem_nodes GROUP BY stem_id"
MARKED = """SELECT l.stem_id, l.node, l.d, b.n, (l.d > b.q3 + 1.5*(b.q3-b.q1) OR l.d < b.q1 - 1.5*(b.q3-b.q1)) AS far, l.d2,
 sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y)) AS to_next, sqrt((x-x0)*(x-x0)+(y-y0)*(y-y0)) AS from_last, sqrt((x2-x0)*(x2-x0)+(y2-y0)*(y2-y0)) AS chord,
 b.q3 + 1.5*(b.q3-b.q1) AS hi, b.q1 - 1.5*(b.q3-b.q1) AS lo FROM linked l JOIN bounds b USING (stem_id)"""
FOLD = """SELECT stem_id, node, d AS c FROM marked WHERE node = 0
 UNION ALL SELECT m.stem_id, m.node, CASE WHEN m.n > 4 AND m.node <= m.n - 3 AND m.far AND m.chord > 2.220446049250313e-16 THEN (f.c * m.to_next + m.d2 * m.from_last) / m.chord ELSE m.d END
 FROM fold f JOIN marked m ON m.stem_id = f.stem_id AND m.node = f.node + 1"""

LAYOUT = """SELECT *, CAST(ceil(width / greatest(px_per_tile_x - overlap_img_x, 1.0)) AS BIGINT) AS x_tiles, CAST(ceil(height / greatest(px_per_tile_y - overlap_img_y, 1.0)) AS BIGINT) AS y_tiles
 FROM (SELECT *, CAST(8 AS DOUBLE) * px_per_tile_x / CAST(512 AS DOUBLE) AS overlap_img_x, CAST(8 AS DOUBLE) * px_per_tile_y / CAST(512 AS DOUBLE) AS overlap_img_y
 FROM (SELECT *, CAST(ceil(CAST(15 AS DOUBLE) / px) AS BIGINT) AS px_per_tile_x, CAST(ceil(CAST(15 AS DOUBLE) / py) AS BIGINT) AS px_per_tile_y FROM raster_info))"""
JOBS = """SELECT raster_id, i * x_tiles + j AS tile_index, x_tiles * y_tiles AS n, CAST(floor(i * (px_per_tile_y - overlap_img_y)) AS BIGINT) AS src_row, CAST(floor(j * (px_per_tile_x - overlap_img_x)) AS BIGINT) AS src_col,
 greatest(1, px_per_tile_x - 1) AS src_width, greatest(1, px_per_tile_y - 1) AS src_height, i * 504 + 4 AS dst_row, j * 504 + 4 AS dst_col
 FROM (SELECT *, unnest(range(x_tiles)) AS j FROM (SELECT *, unnest(range(y_tiles)) AS i FROM layout))"""

OFFSETS = "SELECT * FROM (VALUES (0,-1,0),(1,-1,1),(2,0,1),(3,1,1),(4,1,0),(5,1,-1),(6,0,-1),(7,-1,-1)) v(k, dr, dc)"
MET = "SELECT p.r, p.c, o.k FROM mask_pixels p CROSS JOIN offsets o JOIN mask_pixels q ON q.r = p.r + o.dr AND q.c = p.c + o.dc"
RING = "SELECT p.r, p.c, " + ", ".join(f"max(CASE WHEN m.k = {k} THEN 1 ELSE 0 END) AS n{k}" for k in range(8)) + " FROM mask_pixels p LEFT JOIN met m ON m.r = p.r AND m.c = p.c GROUP BY p.r, p.c"
KINDS = "SELECT r, c, CAST(" + " + ".join(f"CASE WHEN n{k} = 0 AND n{(k + 1) % 8} = 1 THEN 1 ELSE 0 END" for k in range(8)) + " AS BIGINT) AS transitions FROM ring"
MASK = ("offsets", OFFSETS, "met", MET, "ring", RING)

KEEP = """SELECT *, CASE WHEN ok THEN a0 ELSE x0 END AS kx0, CASE WHEN ok THEN b0 ELSE y0 END AS ky0, CASE WHEN ok THEN a1 ELSE x1 END AS kx1, CASE WHEN ok THEN b1 ELSE y1 END AS ky1
 FROM (SELECT *, a1 > a0 AND b1 > b0 AS ok FROM (SELECT *, CASE WHEN abs(x0 - wx0) <= 0.001 THEN x0 ELSE x0 + 1 END AS a0, CASE WHEN abs(y0 - wy0) <= 0.001 THEN y0 ELSE y0 + 1 END AS b0,
 CASE WHEN abs(x1 - wx1) <= 0.001 THEN x1 ELSE x1 - 1 END AS a1, CASE WHEN abs(y1 - wy1) <= 0.001 THEN y1 ELSE y1 - 1 END AS b1 FROM tiles CROSS JOIN (SELECT min(x0) AS wx0, min(y0) AS wy0, max(x1) AS wx1, max(y1) AS wy1 FROM tiles)))"""
JOINED = "SELECT s.*, k.x0, k.y0, k.x1, k.y1, k.kx0, k.ky0, k.kx1, k.ky1 FROM tile_stems s JOIN keep k ON k.ti = s.ti AND k.tj = s.tj"


def _clip(a: str, lo: str, hi: str) -> tuple[str, str]:
    """Parameter range of an edge between lo and hi on an axis (a: its coordinate, a2 the next node's)."""
    t1, t2 = f"({lo} - {a}) / ({a}2 - {a})", f"({hi} - {a}) / ({a}2 - {a})"
    inside = f"{a} BETWEEN {lo} AND {hi}"
    return (f"CASE WHEN {a}2 = {a} THEN CASE WHEN {inside} THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END ELSE least({t1}, {t2}) END", f"CASE WHEN {a}2 = {a} THEN CASE WHEN {inside} THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ELSE greatest({t1}, {t2}) END")


_cx, _cy = _clip("x", "kx0", "kx1"), _clip("y", "ky0", "ky1")
KEPT = f"""SELECT * FROM joined WHERE (ti, tj, stem_id) IN (SELECT (ti, tj, stem_id) FROM joined JOIN (SELECT stem_id, x, y, x2, y2 FROM linked WHERE x2 IS NOT NULL) e USING (stem_id)
 WHERE greatest({_cx[0]}, {_cy[0]}, 0.0::DOUBLE) <= least({_cx[1]}, {_cy[1]}, 1.0::DOUBLE))"""
BAND = "SELECT *, (maxx >= x0 AND minx <= x1 AND maxy >= y0 AND miny <= y1) AND NOT (minx > x0 + 1 AND maxx < x1 - 1 AND miny > y0 + 1 AND maxy < y1 - 1) AS on_edge FROM joined"
SEAM = ("keep", KEEP, "joined", JOINED, "linked", LINKED)


def _unit(ax: str, ay: str, bx: str, by: str) -> tuple[str, str]:
    n = f"(sqrt(({bx}-{ax})*({bx}-{ax})+({by}-{ay})*({by}-{ay})) + CAST(2.220446049250313e-16 AS DOUBLE))"
    return f"(({bx}-{ax})/{n})", f"(({by}-{ay})/{n})"


def _angle(u: tuple[str, str], v: tuple[str, str]) -> str:
    return f"degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {u[0]}*{v[0]} + {u[1]}*{v[1]}))))"


END_LINES = """SELECT *, CASE WHEN n < 4 THEN p[1] ELSE p[2] END AS s0, CASE WHEN n < 4 THEN p[-1] ELSE p[i + 1] END AS s1, CASE WHEN n < 4 THEN p[1] ELSE p[n - i] END AS e0, CASE WHEN n < 4 THEN p[-1] ELSE p[n - 1] END AS e1,
 p[n - 1] AS inner_stop, p[2] AS inner_start FROM (SELECT *, CASE WHEN n < 8 THEN n - 2 ELSE 6 END AS i FROM ends)"""
_stop, _start = _unit("a.e0.x", "a.e0.y", "a.e1.x", "a.e1.y"), _unit("b.s0.x", "b.s0.y", "b.s1.x", "b.s1.y")
_missing = _unit("a.inner_stop.x", "a.inner_stop.y", "b.inner_start.x", "b.inner_start.y")
PAIRS = f"""SELECT a.stem_id AS base, b.stem_id AS other, sqrt((a.stop_x-b.start_x)*(a.stop_x-b.start_x)+(a.stop_y-b.start_y)*(a.stop_y-b.start_y)) AS gap,
 {_angle(_stop, _start)} AS a1, {_angle(_stop, _missing)} AS a2, {_angle(_missing, _start)} AS a3,
 sqrt((b.stop_x-a.start_x)*(b.stop_x-a.start_x)+(b.stop_y-a.start_y)*(b.stop_y-a.start_y)) AS extent
 FROM lines a JOIN lines b ON a.stem_id <> b.stem_id AND b.start_x BETWEEN a.stop_x - 4 AND a.stop_x + 4 AND b.start_y BETWEEN a.stop_y - 4 AND a.stop_y + 4"""
VOTED = """SELECT base, other, round(gap, 6) AS gap, round((1 + a1 + a2 + a3) / 90.0::DOUBLE * extent * extent + gap * gap * ((1 + a1 + a2 + a3) / 90.0::DOUBLE), 6) AS vote
 FROM (SELECT *, 90.0::DOUBLE * (1 - 1 / sqrt(7.0::DOUBLE - gap)) AS lim FROM pairs WHERE gap < 4) WHERE a1 < lim AND a2 < lim AND a3 < lim AND extent < 32"""
VOTES = ("sp", STEMS_P, "ends", ENDS, "lines", END_LINES, "pairs", PAIRS, "voted", VOTED)

PARTS = """SELECT stem_id, CASE WHEN flip THEN p[-1].y ELSE p[1].y END AS start_r, CASE WHEN flip THEN p[-1].x ELSE p[1].x END AS start_c, CASE WHEN flip THEN p[1].y ELSE p[-1].y END AS stop_r, CASE WHEN flip THEN p[1].x ELSE p[-1].x END AS stop_c, lo_r, lo_c, hi_r, hi_c
 FROM (SELECT *, p[1].y > p[-1].y AS flip FROM sp JOIN (SELECT stem_id, min(y) AS lo_r, min(x) AS lo_c, max(y) AS hi_r, max(x) AS hi_c FROM stem_nodes GROUP BY stem_id) USING (stem_id) WHERE len(p) >= 3)"""

REGISTRY = "SELECT * FROM (VALUES " + ", ".join(f"('{f.lower()}_{p}', '{f}', '{p}', {str(i != 1).lower()}, {1000 * (i + 1)})" for i, (f, ps) in enumerate([("Spruce", ("fp32", "fp16", "int8")), ("Beech", ("fp32", "int8")), ("General", ("fp32",))]) for p in ps) + ") v(id, family, precision, installed, bytes_on_disk)"
REQUESTS = "SELECT o_orderkey AS request_id, (['Spruce','beech','GENERAL','spruce_fp16','BEECH_FP32','Oak'])[(o_custkey % 6 + 1)::INT] AS name, (['fp32','int8'])[(o_orderkey % 2 + 1)::INT] AS want FROM orders"

BYTES = "regexp_extract(line, '{}', {})"
P_LINE, V_LINE, R_LINE = r"^\s*(?:Written tile|Multi-GPU prediction) (\d+)/(\d+) \|", r"^\s*Vector tiles (\d+)/(\d+) \|", r"^\s*Prepared (\d+)/(\d+) vector tiles"


def _band(lo: int, hi: int, done: str, total: str) -> str:
    return f"CASE WHEN {total} > 0 THEN CAST(floor({float(lo)}::DOUBLE + {float(hi - lo)}::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, {done} / {total}::DOUBLE))) AS BIGINT) ELSE {lo} END"


def _n(pattern: str, k: int) -> str:
    return f"TRY_CAST(regexp_extract(line, '{pattern}', {k}) AS BIGINT)"


SO_FAR = "OVER (PARTITION BY run_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
PARSED = f"SELECT *, last_value({_n(R_LINE, 1)} IGNORE NULLS) {SO_FAR} AS prepared, count(CASE WHEN line LIKE 'MERGE TILE READ | tile %' THEN 1 END) {SO_FAR} AS merged FROM log_lines"
PERCENT = f"""SELECT run_id, line_no, max(least(99, CASE WHEN regexp_matches(line, '{P_LINE}') THEN {_band(2, 57, _n(P_LINE, 1), _n(P_LINE, 2))}
 WHEN regexp_matches(line, '{V_LINE}') THEN {_band(57, 95, _n(V_LINE, 1), _n(V_LINE, 2))}
 WHEN line LIKE 'MERGE TILE READ | tile %' THEN {_band(95, 99, 'merged', 'coalesce(prepared, 0)')} ELSE 0 END)) {SO_FAR} AS percent FROM parsed"""

FRAMED = """SELECT *, y1 >= 30 * tj AND y <= 30 * tj + 30 AND NOT (y > 30 * tj + 1 AND y1 < 30 * tj + 29) AS on_edge
 FROM (SELECT *, y + 2.5::DOUBLE AS y1, unnest(range(CAST(floor((y - 1) / 30) AS BIGINT), CAST(floor((y + 3.5::DOUBLE) / 30) AS BIGINT) + 1)) AS tj FROM fragments) WHERE y1 >= 30 * tj + 1 AND y <= 30 * tj + 29"""
# pieces of a tree on an edge lie in a line: those less than 8 m apart become one stem, and a seam's ones are few
RUNS = "SELECT *, sum(CASE WHEN k - before < 3 THEN 0 ELSE 1 END) OVER (PARTITION BY tree ORDER BY k) AS run FROM (SELECT *, lag(k) OVER (PARTITION BY tree ORDER BY k) AS before FROM (SELECT DISTINCT tree, k, x, y, d FROM framed WHERE on_edge))"
CLOSED = "SELECT *, row_number() OVER w = 1 AS first, lead(k) OVER w IS NULL AS last FROM runs WINDOW w AS (PARTITION BY tree, run ORDER BY k)"
KNOTS = "SELECT tree, run, x, y + 1.25::DOUBLE * i AS y, d FROM closed CROSS JOIN range(3) g(i) WHERE i = 1 OR (i = 0 AND first) OR (i = 2 AND last)"
KNOT_EDGES = "SELECT tree, run, x, y, d, lead(y) OVER w - y AS len, lead(d) OVER w AS d2 FROM knots WINDOW w AS (PARTITION BY tree, run ORDER BY y)"
RECONNECTED = """SELECT NULL AS tile_id, min(x) AS x, min(y) AS y, count(*) AS n_nodes, sum(len) AS length, sum(pi()/12*(d*d+d*d2+d2*d2)*len) AS volume FROM knot_edges GROUP BY tree, run
 UNION ALL SELECT printf('r%05d_c%05d', tj, ti), x, y, 3, 2.5::DOUBLE, pi()/12*3*d*d*2.5::DOUBLE FROM framed WHERE NOT on_edge"""

MASK_TILES = """SELECT DISTINCT CAST(floor((c + dc) / 16) * 64 + floor((r + dr) / 16) AS BIGINT) AS tile_id, r, c FROM mask_pixels CROSS JOIN (VALUES (-2), (2)) a(dr) CROSS JOIN (VALUES (-2), (2)) b(dc)"""
# a tile has 20 rows: no pixel is more than 10 away from an unset one
FAR = """SELECT m.tile_id, m.r, m.c, min(sqrt(i*i + j*j)) AS far FROM mt m CROSS JOIN range(-11, 12) g(i) CROSS JOIN range(-11, 12) h(j)
 LEFT JOIN mt q ON q.tile_id = m.tile_id AND q.r = m.r + i AND q.c = m.c + j WHERE q.r IS NULL GROUP BY m.tile_id, m.r, m.c"""

KEYS = """SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM (SELECT o, i, CASE WHEN x <= 1 THEN 1.5::DOUBLE*x*x*x - 2.5::DOUBLE*x*x + 1 WHEN x < 2 THEN -0.5::DOUBLE*x*x*x + 2.5::DOUBLE*x*x - 4*x + 2 ELSE 0 END AS w
 FROM (SELECT o, i, abs(i - ((o + 0.5::DOUBLE) / 2 - 0.5::DOUBLE)) AS x FROM range(16) a(o) CROSS JOIN range(8) b(i)))"""
TILE_BYTES = "SELECT tile_id, i // 8 AS r, i % 8 AS c, least(255, greatest(0, round(score[i + 1] * 400 + 128))) AS v FROM (SELECT *, unnest(range(64)) AS i FROM score_tiles)"
GROWN = "SELECT tile_id, a.o AS r, b.o AS c, sum(a.w * b.w * v / 255::DOUBLE) AS v FROM tile_bytes t JOIN keys a ON a.i = t.r JOIN keys b ON b.i = t.c WHERE a.o BETWEEN 2 AND 13 AND b.o BETWEEN 2 AND 13 GROUP BY ALL"

ORACLES = {
    "stem_volume": sql("stem_nodes", "SELECT stem_id, count(*) AS n_edges, round(sum(len), 6) AS length, round(sum(pi()/12*(d*d+d*d2+d2*d2)*len), 6) AS volume FROM e GROUP BY stem_id HAVING sum(len) > 2", "linked", LINKED, "e", EDGES),
    "stem_quartiles": sql("stem_nodes", "SELECT stem_id, round(quantile_cont(d, 0.25), 6) AS q1, round(quantile_cont(d, 0.75), 6) AS q3 FROM stem_nodes GROUP BY stem_id"),
    "stem_clean_diameter": sql("stem_nodes", """SELECT f.stem_id, f.node, round(CASE WHEN m.n > 4 AND f.node = 0 AND m.far THEN nx.c WHEN m.n > 4 AND f.node = m.n - 1 AND m.far THEN pv.c ELSE f.c END, 6) AS d FROM fold f JOIN marked m USING (stem_id, node)
 LEFT JOIN fold nx ON nx.stem_id = f.stem_id AND nx.node = f.node + 1 LEFT JOIN fold pv ON pv.stem_id = f.stem_id AND pv.node = f.node - 1""", "linked", LINKED, "bounds", Q_BOUNDS, "marked", MARKED, "fold", FOLD, recursive=True),
    "stem_normals": sql("stem_nodes", "SELECT stem_id, node, round(nx, 6) AS nx, round(ny, 6) AS ny FROM nm", "linked", LINKED, "nm", NORMALS),
    "measurement_vectors": sql("stem_nodes", "SELECT stem_id, node, d, round(x-nx, 6) AS ax, round(y-ny, 6) AS ay, round(x+nx, 6) AS bx, round(y+ny, 6) AS by FROM nm WHERE x-nx <> x+nx OR y-ny <> y+ny", "linked", LINKED, "nm", NORMALS),
    "stem_nodes_layer": sql("stem_nodes", "SELECT stem_id, node, d, x, y FROM stem_nodes WHERE stem_id IN (SELECT stem_id FROM stem_nodes GROUP BY stem_id HAVING count(*) >= 2)"),
    "stem_layer": sql("stem_nodes", """SELECT stem_id, start_x, start_y, stop_x, stop_y, n AS n_nodes, round(coalesce(list_sum(ls), 0), 6) AS length, round(coalesce(list_sum(vs), 0), 6) AS volume, CAST(to_json(list_transform(p, lambda v: v.d)) AS VARCHAR) AS d_json,
 CAST(to_json(list_transform(ls, lambda v: round(v, 6))) AS VARCHAR) AS l_json, len(vs) AS n_v, round(coalesce(list_sum(list_transform(vs, lambda v: round(v, 6))), 0), 6) AS v_total
 FROM (SELECT *, list_transform(range(1, n), lambda i: pi() / 12 * (p[i].d*p[i].d + p[i].d*p[i+1].d + p[i+1].d*p[i+1].d) * ls[i]) AS vs FROM (SELECT *, list_transform(range(1, n), lambda i: sqrt((p[i+1].x-p[i].x)*(p[i+1].x-p[i].x)+(p[i+1].y-p[i].y)*(p[i+1].y-p[i].y))) AS ls FROM ends))""", "sp", STEMS_P, "ends", ENDS),
    "json_list_decode": sql("stem_nodes", "SELECT stem_id, CASE WHEN stem_id % 7 = 0 OR stem_id % 11 = 0 THEN 0 ELSE n END AS n, round(CASE WHEN stem_id % 7 = 0 OR stem_id % 11 = 0 THEN 0.0 ELSE list_sum(list_transform(p, lambda v: v.d)) END, 6) AS total FROM ends", "sp", STEMS_P, "ends", ENDS),
    "merge_diameters": sql("stem_nodes", "SELECT a.stem_id AS a, b.stem_id AS b, CASE WHEN a.stem_id % 5 = 0 THEN 0 ELSE a.n + b.n - 2 END AS n, round(CASE WHEN a.stem_id % 5 = 0 THEN 0.0 ELSE list_sum(list_transform(a.p, lambda v: v.d)) - a.p[-1].d + list_sum(list_transform(b.p, lambda v: v.d)) - b.p[1].d END, 6) AS total FROM ends a JOIN ends b ON b.stem_id = a.stem_id + 1", "sp", STEMS_P, "ends", ENDS),
    "tile_layout": sql("raster_info", "SELECT raster_id, px_per_tile_x, px_per_tile_y, round(overlap_img_x, 6) AS overlap_img_x, round(overlap_img_y, 6) AS overlap_img_y, x_tiles, y_tiles, x_tiles*504+8 AS out_width, y_tiles*504+8 AS out_height, round(px*px_per_tile_x/512.0::DOUBLE, 6) AS out_px, round(py*px_per_tile_y/512.0::DOUBLE, 6) AS out_py FROM layout", "layout", LAYOUT),
    "tile_jobs": sql("raster_info", "SELECT * EXCLUDE (n) FROM jobs", "layout", LAYOUT, "jobs", JOBS),
    "tile_estimate": sql("raster_info", "SELECT raster_id, CASE WHEN raster_id % 9 = 0 THEN 0 ELSE greatest(x_tiles * y_tiles, 1) END AS n_tiles FROM layout", "layout", LAYOUT),
    "vector_tiles": sql("raster_info", """SELECT raster_id, printf('raster_r%05d_c%05d', y0 // 4096, x0 // 4096) AS tile_id, x0, y0, x1, y1, greatest(0, x0 - halo) AS hx0, greatest(0, y0 - halo) AS hy0, least(width, x1 + halo) AS hx1, least(height, y1 + halo) AS hy1
 FROM (SELECT *, least(x0 + 4096, width) AS x1, least(y0 + 4096, height) AS y1 FROM (SELECT *, unnest(range(0, width, 4096)) AS x0 FROM (SELECT *, unnest(range(0, height, 4096)) AS y0, CAST(ceil(12.0::DOUBLE / greatest(px, py)) AS BIGINT) AS halo FROM raster_info)))"""),
    "job_shards": sql("raster_info", "SELECT raster_id, shard, min(tile_index) AS first, count(*) AS n FROM (SELECT *, (SELECT count(*) FROM range(1, 8) g(i) WHERE round_even(i * n / 7.0::DOUBLE, 0) <= tile_index) AS shard FROM jobs) GROUP BY raster_id, shard", "layout", LAYOUT, "jobs", JOBS),
    "pixel_to_world": sql("raster_info", "SELECT raster_id, r, c, round(origin_x + c * px, 6) AS x, round(origin_y - r * py, 6) AS y FROM (SELECT *, unnest([0, width]) AS c FROM (SELECT *, unnest([0, height]) AS r FROM raster_info))"),
    "binarize_core": sql("score_tiles", "SELECT tile_id, CAST((i // 8 - 2) * 4 + i % 8 - 2 AS BIGINT) AS i, CAST(CASE WHEN score[i + 1] >= 0.05::DOUBLE AND (i + tile_id) % 5 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS v FROM (SELECT *, unnest(range(64)) AS i FROM score_tiles) WHERE i // 8 BETWEEN 2 AND 5 AND i % 8 BETWEEN 2 AND 5"),
    "valid_mask": sql("score_tiles", "SELECT tile_id, count(CASE WHEN (score[i + 1] > 0.1::DOUBLE OR score[i + 1] < -0.1::DOUBLE) AND (tile_id % 3 <> 0 OR i % 4 <> 0) THEN 1 END) AS n_valid FROM (SELECT *, unnest(range(64)) AS i FROM score_tiles) GROUP BY tile_id"),
    "empty_tile_prune": sql("score_tiles", "SELECT tile_id FROM score_tiles WHERE list_max(score) >= 0.3::DOUBLE"),
    "neighbor_degree": sql("mask_pixels", "SELECT r, c, CAST(n0+n1+n2+n3+n4+n5+n6+n7 AS BIGINT) AS degree FROM ring", *MASK),
    "skeleton_nodes": sql("mask_pixels", "SELECT *, CASE WHEN transitions = 1 THEN 'end' WHEN transitions >= 3 THEN 'branch' END AS kind FROM kinds", *MASK, "kinds", KINDS),
    "dense_removal": sql("mask_pixels", "SELECT r, c FROM ring WHERE NOT (n0 = 1 AND n6 = 1 AND n7 = 1)", *MASK),
    "branch_clear_round": sql("mask_pixels", "SELECT p.r, p.c FROM mask_pixels p WHERE NOT EXISTS (SELECT 1 FROM kinds k WHERE k.transitions >= 3 AND abs(k.r - p.r) <= 1 AND abs(k.c - p.c) <= 1)", *MASK, "kinds", KINDS),
    "part_canonical": sql("stem_nodes", "SELECT start_r, start_c, stop_r, stop_c, lo_r, lo_c, hi_r, hi_c, min(stem_id) AS stem_id FROM parts GROUP BY ALL", "sp", STEMS_P, "parts", PARTS),
    "keep_region": sql("tiles", "SELECT ti, tj, kx0, ky0, kx1, ky1 FROM keep", "keep", KEEP),
    "seam_filter": sql("tile_stems", "SELECT ti, tj, stem_id, n_nodes FROM kept", *SEAM, "kept", KEPT),
    "edge_band_split": sql("tile_stems", "SELECT ti, tj, stem_id, on_edge FROM band", *SEAM, "band", BAND),
    "child_semi_join": sql("tile_stems", "SELECT stem_id, node, d FROM stem_nodes WHERE stem_id IN (SELECT stem_id FROM kept)", *SEAM, "kept", KEPT),
    "global_ids": sql("tile_stems", "SELECT concat(printf('r%05d_c%05d', tj, ti), '_', CAST(stem_id AS VARCHAR)) AS global_id, n_nodes FROM kept", *SEAM, "kept", KEPT),
    "merge_union": sql("tile_stems", "SELECT ti, tj, stem_id, 'inner' AS part FROM band WHERE NOT on_edge UNION ALL SELECT -1, -1, stem_id, 'edge' FROM (SELECT DISTINCT stem_id FROM band WHERE on_edge)", *SEAM, "band", BAND),
    "merge_summary": sql("tile_stems", "SELECT count(DISTINCT (ti, tj)) AS n_tiles, count(*) AS n_stems, CAST(sum(n_nodes) AS BIGINT) AS n_nodes FROM kept", *SEAM, "kept", KEPT),
    "endpoint_candidates": sql("stem_nodes", "SELECT * FROM (SELECT a.stem_id AS base, b.stem_id AS other, round(sqrt((a.stop_x-b.start_x)*(a.stop_x-b.start_x)+(a.stop_y-b.start_y)*(a.stop_y-b.start_y)), 6) AS gap FROM ends a JOIN ends b ON a.stem_id <> b.stem_id AND b.start_x BETWEEN a.stop_x - 1 AND a.stop_x + 1 AND b.start_y BETWEEN a.stop_y - 1 AND a.stop_y + 1) WHERE gap < 1", "sp", STEMS_P, "ends", ENDS),
    "connect_votes": sql("stem_nodes", "SELECT * FROM voted", *VOTES),
    "best_candidate": sql("stem_nodes", "SELECT base, arg_min(other, row(vote, other)) AS other, min(vote) AS vote FROM voted GROUP BY base", *VOTES),
    "best_either": sql("stem_nodes", "SELECT base, arg_min(other, row(vote, other)) AS other, min(vote) AS vote FROM (SELECT base, other, vote FROM voted UNION ALL SELECT other, base, vote FROM voted) GROUP BY base", *VOTES),
    "merge_reconnect": sql("fragments", "SELECT row_number() OVER (ORDER BY x, y) - 1 AS stem_id, tile_id, n_nodes, round(length, 6) AS length, round(volume, 6) AS volume FROM merged", "framed", FRAMED, "runs", RUNS, "closed", CLOSED, "knots", KNOTS, "knot_edges", KNOT_EDGES, "merged", RECONNECTED),
    "tile_timing": sql("tile_metrics", "SELECT status, round(median(total_s), 6) AS median_s FROM tile_metrics GROUP BY status"),
    "input_check": sql("raster_info", """SELECT raster_id, round(gb, 6) AS gigabytes, raster_id % 4 <> 0 AS usable, concat_ws(', ', CASE WHEN raster_id % 4 = 0 THEN 'not projected' WHEN px > 0.05::DOUBLE OR 2 * py > 0.05::DOUBLE THEN 'coarse pixels' END, CASE WHEN raster_id % 3 = 0 AND gb >= 2 THEN 'no overviews' END) AS notes
 FROM (SELECT *, width * height * bands * (1 + 16 * (raster_id % 5)) / 1073741824::DOUBLE AS gb FROM raster_info)"""),
    "content_windows": sql("score_tiles", """SELECT raster_id, row, col, std, place FROM (SELECT *, row_number() OVER (PARTITION BY raster_id ORDER BY std DESC, col DESC, row DESC) - 1 AS place, greatest(1, count(*) OVER (PARTITION BY raster_id) // 9) AS step
 FROM (SELECT tile_id % 10 AS raster_id, tile_id AS row, tile_id % 7 AS col, round(list_aggregate(score::DOUBLE[], 'stddev_pop'), 6) AS std FROM score_tiles)) WHERE place % step = 0 AND place // step < 3"""),
    "written_cores": sql("raster_info", """SELECT raster_id, tile_index, dst_row, dst_col, least(504, y_tiles * 504 + 8 - 300 * (raster_id % 3) - dst_row) AS write_height, least(504, x_tiles * 504 + 8 - 600 * (raster_id % 2) - dst_col) AS write_width
 FROM jobs JOIN (SELECT raster_id, x_tiles, y_tiles FROM layout) USING (raster_id) WHERE write_height > 0 AND write_width > 0""", "layout", LAYOUT, "jobs", JOBS),
    "mask_agreement": sql("score_tiles", """SELECT tile_id, n_a, n_b, n_both, round(CASE WHEN n_a + n_b > n_both THEN n_both / (n_a + n_b - n_both)::DOUBLE ELSE 1 END, 6) AS iou FROM (SELECT tile_id, count(CASE WHEN a THEN 1 END) AS n_a, count(CASE WHEN b THEN 1 END) AS n_b, count(CASE WHEN a AND b THEN 1 END) AS n_both
 FROM (SELECT tile_id, v >= 0.05::DOUBLE AS a, v <= 0.1::DOUBLE AND v >= 0 AS b FROM (SELECT tile_id, unnest(score) AS v FROM score_tiles)) GROUP BY tile_id)"""),
    "edt_nodes": sql("mask_pixels", "SELECT m.tile_id AS group_id, concat(m.r, '_', m.c) AS stem_id, CASE WHEN far IS NULL THEN 0.0::DOUBLE ELSE round(2 * least(0.25::DOUBLE * far, 0.3::DOUBLE), 6) END AS d FROM mt m LEFT JOIN far f ON f.tile_id = m.tile_id AND f.r = m.r + 1 AND f.c = m.c", "mt", MASK_TILES, "far", FAR),
    "edt_diameters": sql("mask_pixels", "SELECT tile_id, r, c, round(2 * far, 6) AS d FROM far", "mt", MASK_TILES, "far", FAR),
    "contour_diameters": sql("mask_pixels", "SELECT m.tile_id, m.c * 64 + m.r AS line_id, CASE WHEN q.r IS NULL THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS d FROM mt m LEFT JOIN mt q ON q.tile_id = m.tile_id AND q.r = m.r + 1 AND q.c = m.c", "mt", MASK_TILES),
    "segment_tiles": sql("score_tiles", "SELECT g.tile_id, g.r - 2 AS r, g.c - 2 AS c FROM grown g JOIN tile_bytes n ON n.tile_id = g.tile_id AND n.r = g.r // 2 AND n.c = g.c // 2 WHERE g.v >= 0.5::DOUBLE AND n.v <> 0", "keys", KEYS, "tile_bytes", TILE_BYTES, "grown", GROWN),
    "dedup_contained": sql("stems", "SELECT stem_id, r AS row FROM st a WHERE NOT EXISTS (SELECT 1 FROM st b WHERE b.r = a.r AND (b.len > a.len OR (b.len = a.len AND b.stem_id < a.stem_id)) AND b.minx <= a.minx + 0.3::DOUBLE AND b.maxx >= a.maxx - 0.3::DOUBLE)", "st", "SELECT stem_id, minx, maxx, CAST(floor(miny) AS BIGINT) AS r, maxx - minx AS len FROM stems"),
    "tile_metrics": sql("tile_metrics", "SELECT status, count(*) AS n_tiles, count(CASE WHEN fg_count = 0 THEN 1 END) AS n_empty, CAST(sum(segment_count) AS BIGINT) AS n_segments, CAST(sum(stem_count) AS BIGINT) AS n_stems, round(avg(total_s), 6) AS mean_s, round(sum(total_s), 6) AS sum_s FROM tile_metrics GROUP BY status"),
    "registry_resolve": sql("", """SELECT request_id, name, want, coalesce((SELECT id FROM reg WHERE id = name), (SELECT id FROM reg WHERE family = name AND precision = want), (SELECT id FROM reg WHERE lower(id) = lower(name)), (SELECT id FROM reg WHERE lower(family) = lower(name) AND precision = want)) AS id FROM req""", "reg", REGISTRY, "req", REQUESTS),
    "family_summary": sql("", "SELECT family, count(*) AS n_models, count(CASE WHEN installed THEN 1 END) AS n_present, CAST(sum(bytes_on_disk) AS BIGINT) AS bytes FROM reg GROUP BY family", "reg", REGISTRY),
    "plan_mode": """SELECT *, CASE WHEN lower(backend) = 'cpu' OR gpus <= 0 THEN 'cpu_stream' WHEN gpus = 1 OR lower(backend) = 'single_gpu' THEN 'stream' ELSE 'multi_gpu_stream' END AS mode
 FROM (SELECT c_custkey AS job_id, (['auto','cpu','single_gpu','MULTI_GPU'])[(c_custkey % 4 + 1)::INT] AS backend, CAST(c_nationkey % 3 AS BIGINT) AS gpus FROM customer)""",
    "output_ladder": "SELECT c_custkey AS job_id, CASE WHEN c_custkey % 5 = 0 THEN 'Nodes' WHEN c_custkey % 3 = 0 THEN 'Trees' ELSE 'Stems' END AS kind FROM customer",
    "progress_percent": sql("log_lines", PERCENT, "parsed", PARSED),
    "gpu_failure_flag": sql("log_lines", "SELECT run_id, line_no, regexp_matches(lower(line), 'cudnn|cublas|cufft|curand|cusparse|cuda error|cudaerror|cuda_error') AND NOT regexp_matches(lower(line), 'out of memory|failed to allocate memory') AS failed FROM log_lines"),
}
