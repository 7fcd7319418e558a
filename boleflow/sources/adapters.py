"""Views that give the driver's star-schema tables the shape of this engine's data model.

Each view is one SQL text that Spark and DuckDB both run; oracles use the same texts as
common table expressions. They read whole tables. The world grows with them: a fallen
tree for each order key lies 40 m from the next, in pieces of 2.5 m with gaps of 1 m; each plot of
25 m has the stems of 16 order keys, 32 plots lie in a row, and the mask gets a further field
of 64 x 64 pixels for every 6000 order keys (foreground: a score of 0.98 or more).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "stem_nodes": """SELECT CAST(l_orderkey AS BIGINT) AS stem_id,
 CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS BIGINT) AS node,
 CAST(l_partkey % 100 + 100 * (CAST(floor(l_orderkey / 16) AS BIGINT) % 32) AS DOUBLE) * CAST(0.25 AS DOUBLE) AS x, CAST(l_suppkey % 100 + 100 * CAST(floor(l_orderkey / 512) AS BIGINT) AS DOUBLE) * CAST(0.25 AS DOUBLE) AS y,
 l_quantity / CAST(100 AS DOUBLE) AS d FROM lineitem""",
    "mask_pixels": """SELECT DISTINCT CAST(l_partkey % 64 AS BIGINT) AS r, CAST(l_orderkey % 64 + 64 * CAST(floor(l_orderkey / 6000) AS BIGINT) AS BIGINT) AS c
 FROM lineitem WHERE l_quantity / CAST(50 AS DOUBLE) >= CAST(0.98 AS DOUBLE)""",
    "score_tiles": "SELECT vec_id AS tile_id, embedding AS score FROM embeddings",
    "raster_info": """SELECT CAST(p_partkey AS BIGINT) AS raster_id, CAST(2000 + 137 * p_size AS BIGINT) AS width, CAST(1500 + 211 * (p_partkey % 17) AS BIGINT) AS height,
 CAST(3 AS BIGINT) AS bands, CAST(10 + p_partkey % 41 AS DOUBLE) / CAST(1000 AS DOUBLE) AS px, CAST(10 + p_partkey % 37 AS DOUBLE) / CAST(1000 AS DOUBLE) AS py,
 CAST(400000 + 10 * p_partkey AS DOUBLE) AS origin_x, CAST(5900000 - 10 * p_partkey AS DOUBLE) AS origin_y FROM part""",
    "stems": """SELECT stem_id, count(*) AS n_nodes, min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy,
 max(CASE WHEN node = 0 THEN x END) AS start_x, max(CASE WHEN node = 0 THEN y END) AS start_y FROM stem_nodes GROUP BY stem_id HAVING count(*) >= 2""",
    "tiles": """SELECT DISTINCT CAST(floor(x / 5) AS BIGINT) AS ti, CAST(floor(y / 5) AS BIGINT) AS tj,
 CAST(floor(x / 5) * 5 AS DOUBLE) AS x0, CAST(floor(y / 5) * 5 AS DOUBLE) AS y0, CAST(floor(x / 5) * 5 + 5 AS DOUBLE) AS x1, CAST(floor(y / 5) * 5 + 5 AS DOUBLE) AS y1 FROM stem_nodes""",
    "tile_stems": """SELECT t.ti, t.tj, s.* FROM tiles t JOIN stems s ON s.maxx >= t.x0 - 1 AND s.minx <= t.x1 + 1 AND s.maxy >= t.y0 - 1 AND s.miny <= t.y1 + 1""",
    "fragments": """SELECT tree, k, CAST(40 * (tree % 256) AS DOUBLE) + CAST(tree % 5 AS DOUBLE) / CAST(50 AS DOUBLE) AS x,
 CAST(60 * CAST(floor(tree / 256) AS BIGINT) + 7 * (tree % 5) AS DOUBLE) + CAST(k AS DOUBLE) * CAST(3.5 AS DOUBLE) AS y, d, tree % 256 AS ti
 FROM (SELECT CAST(l_orderkey AS BIGINT) AS tree, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS BIGINT) AS k,
 l_quantity / CAST(100 AS DOUBLE) AS d FROM lineitem) f""",
    "log_lines": """SELECT user_id AS run_id, event_id AS line_no, ts, CASE event_type WHEN 'view' THEN concat('Written tile ', CAST(k AS VARCHAR(20)), '/', CAST(n AS VARCHAR(20)), ' | x')
 WHEN 'click' THEN concat('Vector tiles ', CAST(k AS VARCHAR(20)), '/', CAST(n AS VARCHAR(20)), ' | x') WHEN 'purchase' THEN 'MERGE TILE READ | tile r0' WHEN 'signup' THEN concat('Prepared ', CAST(n AS VARCHAR(20)), '/', CAST(n AS VARCHAR(20)), ' vector tiles') ELSE 'CUDNN_BACKEND_API_FAILED' END AS line
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) e""",
    "tile_metrics": """SELECT CAST(o_custkey AS BIGINT) AS tile_id, CAST(o_orderkey % 7 AS BIGINT) AS fg_count, CAST(o_orderkey % 5 AS BIGINT) AS segment_count,
 CAST(o_orderkey % 3 AS BIGINT) AS stem_count, o_totalprice / CAST(100000 AS DOUBLE) AS total_s, o_orderstatus AS status FROM orders""",
}
NEEDS = {"stems": ["stem_nodes"], "tiles": ["stem_nodes"], "tile_stems": ["stem_nodes", "stems", "tiles"]}


def ctes(*names: str) -> str:
    """A WITH clause's body for the views and what they need."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in [*NEEDS.get(n, []), n] if x not in wanted]
    return ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = f"WITH {ctes(name)} SELECT * FROM {name}"
    return spark.sql(re.sub(r"FROM (lineitem|embeddings|part|events|orders)\b", lambda m: f"FROM parquet.`{sf_dir}/{m[1]}.parquet`", sql))
