"""Exact top-k search over binary codes by incremental multi-index hashing.

A code has 64 bits in SEGMENTS segments; each block of the table holds an index from a
segment's value to its rows. A query looks up the values at distance 0 from its own in
every segment, then at 1, and so on. After radius s all codes within
SEGMENTS * (s + 1) - 1 bits have been met; once the k-th verified distance is no more
than that, the block's answer is exact, ties included. Blocks' answers are merged by
an aggregation with k rows a query and block. No cap is set on candidates.

The stated query set meets all rows in blocks. A task holds one block of rows and one group
of queries, both of a bounded size; a group's rows are dealt once for each group of queries.

Defined cases: a null vector has no code, and neither it nor a row without an id is found or
asked for. A query that is there twice is asked once. A vector of more than 64 values fails.
Missing values count as not positive. Ties go to the lesser id; repeated rows are found one
by one. With fewer than k rows a query gets them all. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare, tasks_for

K = 10
BITS = 64
SEGMENTS = 4
WIDTH = BITS // SEGMENTS
#: Rows of a block, and queries that a block searches at once.
BLOCK_ROWS = 200_000
QUERY_ROWS = 256
#: Queries of a group: what a task holds of them.
GROUP_ROWS = 100_000
SCHEMA = "query_id long, vec_id long, distance int"


def sign_code(vector: Column) -> Column:
    """Bit i is set where value i is positive. A vector of more than 64 values fails: it is never cut."""
    fits = F.when(F.size(vector) > BITS, F.raise_error(F.lit(f"a code has {BITS} bits: a vector has more values"))).otherwise(vector)
    return F.aggregate(
        fits,
        F.struct(F.lit(0).cast("long").alias("c"), F.lit(0).alias("i")),
        lambda a, v: F.struct(a["c"].bitwiseOR(F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), a["i"])).otherwise(F.lit(0).cast("long"))).alias("c"), (a["i"] + 1).alias("i")),
    )["c"]


def flips(radius: int) -> np.ndarray:
    """All segment values with so many bits set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(WIDTH), radius)], np.int64)


class Index:
    """A block's codes, by the value of each segment."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        self.ids, self.codes, self.order, self.offsets = ids, codes, [], []
        for s in range(SEGMENTS):
            value = self.segment(codes, s)
            self.order.append(np.argsort(value, kind="stable"))
            self.offsets.append(np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << WIDTH))]))

    @staticmethod
    def segment(codes: np.ndarray, s: int) -> np.ndarray:
        return (codes >> np.uint64(s * WIDTH) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)

    def candidates(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) that agree up to exactly radius bits in some segment."""
        out = []
        for s in range(SEGMENTS):
            keys = (self.segment(queries, s)[:, None] ^ flips(radius)[None, :]).ravel()
            begin, size = self.offsets[s][keys], self.offsets[s][keys + 1] - self.offsets[s][keys]
            owner = np.repeat(np.arange(len(keys)) // (len(keys) // len(queries)), size)
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            out.append((owner, self.order[s][np.repeat(begin, size) + inside]))
        return np.concatenate([o for o, _ in out]), np.concatenate([r for _, r in out])

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of the k nearest rows of each query."""
        n, done = len(self.codes), []
        active = np.arange(len(queries))
        held = [np.zeros(0, np.int64)] * 3
        for radius in range(WIDTH + 1):
            q, row = self.candidates(queries[active], radius)
            q = active[q]
            d = np.bitwise_count(queries[q] ^ self.codes[row]).astype(np.int64)
            q, row, d = (np.concatenate(x) for x in zip(held, (q, row, d), strict=True))
            order = np.lexsort((row, self.ids[row], d, q))
            q, row, d = q[order], row[order], d[order]
            new = np.ones(len(q), bool)  # a row may be met in several segments
            new[1:] = (q[1:] != q[:-1]) | (row[1:] != row[:-1])
            q, row, d = q[new], row[new], d[new]
            first = np.searchsorted(q, q)
            place = np.arange(len(q)) - first
            q, row, d, place = (x[place < k] for x in (q, row, d, place))
            need = min(k, n)
            full = (place == need - 1) & (d <= SEGMENTS * (radius + 1) - 1)
            settled = np.isin(q, q[full])
            done.append((q[settled], row[settled], d[settled]))
            held = [x[~settled] for x in (q, row, d)]
            active = active[~np.isin(active, q[full])]
            if not len(active):
                break
        done.append(tuple(held))
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def search(rows: DataFrame, queries: DataFrame, k: int = K, group_rows: int = GROUP_ROWS) -> DataFrame:
    """rows (vec_id, code) and queries (query_id, code): the k nearest of each query, by rank."""
    spark = rows.sparkSession
    prepare(spark)
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")) // 2, -(-rows.count() // BLOCK_ROWS))
    groups = max(1, -(-queries.count() // group_rows))
    tasks = tasks_for(spark, blocks * groups)  # said, so that blocks are not folded into one task
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    dealt = rows.filter("code IS NOT NULL AND vec_id IS NOT NULL").select(F.pmod(F.xxhash64("vec_id", "code"), F.lit(blocks)).cast("int").alias("block"), every(groups, "part"), "vec_id", "code").repartition(tasks, "block", "part")
    asked = queries.filter("code IS NOT NULL AND query_id IS NOT NULL").select("query_id", "code").distinct().select(every(blocks, "block"), F.pmod(F.xxhash64("query_id", "code"), F.lit(groups)).cast("int").alias("part"), "query_id", "code").repartition(tasks, "block", "part")

    def run(base: pa.Table, query: pa.Table) -> pa.Table:
        got = []
        if base.num_rows and query.num_rows:
            index = Index(base.column("vec_id").to_numpy(), base.column("code").to_numpy().view(np.uint64))
            ids, codes = query.column("query_id").to_numpy(), query.column("code").to_numpy().view(np.uint64)
            for at in range(0, len(codes), QUERY_ROWS):
                q, row, d = index.search(codes[at : at + QUERY_ROWS], k)
                got.append((ids[at + q], index.ids[row], d))
        q, v, d = (np.concatenate(x) for x in zip(*got, strict=True)) if got else [np.zeros(0, np.int64)] * 3
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "distance": pa.array(d, pa.int32())})

    near = dealt.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(run, SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.col("distance").cast("long").alias("distance"))


def coded(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    return embeddings.select(F.col(id_col).cast("long").alias("vec_id"), sign_code(F.col(vector_col)).alias("code"))
