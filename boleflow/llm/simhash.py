"""SimHash near-duplicates, linked through a Gray-order hierarchical index.

A fingerprint has 64 bits: bit i is set if more than half of the document's shingle
hashes (XXH64, seed 42) have it. Distinct fingerprints alone are linked. Two of them that
differ in at most `bits` bits agree on at least `blocks - bits` of `blocks` blocks; each
combination of so many blocks is a root under which candidates meet, so that a root's
members are spread over the cluster by their bits.

Under a root the fingerprints are sorted by Gray rank. Runs that share their leading 8,
16, ... bits form the upper nodes of a tree, which hold the shared bits once. Pairs of
nodes are walked from the root down, adding up the differences of their shared bits; a
pair of groups over the limit is dropped with all that is below it, and so is a pair
whose members are known to be connected. A root sends out a spanning forest, never all
its pairs.

Defined cases: null and empty text, and text without a word, have the fingerprint 0 and
are linked like any other. Repeated rows share a fingerprint and so a component. An empty
table gives an empty result. Very long texts are hashed whole, in slices.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, binary, materialise
from .components import components

SEED = 42
SHINGLE = 4
BITS = 4
#: From so many members on a root is first linked along short cuts.
DENSE = 256
STEP = 8
CHUNK = 1 << 20
LEVELS = 64 // STEP
#: Blocks beyond the bits that may differ: so many blocks a root's members share. With 4
#: bits a root is 21 of the 64 bits, whatever the size of the input.
SPARE = 2
#: Candidates that a task holds, on average.
ROWS = 1_000_000


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of the word shingles of a UTF-8 text, A-Z lower-cased, in slices; none without a word."""
    import xxhash

    words = text.lower().split()
    if not words:
        return
    n = max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        yield np.array([digest(flat[a:b], SEED) for a, b in zip(starts[at : min(n, at + (1 << 16))], ends[at : at + (1 << 16)], strict=False)], np.uint64)


def fold(slices: Iterable[np.ndarray]) -> int:
    """64-bit SimHash of the hashes."""
    n, counts = 0, np.zeros(64, np.int64)
    for h in slices:
        n += len(h)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, A-Z lower-cased."""
    return fold(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t or b"", shingle) for t in binary(batch, "t")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return arrow_map(docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as t"), run, "doc_id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the order of the reflected Gray code."""
    r = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class _Forest:
    """Union-find over 0..n-1 by arrays; labels are least members."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> bool:
        changed = False
        while len(a):
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return changed
            changed = True
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (jumped := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = jumped
        return changed


def _short_cuts(fp: np.ndarray, forest: _Forest, at: int, end: int, bits: int) -> None:
    """Links inside a dense root that need no pairs: one bit apart, or all near one point."""
    part, index = fp[at:end], np.arange(at, end)
    for i in range(64):
        masked = part & ~np.uint64(1 << i)
        order = np.argsort(masked, kind="stable")
        same = np.flatnonzero(masked[order][1:] == masked[order][:-1])
        forest.link(index[order[same]], index[order[same + 1]])
    left = index
    for _ in range(8):  # members within bits // 2 of one point are within bits of each other
        ones = np.unpackbits(fp[left].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        centre = np.packbits(ones * 2 > len(left), bitorder="little").view(np.uint64)[0]
        near = np.bitwise_count(fp[left] ^ centre) <= bits // 2
        ball = left[near]
        if len(ball) < 2:
            return
        forest.link(np.full(len(ball) - 1, ball[0]), ball[1:])
        left = left[~near]
        if len(left) < DENSE:
            return


def link_roots(root: np.ndarray, fp: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning-forest edges among equal roots' fingerprints at most bits apart."""
    order = np.lexsort((gray_rank(fp), root))
    root, fp = root[order], fp[order]
    n = len(fp)
    forest = _Forest(n)
    new = np.ones(n, bool)
    new[1:] = root[1:] != root[:-1]
    starts = [np.flatnonzero(new)]  # by level, where nodes begin
    for level in range(1, LEVELS + 1):
        shift = np.uint64(64 - STEP * level)
        new[1:] |= (fp[1:] >> shift) != (fp[:-1] >> shift)
        starts.append(np.flatnonzero(new))
    sizes = np.diff(np.append(starts[0], n))
    for r in np.flatnonzero(sizes >= DENSE):
        _short_cuts(fp, forest, starts[0][r], starts[0][r] + sizes[r], bits)
    first_child = [np.searchsorted(starts[k + 1], starts[k]) for k in range(LEVELS)]
    n_children = [np.diff(np.append(first_child[k], len(starts[k + 1]))) for k in range(LEVELS)]
    least = most = []

    def known() -> None:
        nonlocal least, most
        least = [np.minimum.reduceat(forest.label, s) for s in starts]
        most = [np.maximum.reduceat(forest.label, s) for s in starts]

    if n:
        known()
    roots = np.flatnonzero(sizes > 1)
    stack = [(0, roots, roots, np.zeros(len(roots), np.int64))]
    changed = 0
    while stack:
        level, a, b, acc = stack.pop()
        if not len(a):
            continue
        if level == LEVELS:
            apart = a < b
            changed += forest.link(starts[level][a[apart]], starts[level][b[apart]])
            if changed >= 8:
                known()
                changed = 0
            continue
        open_ = ~((least[level][a] == most[level][b]) & (most[level][a] == least[level][b]) & (least[level][a] == least[level][b]))
        a, b, acc = a[open_], b[open_], acc[open_]
        if not len(a):
            continue
        total = n_children[level][a] * n_children[level][b]
        done = np.cumsum(total)
        if done[-1] > CHUNK and len(a) > 1:  # bounds memory: half now, half later
            cut = min(len(a) - 1, max(1, int(np.searchsorted(done, CHUNK))))
            stack.append((level, a[cut:], b[cut:], acc[cut:]))
            a, b, acc, total, done = a[:cut], b[:cut], acc[:cut], total[:cut], done[:cut]
        pair = np.repeat(np.arange(len(a)), total)
        inside = np.arange(done[-1]) - np.repeat(done - total, total)
        width = n_children[level][b][pair]
        x = first_child[level][a][pair] + inside // width
        y = first_child[level][b][pair] + inside % width
        shift = np.uint64(64 - STEP * (level + 1))
        differ = (fp[starts[level + 1][x]] ^ fp[starts[level + 1][y]]) >> shift & np.uint64((1 << STEP) - 1)
        acc = acc[pair] + np.bitwise_count(differ)
        keep = (acc <= bits) & (x <= y)
        if level + 1 == LEVELS:
            keep &= x != y
        stack.append((level + 1, x[keep], y[keep], acc[keep]))
    linked = np.flatnonzero(forest.label != np.arange(n))
    return fp[linked], fp[forest.label[linked]]


def link(fps: DataFrame, bits: int = BITS, blocks: int | None = None) -> DataFrame:
    """(a, b): pairs of distinct fingerprints (column fp) whose closure is that of all links."""
    n, blocks = fps.count(), blocks or bits + SPARE
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - bits):
        m = 0
        for c in chosen:
            m |= ((1 << (cuts[c + 1] - cuts[c])) - 1) << cuts[c]
        masks.append(m - (1 << 64) if m >> 63 else m)
    roots = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)]))
    spread = fps.select("fp", roots.alias("root"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if got:
            a, b = link_roots(np.concatenate([r for _, r in got]), np.concatenate([f for f, _ in got]), bits)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(masks) // ROWS)
    return arrow_map(spread.repartition(parts, "root"), run, "a long, b long")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id that links lead to) for every document."""
    marked = materialise(fingerprints(docs, id_col, text_col, shingle))
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = components(link(distinct.select("fp"), bits))
    placed = distinct.join(found, distinct["fp"] == found["a"], "left").select("fp", "first_id", F.coalesce("b", "fp").alias("top"))
    least = placed.groupBy("top").agg(F.min("first_id").alias("component_id"))
    return marked.join(placed.join(least, "top").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: str = "fp") -> F.Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
