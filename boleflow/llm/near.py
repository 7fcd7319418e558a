"""Near copies by SimHash: the Gray-order index of fingerprints, then an exact way for the pairs it can't find.

The hierarchical index of simhash.py says which sets have fingerprints of few differing bits;
those pairs are verified by the exact Jaccard similarity of their shingle sets. No radius in
bits finds all pairs of a similarity, so that roots of another kind follow for the rest, which are
exact. Shingles are put in one total order; two sets of
similarity t or more share a shingle among the first n - ceil(t n) + 1 of either (prefix
filter), at positions that leave enough to share (positional filter), and their sizes differ
by a factor t at most (length filter). Every shingle of a
prefix is a root, and every pair under a root that passes the length filter is compared
in full before it is linked, unless its ends are already in one verified group.

With the index's pairs the neighbours in Gray order of the SimHash fingerprints under each root are
verified, and the members of a large root with its middle, which are no more than two pairs
a member; they join dense groups. Then pairs whose ends
are still in different groups follow; a group is never paired with itself, and a large one
is met through nodes of its Gray order that are dropped whole. Sketches (counts of a set's
hashes in 64 or 256 buckets) drop pairs that can't be near before any text is read again:
the counts of two sets differ by no more in sum than the sets, so that this too loses no pair.
Shingles that are common in a sample (a fixed share of all documents) come last in the order,
so that common passages make few roots: the sample has an effect on the work, never on the
result.

Defined cases: a text of fewer words than a shingle is one shingle; texts without a word
(null, empty) have equal, empty sets and are copies of each other. Sets are of 64-bit
hashes. Rows without an id are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, binary, discard, materialise, tasks_for
from .components import components
from .simhash import BITS, fold, gray_rank, link, shingle_hashes

#: One document in SHARE is in the sample, at every size of the input; a shingle that COMMON of
#: them have is common. So roots of other shingles stay about as small as the input grows.
#: The driver holds MOST of them (16 bytes each): the most frequent, if there are more.
SHARE, COMMON, MOST = 8, 4, 1_000_000
#: Rows or pairs that a task holds.
ROWS = 250_000
#: Buckets of a sketch that goes with the rows of a root, and of one that pairs are sifted by.
BUCKETS, WIDE = 64, 256
#: Ids of documents to verify that are broadcast at most (8 bytes each); more are shuffled.
SMALL = 1_000_000
#: Members of a root from which on its largest group is met through nodes of BLOCK members.
LARGE, BLOCK = 64, 128


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Distinct hashes, ascending."""
    return np.unique(np.concatenate([*shingle_hashes(text, shingle), np.zeros(0, np.uint64)]))


def prefix(hashes: np.ndarray, limit: int, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first hashes in the order (times seen in the sample, hash), as many as a near copy can't all lack; limit in thousandths."""
    n = len(hashes)
    seen = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        seen = np.where(common[at] == hashes, times[at], 0)
    return hashes[np.argsort(seen, kind="stable")[: n + (-n * limit // 1000) + 1 if n else 0]]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as t").filter("doc_id IS NOT NULL")


def sketch(hashes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of the hashes by their low bits, at most 255."""
    return np.minimum(np.bincount((hashes & np.uint64(buckets - 1)).view(np.int64), minlength=buckets), 255).astype(np.uint8)


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """doc_id and hashes (the shingle set), a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t or b"", shingle) for t in binary(batch, "t")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], names=["doc_id", "hashes"])

    return arrow_map(texts, run, "doc_id long, hashes array<long>")


def _common(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    some = texts.filter(F.expr(f"pmod(xxhash64(doc_id), {SHARE}) = 0"))
    times = _sets(some, shingle).select(F.explode("hashes").alias("h")).groupBy("h").count().filter(F.col("count") >= COMMON)
    rows = times.orderBy(F.desc("count"), "h").limit(MOST).toPandas()
    h, n = rows["h"].to_numpy(np.int64).view(np.uint64), rows["count"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _read(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """The columns of all rows; a sketch becomes a row of counts."""

    def plain(c: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), -1).astype(np.int16) if pa.types.is_binary(c.type) else c.to_numpy()

    got = [[plain(c) for c in b.columns] for b in batches if b.num_rows]
    return [np.concatenate(c) for c in zip(*got, strict=True)]


def _starts(root: np.ndarray) -> np.ndarray:
    """Whether a sorted root begins at each row."""
    new = np.ones(len(root), bool)
    new[1:] = root[1:] != root[:-1]
    return new


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    ab = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])


def _meets(n: np.ndarray, pos: np.ndarray, x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """Whether rows x and y can be near if their root is the first shingle that both have (positional filter).

    They share no more than what follows it in either; an earlier shared shingle is a root too.
    """
    return np.minimum(n[x] - pos[x], n[y] - pos[y]) * (1000 + limit) >= (n[x] + n[y]) * limit


def indexed(sets: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (a, b) of the sets (id, fp) that the SimHash index links: as many as span its groups of fingerprints.

    A fingerprint stands for all sets that have it; each of them is paired with its first.
    """
    firsts = materialise(sets.groupBy("fp").agg(F.min("id").alias("first"), F.max("id").alias("last")))
    linked = link(firsts.select("fp"), bits).distinct()
    ends = [firsts.select(F.col("fp").alias(k), F.col("first").alias(f"first_{k}")) for k in "ab"]
    across = linked.join(ends[0], "a").join(ends[1], "b").select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    same = sets.join(firsts.filter("first < last"), "fp").filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    pairs = materialise(across.union(same).distinct())
    discard(firsts)
    return pairs


def shared(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The rows (root, id, n, fp, pos) that have another of a fitting size under their root."""
    if got := _read(batches):
        order = np.lexsort((got[2], got[0]))
        root, ids, n, fp, pos = (c[order] for c in got)
        fits = ~_starts(root)[1:] & (n[:-1] * 1000 >= n[1:] * limit)
        keep = np.zeros(len(root), bool)
        keep[1:] |= fits
        keep[:-1] |= fits
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (root, ids, n, fp, pos)], names=["root", "id", "n", "fp", "pos"])


def neighbours(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Pairs that are next to each other in Gray order under a root; under a large one also all members with its middle.

    The middle is the member whose fingerprint is nearest to the bits that most members have.
    """
    if got := _read(batches):
        order = np.lexsort((got[1], gray_rank(got[3].view(np.uint64)), got[0]))
        root, ids, n, fp, pos = (c[order] for c in got)
        begin = np.flatnonzero(_starts(root))
        size = np.diff(np.append(begin, len(root)))
        at = np.flatnonzero(~_starts(root)[1:])
        x, y = [at], [at + 1]
        for r in np.flatnonzero(size > LARGE):
            rows = np.arange(begin[r], begin[r] + size[r])
            ones = np.unpackbits(fp[rows].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            most = np.packbits(ones * 2 > len(rows), bitorder="little").view(np.uint64)[0]
            middle = rows[np.bitwise_count(fp[rows].view(np.uint64) ^ most).argmin()]
            x.append(rows)
            y.append(np.full(len(rows), middle))
        x, y = np.concatenate(x), np.concatenate(y)
        fits = (np.minimum(n[x], n[y]) * 1000 >= np.maximum(n[x], n[y]) * limit) & (ids[x] != ids[y]) & _meets(n, pos, x, y, limit)
        yield _pairs(ids[x][fits], ids[y][fits])


def mixed(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The rows (root, id, n, fp, pos, top) under roots that have rows of several groups (top)."""
    if got := _read(batches):
        order = np.lexsort((got[2], got[0]))
        root, ids, n, fp, pos, top = (c[order] for c in got)
        begin = np.flatnonzero(_starts(root))
        several = np.minimum.reduceat(top, begin) != np.maximum.reduceat(top, begin)
        keep = np.repeat(several, np.diff(np.append(begin, len(root))))
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (root, ids, n, fp, pos, top)], names=["root", "id", "n", "fp", "pos", "top"])


def sift(pairs: DataFrame, marked: DataFrame, limit: int) -> DataFrame:
    """The pairs (a, b) whose sizes and wide sketches leave the similarity possible; loses no pair that has it."""
    sides = [marked.select(F.col("doc_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("wide").alias(f"wide_{k}")).distinct() for k in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if got := _read(iter([batch])):
                a, b, n_a, n_b, x, y = got
                n, counts, at = np.concatenate([n_a, n_b]), np.concatenate([x, y]), np.arange(len(a))
                ok = _fits(counts, n, at, at + len(a), limit)
                yield _pairs(a[ok], b[ok])

    met = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "n_b", "wide_a", "wide_b")
    return arrow_map(met, run, "a long, b long").distinct()


def _fits(counts: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """Whether sizes and sketches of rows x and y leave a similarity of the limit possible."""
    least = np.abs(counts[x] - counts[y]).sum(1, dtype=np.int64)  # of what one set alone has
    return (np.minimum(n[x], n[y]) * 1000 >= np.maximum(n[x], n[y]) * limit) & (least * (1000 + limit) <= (n[x] + n[y]) * (1000 - limit))


def _against(few: np.ndarray, many: np.ndarray, fp: np.ndarray, n: np.ndarray, pos: np.ndarray, counts: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of few with rows of many that fit.

    many is put in Gray order; runs of BLOCK of it form upper nodes that hold the bounds of
    their members' sizes and sketches. A node too far from a row goes with all its members.
    """
    many = many[np.argsort(gray_rank(fp[many].view(np.uint64)), kind="stable")]
    cuts = np.arange(0, len(many), BLOCK)
    low, high = np.minimum.reduceat(counts[many], cuts), np.maximum.reduceat(counts[many], cuts)
    n_low, n_high = np.minimum.reduceat(n[many], cuts), np.maximum.reduceat(n[many], cuts)
    for x in few:
        out = (np.maximum(low - counts[x], 0) + np.maximum(counts[x] - high, 0)).sum(1, dtype=np.int64)
        open_ = (out * (1000 + limit) <= (n[x] + n_high) * (1000 - limit)) & (n_low * limit <= n[x] * 1000) & (n_high * 1000 >= n[x] * limit)
        for c in cuts[open_]:
            y = many[c : c + BLOCK]
            y = y[_meets(n, pos, np.full(len(y), x), y, limit)]
            y = y[_fits(counts, n, np.full(len(y), x), y, limit)]
            if len(y):
                yield np.full(len(y), x), y


def apart(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Pairs under a root (rows root, id, n, fp, pos, top, sketch) of fitting sizes and sketches and of different groups (top).

    A root whose rows are in one group has none. Under a large root the largest group is
    not paired with itself, and met through the nodes of its Gray order.
    """
    if not (got := _read(batches)):
        return
    order = np.lexsort((got[2], got[0]))
    root, ids, n, fp, pos, top, counts = (c[order] for c in got)
    begin = np.flatnonzero(_starts(root))
    size = np.diff(np.append(begin, len(root)))
    mixed = np.minimum.reduceat(top, begin) != np.maximum.reduceat(top, begin)
    held, a, b = 0, [], []

    def steps(at: np.ndarray, rows: np.ndarray, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places `at` of rows (ascending in size within a root, of) with later ones."""
        step = 1
        while len(at := at[at + step < len(rows)]):
            # sizes ascend: what does not fit now fits no later one
            at = at[(of[at] == of[at + step]) & (n[rows[at]] * 1000 >= n[rows[at + step]] * limit)]
            x, y = rows[at], rows[at + step]
            new = (top[x] != top[y]) & _meets(n, pos, x, y, limit)
            x, y = x[new], y[new]
            ok = _fits(counts, n, x, y, limit)
            yield x[ok], y[ok]
            step += 1

    def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        small = np.repeat(mixed & (size <= LARGE), size)
        rows = np.flatnonzero(small)
        yield from steps(np.arange(len(rows)), rows, root[rows])
        for r in np.flatnonzero(mixed & (size > LARGE)):
            rows = np.arange(begin[r], begin[r] + size[r])
            names, times = np.unique(top[rows], return_counts=True)
            largest = top[rows] == names[times.argmax()]
            few = rows[~largest]
            yield from steps(np.arange(len(few)), few, root[few])
            yield from _against(few, rows[largest], fp, n, pos, counts, limit)

    for x, y in found():
        a.append(ids[x])
        b.append(ids[y])
        held += len(x)
        if held > ROWS:
            yield _pairs(np.concatenate(a), np.concatenate(b))
            held, a, b = 0, [], []
    if a:
        yield _pairs(np.concatenate(a), np.concatenate(b))


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, limit: int) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity: read from the texts of those documents alone."""
    pairs = materialise(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    wanted = texts.join(F.broadcast(ids) if ids.count() <= SMALL else ids, "doc_id", "left_semi")
    sets = materialise(_sets(wanted, shingle))
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", (F.size("x") + F.size("y")).cast("long").alias("both"), F.size(F.array_intersect("x", "y")).cast("long").alias("met"))
    out = materialise(met.filter(F.col("met") * 1000 >= (F.col("both") - F.col("met")) * limit).select("a", "b").distinct())
    discard(sets)
    return out


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id and component_id (the least doc_id that verified links lead to), for every set of every document."""
    limit, texts = round(threshold * 1000), _texts(docs, id_col, text_col)
    common, times = _common(texts, shingle)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in binary(batch, "t"):
                slices = list(shingle_hashes(t or b"", shingle))
                h = np.unique(np.concatenate([*slices, np.zeros(0, np.uint64)]))
                first = prefix(h, limit, common, times).view(np.int64)
                rows.append((hashlib.blake2b(h.tobytes(), digest_size=16).digest(), len(h), np.uint64(fold(slices)).view(np.int64), first, sketch(h).tobytes(), sketch(h, WIDE).tobytes()))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "digest", "n", "fp", "prefix", "sketch", "wide"])

    marked = materialise(arrow_map(texts, mark, "doc_id long, digest binary, n long, fp long, prefix array<long>, sketch binary, wide binary"))
    least = materialise(marked.groupBy("digest").agg(F.min("doc_id").alias("id")))
    # one row a set; a set of several rows of its least id comes more than once, which does no harm
    sets = marked.join(least, (marked["digest"] == least["digest"]) & (marked["doc_id"] == least["id"]), "left_semi")
    by_index = indexed(sets.select(F.col("doc_id").alias("id"), "fp").distinct())
    spread = sets.select(F.posexplode("prefix").alias("pos", "root"), F.col("doc_id").alias("id"), "n", "fp").select("root", "id", "n", "fp", "pos")
    spark = docs.sparkSession
    n_roots = marked.agg(F.sum(F.size("prefix"))).first()[0] or 0
    rooted = materialise(arrow_map(spread.repartition(tasks_for(spark, n_roots // ROWS), "root"), lambda b: shared(b, limit), "root long, id long, n long, fp long, pos int"))
    parts = tasks_for(spark, rooted.count() // ROWS)

    beside = arrow_map(rooted.repartition(parts, "root"), lambda b: neighbours(b, limit), "a long, b long")
    near = materialise(by_index.union(beside).distinct())
    links = verified(sift(near, marked, limit), texts, shingle, limit)
    found = components(links)
    tops = rooted.join(found.withColumnRenamed("a", "id"), "id", "left").select("root", "id", "n", "fp", "pos", F.coalesce("b", "id").alias("top"))
    left = materialise(arrow_map(tops.repartition(parts, "root"), lambda b: mixed(b, limit), "root long, id long, n long, fp long, pos int, top long"))
    drawn = left.join(marked.select(F.col("doc_id").alias("id"), "sketch").distinct(), "id").select("root", "id", "n", "fp", "pos", "top", "sketch")
    rest = materialise(arrow_map(drawn.repartition(parts, "root"), lambda b: apart(b, limit), "a long, b long").distinct())
    more = verified(sift(rest.join(near, ["a", "b"], "left_anti"), marked, limit), texts, shingle, limit)
    # documents of several rows (one id, several sets) are one
    ids = marked.join(least, "digest").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).filter("a <> b")
    several = marked.groupBy("doc_id").agg(F.count_distinct("digest").alias("k")).filter("k > 1").select(F.col("doc_id").alias("a"))
    joined = components(links.union(more).union(ids.join(several, "a", "left_semi")))
    for table in (by_index, rooted, near, left, rest):
        discard(table)
    placed = least.join(joined.withColumnRenamed("a", "id"), "id", "left").select("digest", F.coalesce("b", "id").alias("component_id"))
    return marked.join(placed, "digest").select("doc_id", "component_id")
