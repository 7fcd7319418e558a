"""Windows of a fixed length that start at two or more places, over a whole corpus.

Units are bytes or word hashes. A window is `length` consecutive units of one document.
Every window has an anchor: its least-hashed gram of `gram` units, the leftmost of equal
ones. Equal windows have equal anchors at equal offsets, so that only windows around
recurring anchors need a look. Consecutive windows with one anchor form a span.

1. Documents are dealt into shards by a hash of their id, once. A shard sends each of its
   distinct spans as (anchor, digest, count).
2. Rows meet by anchor. A span seen twice is repeated as a whole; an anchor with one span
   needs no more; the spans of an anchor with several are asked for, one copy of each.
3. Those copies meet by anchor, and a resolver tells for each window whether it recurs.
4. Verdicts go back to the shards that have the spans, one row for a shard and span
   however often it occurs there. The shard looks up its spans and knows its windows.

All three passes read the same dealing of the documents, which Spark computes once. What
is dealt by anchor has at most one row for a shard and span, so that the copies of a
common passage are counted where they lie. Digests have 128 bits (of two polynomials
modulo 2^64 over random unit values) besides the 64 of the anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, prepare, shards_for, tasks_for, tidy, tidy_pair, whole_keys

U = np.uint64
_RNG = np.random.default_rng(20240229)
BASES = tuple(int(x) | 1 for x in _RNG.integers(1 << 62, 1 << 63, 2))
#: Unit values of bytes.
BYTES = _RNG.integers(0, 1 << 64, 256, U, endpoint=False)
#: Units hashed at once; longer documents are hashed alone.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads the weak low bits of a polynomial."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n at least."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, CHUNK + 1)
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(size, base, U), np.full(size, inverse, U)
        up[0] = down[0] = 1
        _POWERS[base] = np.cumprod(up), np.cumprod(down)
    return _POWERS[base]


def prefixes(units: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(units) + 1, U)
    np.cumsum(units * powers(base, len(units) + 1)[0][: len(units)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * powers(base, len(prefix))[1][start]


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width consecutive values, by block-wise running minima."""
    n = len(v)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, U)
    padded[:n] = v
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


@dataclass
class Spans:
    """Runs of windows with one anchor; positions are within the chunk."""

    first: np.ndarray  # start of the first window
    last: np.ndarray  # start of the last window
    anchor_at: np.ndarray
    anchor: np.ndarray
    d1: np.ndarray
    d2: np.ndarray


def spans(units: np.ndarray, starts: np.ndarray, length: int, gram: int) -> Spans:
    """Spans of a chunk of units; starts: where each document begins (not empty ones)."""
    n = len(units)
    if units.dtype == np.uint8:
        units = BYTES[units]
    if n < length:
        return Spans(*[np.zeros(0, np.int64)] * 3, *[np.zeros(0, U)] * 3)
    p1, p2 = prefixes(units, BASES[0]), prefixes(units, BASES[1])
    inv = powers(BASES[0], n + 1)[1]
    grams = mix((p1[gram:] - p1[: n - gram + 1]) * inv[: n - gram + 1])
    bits = U(max(20, n.bit_length()))
    low = (U(1) << bits) - U(1)
    least = sliding_min((grams & ~low) | np.arange(len(grams), dtype=U), length - gram + 1)
    at = (least & low).astype(np.int64)
    ends = np.append(starts[1:], n)
    left = np.repeat(ends, np.diff(np.append(starts, n)))[: len(at)] - np.arange(len(at))
    valid = left >= length
    head = valid.copy()
    head[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    tail = valid.copy()
    tail[:-1] &= (at[1:] != at[:-1]) | ~valid[1:]
    # a document's last window and the next one's first never touch: length > 1
    first, last = np.flatnonzero(head), np.flatnonzero(tail)
    a, off = at[first], (at[first] - first).astype(U)
    d1 = mix(span_hash(p1, BASES[0], first, last + length) + off * U(0x9E3779B97F4A7C15))
    d2 = mix(span_hash(p2, BASES[1], first, last + length) ^ (last - first).astype(U))
    return Spans(first, last, a, grams[a], d1, d2)


Units = Callable[[list[bytes]], list[np.ndarray]]


def read_chunks(texts: list[bytes], to_units: Units, length: int, gram: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, Spans]]:
    """(documents, units, their starts, spans) for the documents that have a window."""
    at, size = 0, 0
    for i in range(len(texts) + 1):
        if i == len(texts) or (size and size + len(texts[i]) > CHUNK):
            group = list(range(at, i))
            units = to_units([texts[j] for j in group])
            keep = [j for j, u in zip(group, units, strict=True) if len(u) >= length]
            units = [u for u in units if len(u) >= length]
            if units:
                starts = np.concatenate([[0], np.cumsum([len(u) for u in units])[:-1]]).astype(np.int64)
                flat = np.concatenate(units)
                yield keep, flat, starts, spans(flat, starts, length, gram)
            at, size = i, 0
        if i < len(texts):
            size += len(texts[i])


def table(columns: dict[str, tuple[np.ndarray | list, pa.DataType]]) -> pa.Table:
    return pa.table({k: pa.array(v.view(np.int64) if isinstance(v, np.ndarray) and v.dtype == U else v, t) for k, (v, t) in columns.items()})


def nullable(structs: pa.ChunkedArray) -> pa.StructArray:
    """The same structs with fields that may be null, as a schema string declares them."""
    flat = structs.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return pa.StructArray.from_arrays(flat.flatten(), names=[f.name for f in flat.type])


def column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def texts_of(t: pa.Table) -> list[bytes]:
    return [x or b"" for x in t.column("text").cast(pa.large_binary()).to_pylist()]


#: (payload of a span for the resolver, from its units and window starts)
Payload = Callable[[np.ndarray, int, int], bytes]
#: A resolver gets arrays (anchor, weight, offset of the anchor, windows) and payloads;
#: it returns for each span a boolean array over its windows.
Resolver = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]], list[np.ndarray]]

LONG, INT, BIN = pa.int64(), pa.int32(), pa.binary()
VERDICT = "shard int, d1 long, d2 long, flags binary"


def verdicts(docs: DataFrame, length: int, gram: int, to_units: Units, payload: Payload, resolve: Resolver, id_col: str, text_col: str, carry: list[str] | None = None, prove: bool = False) -> tuple[DataFrame, DataFrame]:
    """(dealt documents: shard, doc_id, text, carried; verdicts by shard and span).

    flags has a bit for each window of the span, or is null where all recur. With prove,
    spans that equal digests call repeated go to the resolver too, in two copies (of two
    shards where there are two), and only what it finds equal in both counts.
    """
    spark = docs.sparkSession
    prepare(spark)
    n_shards = shards_for(spark, docs, 4 << 20)
    parts = tasks_for(spark, n_shards // 2)
    dealt = docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col).cast("string")), F.lit(n_shards)).cast("int").alias("shard"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *(carry or [])).alias("carried")
    ).repartition(parts, "shard")

    def find(t: pa.Table) -> pa.Table:
        got = [(s.anchor, s.d1, s.d2) for _, _, _, s in read_chunks(texts_of(t), to_units, length, gram)]
        a, d1, d2 = (np.concatenate(x) for x in zip(*got, strict=True)) if got else [np.zeros(0, U)] * 3
        order = np.lexsort((d2, d1))
        a, d1, d2 = a[order], d1[order], d2[order]
        new = np.ones(len(a), bool)
        new[1:] = (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(a)))
        shard = t.column("shard")[0].as_py()
        return table({"shard": (np.full(len(at), shard), INT), "a": (a[at], LONG), "d1": (d1[at], LONG), "d2": (d2[at], LONG), "n": (n, INT)})

    found = dealt.groupBy("shard").applyInArrow(tidy(find), "shard int, a long, d1 long, d2 long, n int").repartition(parts, "a").sortWithinPartitions("a")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: repeated as a whole; 1: asked for; 2: has a span that is asked for elsewhere."""
        for t in whole_keys(batches, "a"):
            yield from meet_some(t)

    def meet_some(t: pa.Table) -> Iterator[pa.RecordBatch]:
        a, d1, d2, shard, n = (column(t, c) for c in ("a", "d1", "d2", "shard", "n"))
        order = np.lexsort((shard, d2, d1, a))
        a, d1, d2, shard, n = a[order], d1[order], d2[order], shard[order], n[order].astype(np.int64)
        new_a = np.ones(len(a), bool)
        new_a[1:] = a[1:] != a[:-1]
        new_d = new_a.copy()
        new_d[1:] |= (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
        of_d = np.cumsum(new_d) - 1
        total = np.bincount(of_d, n).astype(np.int64)[of_d]
        of_a = np.cumsum(new_a) - 1
        distinct = np.bincount(of_a, new_d)[of_a]
        whole, several = total >= 2, distinct >= 2
        at_d = np.flatnonzero(new_d)
        holders_of = np.diff(np.append(at_d, len(a)))[of_d]
        second = np.arange(len(a)) - at_d[of_d] == 1
        copies = np.ones(len(a), np.int64)
        weight = np.minimum(total, 1 << 30)
        if prove:  # copies of a span: one of either of two shards, or both of one
            copies[whole & (holders_of == 1)] = 2
            weight[whole & (holders_of > 1)] -= 1
            weight[second] = 1
            picked = [((several | whole) & (new_d | second), 1), (several | whole, 2)]
        else:
            picked = [(whole, 0), (several & new_d, 1), (several & ~whole, 2)]
        at = np.concatenate([np.flatnonzero(m) for m, _ in picked])
        kind = np.repeat([k for _, k in picked], [m.sum() for m, _ in picked])
        out = table({"kind": (kind, INT), "shard": (shard[at], INT), "a": (a[at], LONG), "d1": (d1[at], LONG), "d2": (d2[at], LONG), "n": (weight[at], INT), "copies": (copies[at], INT)})
        yield from out.to_batches(1 << 16)

    met = arrow_map(found, meet, "kind int, shard int, a long, d1 long, d2 long, n int, copies int")

    payload_schema = "shard int, a long, d1 long, d2 long, n int, off int, m int, payload binary"

    def fetch(docs_t: pa.Table, asked: pa.Table) -> pa.Table:
        want1, want2 = column(asked, "d1").view(U), column(asked, "d2").view(U)
        order = np.argsort(want1, kind="stable")
        left = column(asked, "copies")[order].astype(np.int64)
        n = column(asked, "n").astype(np.int64)
        rows: list[tuple] = []
        if len(order):
            for _, units, _, s in read_chunks(texts_of(docs_t), to_units, length, gram):
                hit = match(want1[order], want2[order], s)
                for i in np.flatnonzero(hit >= 0):
                    if left[hit[i]]:
                        left[hit[i]] -= 1
                        j = order[hit[i]]
                        f, e = int(s.first[i]), int(s.last[i])
                        rows.append((j, int(s.anchor_at[i]) - f, e - f + 1, payload(units, f, e), int(n[j])))
                        n[j] = 1 if left[hit[i]] else n[j]  # of two copies the last counts once
                        if left[hit[i]]:
                            rows[-1] = (*rows[-1][:4], rows[-1][4] - 1)
        j = np.array([r[0] for r in rows], np.int64)
        pick = lambda c: column(asked, c)[j]
        return table({"shard": (np.full(len(j), -1), INT), **{c: (pick(c), t) for c, t in (("a", LONG), ("d1", LONG), ("d2", LONG))}, "n": ([r[4] for r in rows], INT), "off": ([r[1] for r in rows], INT), "m": ([r[2] for r in rows], INT), "payload": ([r[3] for r in rows], BIN)})

    asked = met.filter("kind = 1").drop("kind")
    sent = dealt.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(tidy_pair(fetch), payload_schema)
    holders = met.filter("kind = 2").select("shard", "a", "d1", "d2", "n", F.lit(0).alias("off"), F.lit(0).alias("m"), F.lit(None).cast("binary").alias("payload"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_keys(batches, "a", 1 << 14):
            yield from settle_some(t)

    def settle_some(t: pa.Table) -> Iterator[pa.RecordBatch]:
        shard = column(t, "shard")
        texts = t.filter(pa.array(shard < 0))
        holds = t.filter(pa.array(shard >= 0))
        if not texts.num_rows or not holds.num_rows:
            return
        flags = resolve(column(texts, "a"), column(texts, "n").astype(np.int64), column(texts, "off").astype(np.int64), column(texts, "m").astype(np.int64), texts.column("payload").to_pylist())
        index: dict[tuple[int, int], int] = {}
        for i, d in enumerate(zip(column(texts, "d1").tolist(), column(texts, "d2").tolist(), strict=True)):
            if (j := index.setdefault(d, i)) != i:
                flags[j] = flags[j] & flags[i]
        packed: dict[int, bytes] = {}
        out = []
        for s, x, y in zip(column(holds, "shard").tolist(), column(holds, "d1").tolist(), column(holds, "d2").tolist(), strict=True):
            if (i := index.get((x, y))) is not None and flags[i].any():
                if i not in packed:
                    packed[i] = np.packbits(flags[i]).tobytes()
                out.append((s, x, y, packed[i]))
        if out:
            s, x, y, f = zip(*out, strict=True)
            yield from pa.table({"shard": pa.array(s, INT), "d1": pa.array(x, LONG), "d2": pa.array(y, LONG), "flags": pa.array(f, BIN)}).to_batches(1 << 16)

    settled = arrow_map(sent.unionByName(holders).repartition(parts, "a").sortWithinPartitions("a"), settle, VERDICT)
    if prove:
        return dealt, settled
    full = met.filter("kind = 0").select("shard", "d1", "d2", F.lit(None).cast("binary").alias("flags"))
    return dealt, full.unionByName(settled)


def match(sorted1: np.ndarray, sorted2: np.ndarray, s: Spans) -> np.ndarray:
    """Row of each span among digests sorted by the first half, or -1."""
    if not len(sorted1):
        return np.full(len(s.d1), -1)
    at = np.minimum(np.searchsorted(sorted1, s.d1), len(sorted1) - 1)
    return np.where((sorted1[at] == s.d1) & (sorted2[at] == s.d2), at, -1)


class Known:
    """A shard's verdicts, for look-up."""

    def __init__(self, t: pa.Table, length: int, gram: int):
        d1, d2 = column(t, "d1").view(U), column(t, "d2").view(U)
        order = np.argsort(d1, kind="stable")
        self.d1, self.d2, self.length = d1[order], d2[order], length
        flags = t.column("flags").to_pylist()
        self.whole = np.array([flags[i] is None for i in order], bool)
        width = (length - gram + 1 + 7) // 8
        self.flags = np.frombuffer(b"".join((flags[i] or b"").ljust(width, b"\0") for i in order), np.uint8).reshape(len(order), width)

    def passages(self, chunks: list[tuple[np.ndarray, Spans]]) -> Iterator[tuple[int, int, int]]:
        """(chunk, start, end): one place of every passage of a shard; chunks are its (document starts, spans).

        A passage is a span, or the part of one that recurs, or a chain of spans that follow
        each other wherever any of them occurs in the shard: so each occurrence of a span is
        in an occurrence of its passage.
        """
        n = len(self.d1)
        hits = [match(self.d1, self.d2, s) for _, s in chunks]
        full = [(h >= 0) & self.whole[h] if n else np.zeros(len(h), bool) for h in hits]
        after, before = (np.full(n, n), np.full(n, -2)), (np.full(n, n), np.full(n, -2))
        for (starts, s), h, on in zip(chunks, hits, full, strict=True):
            owner = np.searchsorted(starts, s.first, side="right")
            follows = on[:-1] & on[1:] & (owner[:-1] == owner[1:])
            for (least, most), other in ((after, np.append(np.where(follows, h[1:], -1), -1)), (before, np.append(-1, np.where(follows, h[:-1], -1)))):
                if len(h):
                    np.minimum.at(least, h[on], other[: len(h)][on])
                    np.maximum.at(most, h[on], other[: len(h)][on])
        chained = np.flatnonzero((after[0] == after[1]) & (after[0] >= 0))
        mutual = chained[(before[0][after[0][chained]] == chained) & (before[1][after[0][chained]] == chained)]
        goes_on, begun = np.zeros(n, bool), np.zeros(n, bool)
        goes_on[mutual] = True
        begun[after[0][mutual]] = True  # inside a chain: never a passage's first span
        for c, ((_, s), h, on) in enumerate(zip(chunks, hits, full, strict=True)):
            heads = np.flatnonzero(h >= 0)
            heads = heads[~begun[h[heads]]]
            _, first = np.unique(h[heads], return_index=True)
            begun[h[heads]] = True
            stops = np.flatnonzero(~(on & goes_on[h])) if n else heads
            for i in heads[first].tolist():
                at = int(s.first[i])
                if on[i]:
                    yield c, at, int(s.last[stops[np.searchsorted(stops, i)]]) + self.length
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[0], np.unpackbits(self.flags[h[i]]), [0]]).astype(np.int8))).tolist()
                for a, b in zip(edge[::2], edge[1::2], strict=True):
                    yield c, at + a, at + b - 1 + self.length

    def covered(self, s: Spans, n: int) -> np.ndarray:
        """Which of a chunk's n units lie in a repeated window."""
        hit = match(self.d1, self.d2, s)
        on = np.flatnonzero(hit >= 0)
        whole = on[self.whole[hit[on]]] if len(on) else on
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, s.first[whole], 1)
        np.add.at(edge, s.last[whole] + self.length, -1)
        part = on[~self.whole[hit[on]]] if len(on) else on
        if len(part):
            row, window = np.nonzero(np.unpackbits(self.flags[hit[part]], axis=1))
            starts = s.first[part][row] + window
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + self.length, -1)
        return np.cumsum(edge[:-1]) > 0
