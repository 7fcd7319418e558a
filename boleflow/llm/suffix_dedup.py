"""Removal of every byte that lies in a long string that starts anywhere else too.

Candidates come from anchored windows (repeats.py): one copy of each span whose anchor has
several spans, and two of each span that occurs twice. Around an anchor the suffixes that start at the anchor, and the reversed prefixes that end there,
are sorted by a mergesort whose comparisons are logarithmic: prefix polynomial hashes
and a binary search give the common extension of two suffixes, and one byte decides.
Neighbours' common extensions are verified byte by byte. Two windows are equal where the
classes of their right and left extensions agree.

Defined cases: null text counts as empty: nothing removed. A document shorter than the
length keeps all. Repeated rows lose all their bytes if they are long enough. An empty
table gives an empty result. Matches never cross documents; overlaps count; strings are
judged on the input. Very long texts are hashed whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy_pair
from .repeats import BASES, BYTES, LONG, U, Known, powers, read_chunks, table, texts_of, verdicts

LENGTH = 400
GRAM = 128
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class Suffixes:
    """Suffixes of rows of one buffer: from start[i], size[i] bytes, in groups of equal keys."""

    def __init__(self, flat: np.ndarray, row_start: np.ndarray, row_size: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.flat, self.start, self.size = np.append(flat, np.uint8(0)), start, size
        local = np.arange(len(flat)) - np.repeat(row_start, row_size)
        longest = int(row_size.max(initial=0)) + 1
        up, down = powers(BASES[0], longest)
        self.prefix = np.zeros(len(flat) + 1, U)
        np.cumsum(BYTES[flat] * up[local], out=self.prefix[1:])
        self.undo = down[start - row_start]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Longest common extension of suffixes x and y, by hashes."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.size[x], self.size[y])
        sx, sy = self.start[x], self.start[y]
        px, py, ux, uy = self.prefix[sx], self.prefix[sy], self.undo[x], self.undo[y]
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = (self.prefix[sx + mid] - px) * ux == (self.prefix[sy + mid] - py) * uy
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.common(x, y)
        ended_x, ended_y = n == self.size[x], n == self.size[y]
        by_byte = self.flat[np.minimum(self.start[x] + n, len(self.flat) - 1)] < self.flat[np.minimum(self.start[y] + n, len(self.flat) - 1)]
        return np.where(ended_x, ~ended_y | or_equal, ~ended_y & by_byte)

    def sort(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, extension shared with the one before; -1 at the start of a group)."""
        order = np.argsort(group, kind="stable")
        g = group[order]
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        first = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        begin, end = first[of], np.append(first[1:], len(g))[of]
        width = 1
        while (active := np.flatnonzero(end - begin > width)).size:
            rank = active - begin[active]
            block = rank // width
            low = begin[active] + (block ^ 1) * width
            at, high = np.minimum(low, end[active]), np.minimum(low + width, end[active])
            low = at.copy()
            me, right = order[active], (block & 1).astype(bool)
            while (todo := np.flatnonzero(at < high)).size:
                mid = (at[todo] + high[todo]) >> 1
                before = self.less(order[mid], me[todo], right[todo])
                at[todo] = np.where(before, mid + 1, at[todo])
                high[todo] = np.where(before, high[todo], mid)
            order[begin[active] + (block >> 1) * 2 * width + rank - block * width + at - low] = me
            width *= 2
        shared = np.full(len(g), -1)
        inner = np.flatnonzero(~new)
        shared[inner] = self.common(order[inner - 1], order[inner])
        if not self.verified(order, inner, shared[inner]):
            return self.sort_plainly(group)
        return order, shared

    def verified(self, order: np.ndarray, inner: np.ndarray, shared: np.ndarray) -> bool:
        """Whether hashes told the truth: shared bytes are equal and in order."""
        x, y = order[inner - 1], order[inner]
        step = np.arange(shared.sum()) - np.repeat(np.cumsum(shared) - shared, shared)
        if (self.flat[np.repeat(self.start[x], shared) + step] != self.flat[np.repeat(self.start[y], shared) + step]).any():
            return False
        open_ = (shared < self.size[x]) & (shared < self.size[y])
        x, y, shared = x[open_], y[open_], shared[open_]
        return bool((self.flat[self.start[x] + shared] < self.flat[self.start[y] + shared]).all())

    def sort_plainly(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same by comparing bytes, for the case of a hash collision."""
        text = [self.flat[s : s + n].tobytes() for s, n in zip(self.start.tolist(), self.size.tolist(), strict=True)]
        order = sorted(range(len(text)), key=lambda i: (group[i], text[i]))
        shared = [-1] * len(order)
        for k in range(1, len(order)):
            a, b = order[k - 1], order[k]
            if group[a] == group[b]:
                n = min(len(text[a]), len(text[b]))
                shared[k] = next((i for i in range(n) if text[a][i] != text[b][i]), n)
        return np.array(order, np.int64), np.array(shared, np.int64)


def resolve(length: int, gram: int):
    """Resolver of repeats.verdicts: which windows of the spans recur among them."""

    def run(anchor: np.ndarray, weight: np.ndarray, off: np.ndarray, windows: np.ndarray, texts: list[bytes]) -> list[np.ndarray]:
        size = np.array([len(t) for t in texts], np.int64)
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(texts), np.uint8)
        n = len(texts)
        right_order, right = Suffixes(flat, start, size, start + off, size - off).sort(anchor)
        mirrored = len(flat) - start - size
        # Rows lie in reverse order in the mirrored buffer; its row starts must ascend for prefixes.
        back = np.argsort(mirrored)
        left_order, left = Suffixes(flat[::-1].copy(), mirrored[back], size[back], (mirrored + size - off)[back], off[back]).sort(anchor[back])
        left_order = back[left_order]
        flags = [np.zeros(k, bool) for k in windows]
        class_right, class_left = np.empty(n, np.int64), np.empty(n, np.int64)
        for o in range(length - gram + 1):
            on = np.flatnonzero((off >= o) & (o > off - windows))
            if len(on) < 2 and not (weight[on] > 1).any():
                continue
            class_right[right_order] = np.cumsum(right < length - o)
            class_left[left_order] = np.cumsum(left < o)
            key = class_right[on] * (n + 1) + class_left[on]
            _, inverse = np.unique(key, return_inverse=True)
            for i in on[np.bincount(inverse, weight[on])[inverse] >= 2]:
                flags[i][off[i] - o] = True
        return flags

    return run


def byte_units(texts: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(t, np.uint8) for t in texts]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row a document: SCHEMA and kept, the remaining bytes concatenated (a cut may part a character's bytes)."""
    dealt, found = verdicts(docs, length, gram, byte_units, lambda u, f, e: u[f : e + length].tobytes(), resolve(length, gram), id_col, text_col, prove=True)

    def finish(docs_t: pa.Table, verdict_t: pa.Table) -> pa.Table:
        texts, known = texts_of(docs_t), Known(verdict_t, length, gram)
        removed, runs = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        kept = list(texts)
        for members, units, starts, s in read_chunks(texts, byte_units, length, gram):
            gone = known.covered(s, len(units))
            for i, (a, b) in zip(members, zip(starts.tolist(), [*starts[1:].tolist(), len(units)], strict=True), strict=True):
                part = gone[a:b]
                if k := int(np.count_nonzero(part)):
                    removed[i] = k
                    runs[i] = np.count_nonzero(part[1:] & ~part[:-1]) + int(part[0])
                    kept[i] = units[a:b][~part].tobytes()
        return table(
            {
                "doc_id": (docs_t.column("doc_id"), LONG),
                "n_bytes": ([len(t) for t in texts], LONG),
                "n_removed": (removed, LONG),
                "n_spans": (runs, LONG),
                "kept_sha256": ([hashlib.sha256(t).hexdigest() for t in kept], pa.string()),
                "kept": (kept, pa.binary()),
            }
        )

    return dealt.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(tidy_pair(finish), SCHEMA + ", kept binary")

