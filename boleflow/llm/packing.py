"""Packing of token ids into fixed-length sequences by minimum bin slack.

A document longer than a sequence first gives whole sequences of its own; its remainder
goes to a pool. Each window then takes from the pool the multiset of remainder lengths
that fills it closest to capacity: a bitset subset-sum table over the pool's length
counts, read backwards to counts per length. What the pool can't fill at the end of a
partition is cut: into the window's gap first, and the last tokens into pieces whose
lengths are powers of two, which need no padding.

Packing is local to a partition: no shuffle, and a lost task repacks only its own rows.

Defined cases: null text counts as empty (one piece with the end id alone). Repeated
rows are packed one by one. An empty table gives no piece. Very long texts are cut to
whole sequences while they stream.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import arrow_map, held

CAPACITY = 2048
END_ID = 1
#: Remainders held before windows are filled: bounds the memory of a task.
POOL = 4096
#: Runs and parts held with their ids by a worker, each.
CACHE = 900_000
#: Runs whose ids are put together in one call: bounds what a very long text takes.
RUNS = 1 << 20
#: Parts that the tokenizer gets in one text.
TOGETHER = 256
#: Texts that the tokenizer gets in one call: what it returns takes many times their ids.
CALL = 256
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds:
    """Token ids (32-bit words, in the machine's little-endian order) of a run without space or line feed.

    The tokenizer normalises and splits at white space, so that a text's ids are the ids
    of its runs in turn; a run met before costs a look-up. An unknown run of plain Latin
    characters is split as the tokenizer's own pattern splits it, and its parts are
    looked up in turn; any other run goes to the tokenizer as it is.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.runs, self.parts = tokenizer, {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.encodings(texts)]

    def encodings(self, texts: list[str]) -> Iterator:
        for at in range(0, len(texts), CALL):
            yield from self.tokenizer.encode_batch(texts[at : at + CALL], add_special_tokens=False)

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that the tokenizer does not split further: many in a call, told apart by its own word numbers."""
        out: list[bytes] = []
        lines = [parts[at : at + TOGETHER] for at in range(0, len(parts), TOGETHER)]
        for line, e in zip(lines, self.encodings([" ".join(x) for x in lines]), strict=True):
            ids, words = array("I", e.ids).tobytes(), np.array(e.word_ids, np.int64)
            ends = np.searchsorted(words, np.arange(len(line)), side="right")
            if words[-1] + 1 != len(line):  # not one word each after all
                out += self.encode(line)
                continue
            cuts = [0, *(4 * ends).tolist()]
            out += [ids[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        return out

    def learn(self, words: list[bytes]) -> None:
        if not words:
            return
        parts, plain, split, rest = self.parts, [], [], []
        texts = b"\n".join(words).decode("utf-8", "replace").split("\n")
        lowered = "\n".join(texts).lower().split("\n")
        for w, t, low in zip(words, texts, lowered, strict=True):
            if "<|" not in t and PLAIN(t):
                plain.append(w)
                split.append(PART(low))
            else:
                rest.append((w, t))
        if unknown := list(set(chain.from_iterable(split)).difference(parts)):
            parts.update(zip(unknown, self.encode_parts(unknown), strict=True))
        self.runs.update((w, parts[p[0]] if len(p) == 1 else b"".join([parts[x] for x in p])) for w, p in zip(plain, split, strict=True))
        if rest:
            self.runs.update(zip([w for w, _ in rest], self.encode([t for _, t in rest]), strict=True))

    def ids(self, texts: pa.Array | list[bytes]) -> list[bytes]:
        """Ids of each text. A text's runs are numbered by Arrow; Python sees each distinct run of a batch once."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
        split = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        numbered = split.flatten().dictionary_encode()
        code, met = numbered.indices.to_numpy(), numbered.dictionary.cast(pa.large_binary()).to_pylist()
        if len(self.runs) > CACHE:
            self.runs.clear()
        if len(self.parts) > CACHE:
            self.parts.clear()
        self.learn([w for w in met if w not in self.runs])
        known = [self.runs[w] for w in met]
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(known), np.uint32)
        ends = np.cumsum(pc.list_value_length(split).to_numpy())
        return [b"".join(gather(flat, start, size, code[at : min(at + RUNS, end)]).tobytes() for at in range(begin, end, RUNS)) for begin, end in zip([0, *ends.tolist()], ends.tolist(), strict=False)]


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, code: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of each code, one after the other."""
    n = size[code]
    ends = np.cumsum(n)
    return flat[np.repeat(start[code] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


#: Latin runs on which lower-casing goes character by character and NFC changes nothing.
PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]*").fullmatch
#: The tokenizer's own split pattern on such runs, lower-cased.
PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\\s0-9a-zß-öø-ſ]+").findall


#: Texts on which a tokenizer of another form gives itself away.
PROBES = ["It's I'LL  they've\t3rd 42", "Two\nlines, a-b", "Straße ŒUVRE <|x a<b", "é日本 x_y !!"]


def word_ids(tokenizer_path: str) -> WordIds:
    """One for each tokenizer and worker process: later tasks find what earlier ones learnt."""

    def make() -> WordIds:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        words = WordIds(Tokenizer.from_file(tokenizer_path))
        if words.ids([t.encode() for t in PROBES]) != words.encode(PROBES):
            raise ValueError(f"{tokenizer_path}: this tokenizer does not split and lower-case as it must: its ids are not those of its runs")
        return words

    return held(f"packing {tokenizer_path}", make)


def fill(counts: list[int], capacity: int = CAPACITY, first: int | None = None) -> list[int]:
    """Lengths, out of counts (by length), whose sum is closest to capacity from below.

    first (default: the longest) is in it, so that every call makes progress. The
    table is one integer a length group: bit s is set if a sum s can be reached.
    """
    longest = first or max((n for n in range(1, capacity + 1) if counts[n]), default=0)
    if not longest:
        return []
    mask, target = (1 << (capacity - longest + 1)) - 1, capacity - longest
    reach, table = 1, []
    for n in range(longest, 0, -1):
        left, take = counts[n] - (n == longest), 1
        while left > 0 and n * take <= target:  # multiplicity by binary splitting
            k = min(take, left)
            table.append((n, k, reach))
            reach |= (reach << (n * k)) & mask
            left, take = left - k, take * 2
        if reach >> target & 1:
            break
    total, out = reach.bit_length() - 1, [longest]
    for n, k, before in reversed(table):
        if not before >> total & 1:
            out += [n] * k
            total -= n * k
    return out


def pack(documents: Iterator[tuple[int | None, bytes]], partition: int, capacity: int = CAPACITY, pool: int = POOL) -> Iterator[tuple]:
    """Rows of SCHEMA for (id, ids as bytes) pairs; every id lies in exactly one piece."""
    base, made = partition << 40, 0
    held: dict[int, list[tuple]] = defaultdict(list)
    counts, n_held = [0] * (capacity + 1), 0

    def row(piece: tuple, start: int, length: int, sequence: int, offset: int) -> tuple:
        doc, ids, at, tokens = piece
        return doc, at + start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), tokens, base + sequence, offset

    def window() -> Iterator[tuple]:
        nonlocal made, n_held
        offset = 0
        for n in fill(counts, capacity):
            piece = held[n].pop()
            counts[n], n_held = counts[n] - 1, n_held - 1
            yield row(piece, 0, n, made, offset)
            offset += n
        gap = capacity - offset
        if gap and n_held:  # nothing fits whole: cut the shortest remainder that reaches over
            n = min(k for k in range(1, capacity + 1) if counts[k])
            piece = held[n].pop()
            counts[n] -= 1
            yield row(piece, 0, gap, made, offset)
            doc, ids, at, tokens = piece
            held[n - gap].append((doc, ids[4 * gap :], at + gap, tokens))
            counts[n - gap] += 1
        made += 1

    def tail() -> Iterator[tuple]:
        """Less than a window is left: cut it at powers of two."""
        nonlocal made, n_held
        left = sum(n * len(x) for n, x in held.items())
        pieces = [x for n in sorted(held, reverse=True) for x in held[n]]
        room, offset = 0, 0
        for piece in pieces:
            start, size = 0, len(piece[1]) // 4
            while start < size:
                if not room:
                    room, offset = 1 << (left.bit_length() - 1), 0
                take = min(room, size - start)
                yield row(piece, start, take, made, offset)
                start, offset, room, left = start + take, offset + take, room - take, left - take
                if not room:
                    made += 1
        held.clear()
        n_held = 0

    for doc, ids in documents:
        tokens = len(ids) // 4
        whole = tokens - tokens % capacity
        for start in range(0, whole, capacity):
            yield doc, start, capacity, zlib.crc32(ids[4 * start : 4 * (start + capacity)]), tokens, base + made, 0
            made += 1
        if n := tokens - whole:
            held[n].append((doc, ids[4 * whole :], whole, tokens))
            counts[n], n_held = counts[n] + 1, n_held + 1
        while n_held > pool:
            yield from window()
    while n_held and sum(n * len(x) for n, x in held.items()) >= capacity:
        yield from window()
    yield from tail()


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, pool: int = POOL) -> DataFrame:
    """One row a piece: where it lies in its document and in its sequence, and a CRC of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()

        def documents() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                for doc, x in zip(batch.column(0).to_pylist(), words.ids(batch.column(1)), strict=True):
                    yield doc, x + end

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        for r in pack(documents(), TaskContext.get().partitionId(), capacity, pool):
            rows.append(r)
            if len(rows) == 20_000:
                yield out()
                rows.clear()
        if rows:
            yield out()

    return arrow_map(docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as t"), run, SCHEMA)
