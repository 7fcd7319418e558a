"""Removal of every word that lies in a long word sequence that occurs anywhere else too.

Candidates come from anchored windows of words (repeats.py), which confirm what recurs.
Each shard of documents then compiles the confirmed passages that it has into an
Aho-Corasick automaton over words: a span, the part of one that recurs, or spans that only
occur in a chain, read at one place of the shard. All its documents are streamed through,
and the automaton alone locates the occurrences.

Defined cases: null text counts as empty: no word, nothing removed. A document with fewer
words than the length keeps all. Repeated rows lose all their words if they are long
enough. An empty table gives an empty result. Windows never cross documents and are
judged on the input. Very long texts are hashed whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy_pair
from .repeats import BASES, LONG, U, Known, mix, nullable, powers, prefixes, read_chunks, table, texts_of, verdicts

LENGTH = 35
GRAM = 16
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def word_units(texts: list[bytes]) -> list[np.ndarray]:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return [np.fromiter(map(digest, words := t.split()), U, len(words)) for t in texts]


def window_digests(length: int):
    """Payload: digests of a span's windows."""

    def run(units: np.ndarray, first: int, last: int) -> bytes:
        p = prefixes(units[first : last + length], BASES[1])
        n = last - first + 1
        return mix((p[length : length + n] - p[:n]) * powers(BASES[1], n)[1][:n]).tobytes()

    return run


def resolve(anchor: np.ndarray, weight: np.ndarray, off: np.ndarray, windows: np.ndarray, digests: list[bytes]) -> list[np.ndarray]:
    """Resolver of repeats.verdicts: windows that recur at the same offset of the same anchor."""
    flat = np.frombuffer(b"".join(digests), U)
    of = np.repeat(np.arange(len(windows)), windows)
    end = np.cumsum(windows)
    offset = off[of] - (np.arange(len(flat)) - np.repeat(end - windows, windows))
    key = mix(flat ^ mix(anchor.view(U)[of] + offset.astype(U)))
    _, inverse = np.unique(key, return_inverse=True)
    again = np.bincount(inverse, weight[of])[inverse] >= 2
    return np.split(again, end[:-1])


#: A word of a passage is WIDTH symbols, of BASE each that no other place has. A node of the
#: automaton has few branches then, which its look-up goes through in turn, and no
#: occurrence starts inside a word.
WIDTH, BASE = 3, 128
#: Distinct words of one automaton's passages; more go to a further automaton.
WORDS = BASE**WIDTH


def symbols(i: int) -> str:
    return "".join([chr(1 + p * BASE + i // BASE**p % BASE) for p in range(WIDTH)])


def automata(passages: Iterable[tuple[bytes, ...]]) -> Iterator[tuple[dict[bytes, str], object]]:
    """(symbols of its words, automaton): one, or as many as the words call for."""
    import ahocorasick

    codes, automaton = {}, ahocorasick.Automaton()
    for p in passages:
        if len(codes) + len(p) > WORDS and codes:
            automaton.make_automaton()
            yield codes, automaton
            codes, automaton = {}, ahocorasick.Automaton()
        for w in p:
            if w not in codes:
                codes[w] = symbols(len(codes))
        automaton.add_word("".join([codes[w] for w in p]), len(p))
    if codes:
        automaton.make_automaton()
        yield codes, automaton


def runs_of_known(codes: dict[bytes, str], words: list[bytes], least: int) -> Iterator[tuple[int, str]]:
    """(start, symbols) of the longest runs of words that passages have, of least words or more."""
    found = list(map(codes.get, words))
    if None not in found:
        yield 0, "".join(found)
        return
    gone = [i for i, c in enumerate(found) if c is None]
    for a, b in zip([-1, *gone], [*gone, len(found)], strict=True):
        if b - a > least:
            yield a + 1, "".join(found[a + 1 : b])


def locate(docs: list[list[bytes]], passages: Iterable[tuple[bytes, ...]]) -> list[list[tuple[int, int]]]:
    """By document, what occurrences of passages cover: (start, end) from left to right."""
    passages = list(passages)
    out: list[list[tuple[int, int]]] = [[] for _ in docs]
    least = min(map(len, passages), default=1)
    for k, (codes, automaton) in enumerate(automata(passages)):
        for words, spans in zip(docs, out, strict=True):
            before = list(spans) if k else []
            spans.clear()
            for start, text in runs_of_known(codes, words, least):
                for at, n in automaton.iter(text):
                    end = start + (at + 1) // WIDTH
                    begin = end - n
                    while spans and spans[-1][1] >= begin:
                        begin = min(begin, spans.pop()[0])
                    spans.append((begin, end))
            if before:
                spans[:] = union([*before, *spans])
    return out


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


#: Words and the white space between them, in turn.
SPLIT = re.compile(rb"[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+").findall


def gaps(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """What lies between spans, from 0 to n, without empty pieces."""
    edges = [0, *(x for s in spans for x in s), n]
    return [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]


def cut(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    return [w for a, b in gaps(spans, len(words)) for w in words[a:b]]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, carry: list[str] | None = None) -> DataFrame:
    """One row a document: SCHEMA, kept, and carried, a struct of the columns carry.

    kept is what remains of the text, with its own white space inside what is kept in
    one piece; kept_sha256 is of the remaining words joined by one space.
    """
    dealt, found = verdicts(docs, length, gram, word_units, window_digests(length), resolve, id_col, text_col, carry)

    def finish(docs_t: pa.Table, verdict_t: pa.Table) -> pa.Table:
        texts, known = texts_of(docs_t), Known(verdict_t, length, gram)
        split = [t.split() for t in texts]
        passages: dict[tuple[bytes, ...], None] = {}
        chunks = [(members, starts, s) for members, _, starts, s in read_chunks(texts, word_units, length, gram)]
        for c, a, b in known.passages([(starts, s) for _, starts, s in chunks]):
            members, starts, _ = chunks[c]
            d = int(np.searchsorted(starts, a, side="right")) - 1
            passages[tuple(split[members[d]][a - int(starts[d]) : b - int(starts[d])])] = None
        places = locate(split, passages)
        n_removed, kept, sha = [], [], []
        for text, words, spans in zip(texts, split, places, strict=True):
            n_removed.append(sum(b - a for a, b in spans))
            if not spans:
                kept.append(text)
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                continue
            sha.append(hashlib.sha256(b" ".join(cut(words, spans))).hexdigest())
            ends = np.cumsum([len(w) for w in SPLIT(text)]).tolist()  # of words and gaps in turn
            offset = 1 if text[:1].isspace() else 0
            kept.append(b" ".join(text[ends[2 * a + offset - 1] if 2 * a + offset else 0 : ends[2 * b - 2 + offset]] for a, b in gaps(spans, len(words))))
        return table(
            {
                "doc_id": (docs_t.column("doc_id"), LONG),
                "n_words": ([len(w) for w in split], LONG),
                "n_removed": (n_removed, LONG),
                "kept_sha256": (sha, pa.string()),
                "kept": (kept, pa.binary()),
            }
        ).append_column("carried", nullable(docs_t.column("carried")))

    return dealt.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(tidy_pair(finish), f"{SCHEMA}, kept binary, carried {dealt.schema['carried'].dataType.simpleString()}")
