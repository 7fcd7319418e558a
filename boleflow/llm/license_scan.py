"""License scan: phrase places, and an exact set-similarity join against templates.

Text blocks are joined to license templates on token containment: a template matches a
block that holds at least threshold of the template's distinct tokens. Blocks are the
lines of a document and, across line ends, all runs of as many words as the template has,
so that a wrapped notice is found too. Tokens are ordered by their frequency in the whole corpus, rarest first; a match
must share a token of the template's prefix (prefix filter), must be long enough (length
filter) and must be able to reach the overlap from where the tokens meet (positional
filter). What passes is verified in full, so that the join is exact.

The frequency table holds the templates' tokens only: its size is bounded by the fixed
templates, not by the corpus. The templates are a fixed table and go with the code.

Defined cases: null text counts as empty: no word, no label, score 0. Repeated rows are
scanned one by one and alike. An empty table gives an empty result. Very long texts are
scanned whole; only lines and runs that share a rare template token are looked at closely.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, binary

# Phrases with their labels, and the notices that the templates state.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "agpl": ["gnu affero general public license"],
    "apache": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license",
        "distributed on an as is basis without warranties or conditions of any kind",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
    ],
    "cc_by": ["licensed under a creative commons attribution 4 0 international license"],
    "cc_by_nc": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial"],
    "cc_by_nc_nd": ["licensed under cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives"],
    "cc_by_nc_sa": ["licensed under cc by nc sa 4 0", "creative commons attribution noncommercial sharealike"],
    "cc_by_nd": ["licensed under cc by nd 4 0", "creative commons attribution noderivatives"],
    "cc_by_sa": ["licensed under cc by sa 4 0", "creative commons attribution sharealike"],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    ],
    "lgpl": ["gnu lesser general public license"],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
    ],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "reserved": ["all rights reserved"],
}
THRESHOLD = 0.9

#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of ASCII letters and digits and of other characters above ASCII."""
    return text.translate(_TABLE).split()


def _templates() -> list[tuple[str, list[bytes]]]:
    return [(label, sorted(set(t.encode().split()))) for label, ts in TEMPLATES.items() for t in ts]


def token_frequencies(docs: DataFrame, text_col: str = "text") -> dict[bytes, int]:
    """Documents that hold each template token, over all documents; as many rows as the templates have tokens."""
    vocabulary = {w for _, t in _templates() for w in t}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for text in binary(batch, "t"):
                for w in vocabulary.intersection((text or b"").translate(_TABLE).split()):
                    seen[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])

    counted = arrow_map(docs.selectExpr(f"cast(`{text_col}` as string) as t"), run, "w string, n long")
    found = {r["w"].encode(): r["n"] for r in counted.groupBy("w").agg(F.sum("n").alias("n")).collect()}
    return {w: found.get(w, 0) for w in vocabulary}


class Matcher:
    """The templates' side of the join: an index from prefix tokens to templates."""

    def __init__(self, frequencies: dict[bytes, int], threshold: float = THRESHOLD):
        self.rank = {w: i for i, (_, w) in enumerate(sorted((n, w) for w, n in frequencies.items()))}
        self.templates, self.index = [], {}
        self.n_words = [len(t.split()) for ts in TEMPLATES.values() for t in ts]
        for label, tokens in _templates():
            ordered = sorted(self.rank[w] for w in tokens)
            need = -(-len(ordered) * round(threshold * 1000) // 1000)
            for at, r in enumerate(ordered[: len(ordered) - need + 1]):
                self.index.setdefault(r, []).append((len(self.templates), at))
            self.templates.append((label, frozenset(ordered), len(ordered), need))
        by_rank = {r: w for w, r in self.rank.items()}
        self.prefix_tokens = {by_rank[r] for r in self.index}

    def match(self, block: list[bytes]) -> list[tuple[str, float]]:
        """(label, containment) of every template that the block matches."""
        ranks = sorted({self.rank[w] for w in block if w in self.rank})
        seen: set[int] = set()
        out = []
        for at, r in enumerate(ranks):
            for t, at_template in self.index.get(r, ()):
                if t in seen:
                    continue
                label, tokens, size, need = self.templates[t]
                # tokens of either side before this one can't be shared, or it would have met there
                if len(ranks) < need or 1 + min(len(ranks) - at - 1, size - at_template - 1) < need:
                    continue
                seen.add(t)
                if (shared := len(tokens.intersection(ranks))) >= need:
                    out.append((label, shared / size))
        return out


    def match_runs(self, found: list[bytes]) -> list[tuple[str, float]]:
        """(label, containment) of every template that some run of as many words as it has matches."""
        best: dict[int, int] = {}
        done: dict[int, int] = {}
        for at in [i for i, w in enumerate(found) if w in self.prefix_tokens]:
            for t, _ in self.index[self.rank[found[at]]]:
                label, tokens, size, need = self.templates[t]
                n = self.n_words[t]
                # runs that hold this place and were not looked at for an earlier one
                first, last = max(0, at - n + 1, done.get(t, 0)), min(at, max(0, len(found) - n))
                done[t] = max(last + 1, done.get(t, 0))
                if best.get(t) == size or first > last:
                    continue
                ranks = [self.rank.get(w) for w in found[first : last + n]]
                if len(tokens.intersection(ranks)) < need:
                    continue
                for k in range(last - first + 1):
                    if (shared := len(tokens.intersection(ranks[k : k + n]))) >= need:
                        best[t] = max(shared, best.get(t, 0))
        return [(self.templates[t][0], shared / self.templates[t][2]) for t, shared in best.items()]


def _phrase_places(found: list[bytes]) -> tuple[list[int], set[str]]:
    starts, labels = [], set()
    at = -1
    while True:
        try:
            at = found.index(b"license", at + 1)
        except ValueError:
            return starts, labels
        for phrase, label in PHRASES.items():
            parts = phrase.encode().split()
            first = at - len(parts) + 1
            if first >= 0 and found[first : at + 1] == parts:
                starts.append(first)
                labels.add(label)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: words, phrase places, labels of phrases, labels of both, best containment.

    score is the highest containment of a matching template; a phrase alone gives 1.
    """
    frequencies = token_frequencies(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(frequencies, threshold)
        rare = matcher.prefix_tokens
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), binary(batch, "t"), strict=True):
                flat = (text or b"").translate(_TABLE)
                found = flat.split()
                places, base = _phrase_places(found) if b"license" in flat else ([], set())
                labels, score = set(base), 1.0 if base else 0.0
                if not rare.isdisjoint(found):
                    for label, contained in matcher.match_runs(found):
                        labels.add(label)
                        score = max(score, contained)
                    for line in text.split(b"\n"):
                        if any(w in (low := line.translate(_TABLE)) for w in rare):
                            for label, contained in matcher.match(low.split()):
                                labels.add(label)
                                score = max(score, contained)
                rows.append((doc, len(found), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return arrow_map(docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as t"), run, SCHEMA)
