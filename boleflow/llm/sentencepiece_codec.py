"""SentencePiece encoding and decoding by an Aho-Corasick automaton and Viterbi.

All pieces of a public model form one automaton. One pass over a text follows it; at
each position the output links give every piece that ends there, and each relaxes the
best score of a segmentation that ends there. A character that no piece covers is
spelt in byte pieces at a score below every piece's.

Spaces become the mark U+2581, and one mark goes in front, as the model's own
normaliser has it. No piece goes across the start of a run of marks, so that the text
falls into units (marks, then other characters) which are segmented apart; a unit met
before costs a look-up. A mark that is in the text itself is spelt in bytes: decoding
gives back every text exactly.

The model's piece scores are those in its file. A model trained by merges then gets the
segmentation with the best sum of scores, which is not always the one its merges give.

Defined cases: null text counts as empty: no id. Repeated rows are encoded one by one
and alike; ties go to the segmentation with the longer last piece. An empty table gives
an empty result. Very long texts are encoded whole, a unit at a time.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, held

MARK = "▁"
UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
CACHE = 900_000
SCHEMA = "doc_id long, n_ids long, n_bytes_spelt long, ids_crc32 long, round_trip boolean"


class Codec:
    """pieces: (text, id, score) of ordinary pieces; spelling: ids of the 256 byte pieces."""

    def __init__(self, pieces: list[tuple[str, int, float]], spelling: list[int]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.text: dict[int, bytes] = {}
        for text, i, score in pieces:
            if MARK in text.lstrip(MARK):
                raise ValueError(f"the piece {text!r} goes across a mark")
            self.automaton.add_word(text, (len(text), i, score))
            self.text[i] = text.replace(MARK, " ").encode()
        self.automaton.make_automaton()
        self.spelling = spelling
        self.byte = {i: b for b, i in enumerate(spelling)}
        self.penalty = min((s for _, _, s in pieces), default=0.0) - 10.0
        self.units: dict[str, bytes] = {}

    def best(self, unit: str) -> bytes:
        """Ids of the best segmentation, as 32-bit words."""
        n = len(unit)
        ends: list[list[tuple[int, int, float]]] = [[] for _ in range(n)]
        for end, piece in self.automaton.iter(unit):
            ends[end].append(piece)
        score, back = [0.0] * (n + 1), [(0, -1)] * (n + 1)
        for end in range(n):
            top, choice = score[end] + self.penalty * len(unit[end].encode("utf-8", "surrogatepass")), (1, -1)
            for size, i, s in ends[end]:
                if (v := score[end + 1 - size] + s) > top or (v == top and size > choice[0]):
                    top, choice = v, (size, i)
            score[end + 1], back[end + 1] = top, choice
        ids, at = [], n
        while at:
            size, i = back[at]
            if i >= 0:
                ids.append(i)
            else:
                ids += [self.spelling[b] for b in reversed(unit[at - 1].encode("utf-8", "surrogatepass"))]
            at -= size
        return array("I", ids[::-1]).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if MARK not in text:
            return self.encode_marked(MARK + text.replace(" ", MARK))
        mark = array("I", [self.spelling[b] for b in MARK.encode()]).tobytes()
        first, *rest = text.split(MARK)
        parts = [self.encode_marked(MARK + first.replace(" ", MARK)), *(self.encode_marked(x.replace(" ", MARK)) for x in rest)]
        return mark.join(parts)

    def encode_marked(self, marked: str) -> bytes:
        if len(self.units) > CACHE:
            self.units.clear()
        units, found = UNITS(marked), self.units
        for u in set(units):
            if u not in found:
                found[u] = self.best(u)
        return b"".join([found[u] for u in units])

    def decode(self, ids: list[int]) -> str:
        out = b"".join([self.text[i] if i in self.text else bytes([self.byte[i]]) for i in ids])
        return out[1:].decode("utf-8", "surrogatepass")


def load(path: str) -> Codec:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    spelling = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    skip = set(spelling)
    n = range(m.get_piece_size())
    pieces = [(m.id_to_piece(i), i, m.get_score(i)) for i in n if i not in skip and not m.is_control(i) and not m.is_unknown(i)]
    return Codec(pieces, spelling)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA and ids, an array of the ids, for each document; round_trip tells that decoding gave the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held(f"sentencepiece {model_path}", lambda: load(model_path))
        low, high = min(codec.spelling), max(codec.spelling)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [np.frombuffer(codec.encode(t), np.uint32) for t in texts]
            same = [codec.decode(i.tolist()) == t if len(i) else not t for i, t in zip(ids, texts, strict=True)]
            spelt = [int(np.count_nonzero((i >= low) & (i <= high))) for i in ids]
            columns = [
                batch.column(0),
                pa.array([len(i) for i in ids], pa.int64()),
                pa.array(spelt, pa.int64()),
                pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()),
                pa.array(same, pa.bool_()),
                pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_ids", "n_bytes_spelt", "ids_crc32", "round_trip", "ids"])

    return arrow_map(docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as t"), run, SCHEMA + ", ids array<int>")
