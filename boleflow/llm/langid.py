"""Language identification by unigrams of pieces, summed over all segmentations.

A language gives every piece of a fixed public vocabulary a probability. The probability
of a word is the sum over all its segmentations into pieces, by a forward recursion over
its characters; a text's score is the product over its words. Piece probabilities come
from expectation-maximisation (forward-backward) over the words of a bounded sample of
labelled documents: sample_docs a language, chosen by a hash of the id.

Words are runs of letters, lower-cased, with the vocabulary's word-start mark in front.
All words of a text count, and all pieces of the vocabulary. A word met before costs a
look-up, so that the recursion runs over the distinct words of what a worker sees.

Beside the posterior, which only weighs the learnt languages against each other, there is
an absolute measure: the log probability a character under the best language. Texts of
junk, or in a language that was not learnt, lie far below that of labelled texts.

Defined cases: null text, and text without a letter: language und, score 0. Ties go to
the first language in sorted order. Repeated rows are judged one by one and alike. An
empty table gives an empty result; with no labelled row every text is und.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, held

SAMPLE_DOCS = 200
EM_ROUNDS = 3
#: Letters of a run that training takes at once; longer runs are learnt in slices of so many.
SLICE = 40
#: How far a text's log probability a character may lie below its language's mean (see floors).
MARGIN = 1.25
#: Words from which on a text is long enough for that.
ENOUGH = 20
#: Probability of a single character that is no piece of the vocabulary.
FLOOR = 1e-7
UNKNOWN = "und"
CACHE = 300_000
START = "▁"

_RUNS = re.compile(r"[^\W\d_]+").findall
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    found = _RUNS(text.lower())
    if found and not "".join(found).isalpha():  # numerals such as superscripts
        found = re.findall(r"\S+", "".join(c if c.isalpha() else " " for w in found for c in w + " "))
    return found


def vocabulary(path: str) -> list[str]:
    """Pieces of letters alone, with or without the word-start mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if (p.lstrip(START).isalpha() or p == START) and p == p.lower()})


class Segmenter:
    """Forward (and backward) sums over all segmentations, for many words at once."""

    def __init__(self, pieces: list[str]):
        known: dict[int, int] = {}  # the hash of every beginning of a piece: the piece's row, or 0
        for row, piece in enumerate(pieces, 1):
            h = 0
            for c in piece:
                h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                known.setdefault(h, 0)
            known[h] = row
        keys = np.fromiter(known, np.uint64, len(known))
        order = np.argsort(keys)
        self.keys, self.rows = keys[order], np.fromiter(known.values(), np.int64, len(known))[order]
        self.n = len(pieces) + 1  # row 0: no piece
        self.longest = max(map(len, pieces), default=1)

    def blocks(self, marked: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(indices, characters as a matrix) of words of one length, which have their marks."""
        sizes = np.array([len(w) for w in marked])
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        for group in np.split(order, cuts):
            for at in range(0, len(group), 8192):
                part = group[at : at + 8192]
                text = "".join([marked[i] for i in part])
                yield part, np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(part), -1)

    def pieces_at(self, chars: np.ndarray, i: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words, piece rows) of the pieces of 1, 2, ... characters from i; of one character for all words, row 0 if none."""
        words, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        for k in range(i, min(i + self.longest, chars.shape[1])):
            with np.errstate(over="ignore"):
                h = h * _BASE + (chars[words, k].astype(np.uint64) + np.uint64(1))
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            begins = self.keys[at] == h
            rows = np.where(begins, self.rows[at], 0)
            is_piece = rows > 0
            yield (words, rows) if k == i else (words[is_piece], rows[is_piece])
            words, h = words[begins], h[begins]  # where no piece begins like this none is longer
            if not len(words):
                return

    def forward(self, found: list[str], p: np.ndarray) -> np.ndarray:
        """Log probabilities, words by languages; p: pieces (row 0: none) by languages."""
        out = np.empty((len(found), p.shape[1]))
        for part, chars in self.blocks([START + w for w in found]):
            n, size = chars.shape
            turn = min(self.longest, size) + 1
            ring = np.zeros((turn, n, p.shape[1]))
            ring[0] = 1
            scale = np.zeros(n)
            for i in range(size):
                here = ring[i % turn]
                if i % 8 == 0 and i:  # keep long words in range; one factor for all languages
                    top = np.maximum(ring.max(axis=(0, 2)), 1e-300)
                    ring /= top[None, :, None]
                    scale += np.log(top)
                for k, (on, rows) in enumerate(self.pieces_at(chars, i), 1):
                    q = np.maximum(p[rows], FLOOR) if k == 1 else p[rows]
                    ring[(i + k) % turn, on] += here[on] * q
                here[:] = 0
            out[part] = np.log(np.maximum(ring[size % turn], 1e-300)) + scale[:, None]
        return out

    def expected(self, found: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected piece counts of one language's words, with their marks, under p (a vector over pieces)."""
        total = np.zeros(self.n)
        for part, chars in self.blocks(found):
            n, size = chars.shape
            found_at = [list(self.pieces_at(chars, i)) for i in range(size)]
            q = [[np.maximum(p[r], FLOOR) if k == 0 else p[r] for k, (_, r) in enumerate(x)] for x in found_at]
            a, b = np.zeros((size + 1, n)), np.zeros((size + 1, n))
            a[0], b[size] = 1, 1
            for i in range(size):
                for k, ((on, _), x) in enumerate(zip(found_at[i], q[i], strict=True), 1):
                    a[i + k, on] += a[i, on] * x
            for i in range(size - 1, -1, -1):
                for k, ((on, _), x) in enumerate(zip(found_at[i], q[i], strict=True), 1):
                    b[i, on] += x * b[i + k, on]
            weight = counts[part] / np.maximum(a[size], 1e-300)
            for i in range(size):
                for k, ((on, r), x) in enumerate(zip(found_at[i], q[i], strict=True), 1):
                    total += np.bincount(r, a[i, on] * x * b[i + k, on] * weight[on], self.n)
        return total


def train(samples: dict[str, list[str]], pieces: list[str], rounds: int = EM_ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in sorted order, and piece probabilities (row 0: none) by language."""
    segmenter, langs, columns = Segmenter(pieces), sorted(samples), []
    for lang in langs:
        counted = Counter(w for text in samples[lang] for w in words(text))
        sliced: Counter[str] = Counter()
        for w, n in counted.items():
            for at in range(0, len(w), SLICE):
                sliced[START * (at == 0) + w[at : at + SLICE]] += n
        found = list(sliced)
        counts = np.array([sliced[w] for w in found], float)
        p = np.full(segmenter.n, 1 / segmenter.n)
        for _ in range(rounds if found else 0):
            e = segmenter.expected(found, counts, p) + 0.05
            e[0] = 0
            p = e / e.sum()
        p[0] = 0
        columns.append(p)
    return langs, np.stack(columns, 1) if columns else np.zeros((segmenter.n, 0))


def floors(samples: dict[str, list[str]], model: tuple[list[str], np.ndarray], pieces: list[str], margin: float = MARGIN) -> np.ndarray:
    """By language, the log probability a character that a text of ENOUGH words must reach.

    It lies below the mean of the labelled texts of the language by margin, or by twice
    the distance of the least of them, if that is more.
    """
    (langs, p), segmenter, out = model, Segmenter(pieces), []
    for k, lang in enumerate(langs):
        split = [ws for t in samples[lang] if len(ws := words(t)) >= ENOUGH]
        found = list({w for ws in split for w in ws})
        score = dict(zip(found, segmenter.forward(found, p[:, k : k + 1])[:, 0], strict=True)) if found else {}
        each = [sum(score[w] for w in ws) / sum(len(w) + 1 for w in ws) for ws in split]
        mean = float(np.mean(each)) if each else 0.0
        out.append(mean - max(margin, 2 * (mean - min(each))) if each else -np.inf)
    return np.array(out)


def sample(labelled: DataFrame, id_col: str, lang_col: str, per_lang: int = SAMPLE_DOCS) -> DataFrame:
    """About per_lang rows of each language: those with the smallest hashes of the id.

    The shares come from one count over ids and labels; texts are read for the rows
    taken alone.
    """
    counts = labelled.filter(F.col(lang_col).isNotNull()).groupBy(lang_col).count().collect()
    h = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30))
    take = F.lit(False)
    for r in counts:
        take = take | ((F.col(lang_col) == r[lang_col]) & (h < min(1 << 30, per_lang * (1 << 30) // r["count"] + 1)))
    return labelled.filter(take)


Model = tuple[list[str], np.ndarray, np.ndarray]


def judged(docs: DataFrame, model: Model, pieces: list[str], keep: list[str], text_col: str = "text") -> DataFrame:
    """own (a struct of the columns keep), lang_pred, score, log_prob and typical.

    score is the language's posterior, all alike before; log_prob is the log probability a
    character (null without a word); typical is false if a text of ENOUGH words or more is
    less probable than the language's floor allows.
    """
    langs, p, floor = model
    key = f"langid {hash((tuple(langs), p.tobytes()))}"
    inside = text_col in keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(pieces)
        index, scores = held(key, lambda: ({}, [np.empty((0, len(langs)))]))
        for batch in batches:
            texts = (batch.column(0).field(text_col) if inside else batch.column(1)).cast(pa.string()).to_pylist()
            out_lang, out_score, out_log, out_typical = [], [], [], []
            for at in range(0, len(texts), 64):
                if len(index) > CACHE:
                    index.clear()
                    scores[0] = scores[0][:0]
                found = [words(t) if t else [] for t in texts[at : at + 64]]
                new = list({w for ws in found for w in ws if w not in index})
                if new and langs:
                    index.update(zip(new, range(len(scores[0]), len(scores[0]) + len(new)), strict=True))
                    scores[0] = np.concatenate([scores[0], segmenter.forward(new, p)])
                for ws in found:
                    if not ws or not langs:
                        out_lang.append(UNKNOWN)
                        out_score.append(0.0)
                        out_log.append(None)
                        out_typical.append(False)
                        continue
                    s = scores[0][np.fromiter(map(index.__getitem__, ws), np.int64, len(ws))].sum(0)
                    best = int(s.argmax())
                    out_lang.append(langs[best])
                    out_score.append(float(1 / np.exp(s - s[best]).sum()))
                    out_log.append(float(s[best]) / (sum(map(len, ws)) + len(ws)))
                    out_typical.append(len(ws) < ENOUGH or bool(out_log[-1] >= floor[best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out_lang, pa.string()), pa.array(out_score, pa.float64()), pa.array(out_log, pa.float64()), pa.array(out_typical, pa.bool_())], names=["own", "lang_pred", "score", "log_prob", "typical"])

    own = F.struct(*keep).alias("own")
    chosen = docs.select(own) if inside else docs.select(own, F.col(text_col).cast("string").alias("t"))
    return arrow_map(chosen, run, f"own {chosen.schema['own'].dataType.simpleString()}, lang_pred string, score double, log_prob double, typical boolean")


def predict(docs: DataFrame, model: Model, pieces: list[str], keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep, lang_pred, score, log_prob and typical (see judged)."""
    return judged(docs, model, pieces, keep, text_col).select("own.*", "lang_pred", "score", "log_prob", "typical")


def fit(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_DOCS) -> tuple[Model, list[str]]:
    """(languages, piece probabilities, floors) and the pieces, from labelled documents; a bounded sample comes to the driver."""
    pieces = vocabulary(vocabulary_path)
    rows = sample(docs.filter(F.col(text_col).isNotNull()), id_col, lang_col, per_lang).select(lang_col, text_col).collect()
    samples: dict[str, list[str]] = {}
    for lang, text in rows:
        samples.setdefault(lang, []).append(text)
    model = train(samples, pieces)
    return (*model, floors(samples, model, pieces)), pieces
