"""Near copies of the pipeline against brute force, and recall by similarity."""

import random

import numpy as np

import corpus_pipeline
from boleflow.llm import near
from boleflow.llm.simhash import fold, shingle_hashes

DATA = "/root/testdata/sf0.001"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else frozenset()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted(rng, share, n=300):
    """A text of n words and a copy whose shingle sets have a similarity just over share."""
    words = [f"w{rng.randrange(10**9)}" for _ in range(n)]
    a, copy = shingles(" ".join(words)), list(words)
    for at in rng.sample(range(n), n):
        tried = [*copy[:at], f"x{rng.randrange(10**9)}", *copy[at + 1 :]]
        if similarity(a, shingles(" ".join(tried))) >= share:
            copy = tried
    return " ".join(words), " ".join(copy)


def test_recall_by_similarity(spark):
    rng, rows, kinds = random.Random(5), [], {}
    for share in (0.8, 0.85, 0.9, 0.95):
        for _ in range(20):
            i = len(rows)
            rows += [(i + k, t) for k, t in enumerate(planted(rng, share))]
            kinds.setdefault(share, []).append(i)
    low = len(rows)
    while len(rows) < low + 40:
        a, b = planted(rng, 0.7)
        if similarity(shingles(a), shingles(b)) < 0.8:
            rows += [(len(rows), a), (len(rows) + 1, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    recall = {s: sum(i + 1 not in left for i in at) / len(at) for s, at in kinds.items()}
    assert recall == dict.fromkeys(kinds, 1.0)
    assert all(i in left for i in range(low, len(rows)))  # nothing below the limit goes


def brute(rows, limit=0.8):
    sets = [shingles(t or "") for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] == rows[j][0] or similarity(sets[i], sets[j]) >= limit:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (d, _), x in zip(rows, label, strict=True):
        least[x] = min(d, least.get(x, d))
    return {(d, least[x]) for (d, _), x in zip(rows, label, strict=True)}


def test_groups_as_brute_force(spark, monkeypatch):
    rng, rows = random.Random(9), [(0, ""), (1, None), (2, "one two"), (3, "One  two"), (4, "one three")]
    base = [f"b{i}" for i in range(60)]
    passage = " ".join(f"p{i}" for i in range(30))
    for i in range(5, 150):
        words = list(base) if i % 3 else [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(40)}"
        rows.append((i, " ".join(words) + (f" {passage}" if i % 4 == 0 else "")))
    rows += [(20, rows[7][1]), (200, rows[30][1]), (200, "another text under the same id as that")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for common in (2, 10**6):  # the order of shingles changes the work, not the result
        monkeypatch.setattr(near, "COMMON", common)
        assert {tuple(r) for r in near.group(docs).select("doc_id", "component_id").collect()} == brute(rows)
    assert near.group(docs.limit(0)).count() == 0


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 50, 400, 40_000):
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a, b = np.unique(pool[: n + n // 3]), np.unique(pool[n // 3 :])
        assert np.abs(near.sketch(a).astype(int) - near.sketch(b)).sum() <= len(np.setxor1d(a, b))


def test_pairs_of_large_roots_as_brute_force():
    """Every pair of different groups that can be near is sent, none of one group."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets, tops = [], []
    for i in range(260):
        s = np.unique(np.concatenate([base[rng.permutation(200)[: int(rng.integers(120, 200))]], rng.integers(0, 1 << 63, int(rng.integers(0, 60)), dtype=np.uint64)]))
        sets.append(s)
        tops.append(0 if i % 4 else int(rng.integers(0, 6)))
    roots = [0] * 200 + [1] * 40 + [2] * 20
    fps = rng.integers(-(1 << 62), 1 << 62, 260)
    batch = pa.RecordBatch.from_arrays([pa.array(roots), pa.array(range(260)), pa.array([len(s) for s in sets]), pa.array(fps), pa.array([0] * 260), pa.array(tops), pa.array([near.sketch(s).tobytes() for s in sets], pa.binary())], names=["root", "id", "n", "fp", "pos", "top", "sketch"])
    got = {(r["a"], r["b"]) for out in near.apart(iter([batch]), 800) for r in out.to_pylist()}
    for i in range(260):
        for j in range(i + 1, 260):
            if roots[i] == roots[j] and tops[i] != tops[j] and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])):
                assert (i, j) in got
    assert all(roots[i] == roots[j] and tops[i] != tops[j] for i, j in got)


def test_groups_of_given_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert {tuple(r) for r in near.group(docs).select("doc_id", "component_id").collect()} == brute(rows)


def test_the_fingerprint_index_gives_pairs(spark):
    """The index links the groups that all pairs of at most four bits would, and nothing else; its near pairs are near copies without a root."""
    rng = random.Random(8)
    texts = [t for _ in range(30) for t in planted(rng, 0.97, 200)]
    fps = [int(np.uint64(fold(shingle_hashes(t.encode(), 5))).view(np.int64)) for t in texts]
    fps += [fps[0]] * 3  # of one fingerprint
    got = near.indexed(spark.createDataFrame(list(enumerate(fps)), "id long, fp long")).collect()

    def groups(pairs):
        top = list(range(len(fps)))
        for _ in fps:
            for a, b in pairs:
                top[a] = top[b] = min(top[a], top[b])
        return top

    close = [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 4]
    assert groups([(r["a"], r["b"]) for r in got]) == groups(close) and sum(b == a + 1 and a % 2 == 0 for a, b in close) > 15


def test_near_copies_come_by_the_index(spark, monkeypatch):
    """With no root at all, those within the index's reach are still found: the rest is what the exact roots add."""
    rng = random.Random(9)
    texts = [t for _ in range(20) for t in planted(rng, 0.97, 200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r["doc_id"]: r["component_id"] for r in near.group(docs).collect()}
    assert all(whole[i] == i - i % 2 for i in whole)
    monkeypatch.setattr(near, "shared", lambda batches, limit: iter(()))
    alone = {r["doc_id"]: r["component_id"] for r in near.group(docs).collect()}
    assert sum(alone[i] == i - 1 for i in range(1, 40, 2)) > 10 and all(alone[i] in (i, i - i % 2) for i in alone)
