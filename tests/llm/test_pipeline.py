"""The pipeline's stages: columns, what goes and what stays, and equality of run() and the stages."""

from collections import Counter

import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns
    said = {n: {r["doc_id"]: r for r in pq.read_table(str(tmp_path / n)).to_pylist()} for n, _ in corpus_pipeline.STAGES[:4]}
    first = {r["doc_id"]: r for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}
    assert said["language_id"].keys() <= first.keys() and len(said["language_id"]) > 0.95 * len(first)
    near = said["simhash_near_dedup"]
    assert len({r["text"] for r in near.values()}) == len(near)  # no copy is left
    assert {r["text"] for r in near.values()} <= {r["text"] for r in said["quality_rules"].values()}
    last = said["substring_dedup"]
    assert last.keys() == near.keys() and all(len(last[k]["text"]) <= len(near[k]["text"]) and last[k]["n_chars"] == len(last[k]["text"]) for k in last)
    ran = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, ran.select("doc_id", "start", "length", "ids_crc32").collect())) != [] and ran.agg({"length": "sum"}).first()[0] == docs.agg({"length": "sum"}).first()[0]


def test_edges_of_stages(spark):
    """Nulls, repeated rows, rows that share an id, extra columns with clashing names, empty tables."""
    prose = "The quick brown fox jumps over the lazy dog near the old river bank and then it sleeps under a tall green tree for a while.\nIt wakes up when the sun goes down, and walks home again."
    other = "Seven sailors crossed the wide sea in a small wooden boat to find the island that their fathers had told them about long ago.\nThey found it, and stayed there."
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, prose, "en", "a", 1), (3, prose, "en", "a", 1), (4, prose, "en", "b", 1), (5, other, "en", "a", 1), (5, prose + " Yes.", None, None, None), (None, other, "en", None, None)]
    rows += [(100 + i, " ".join(f"{w}{chr(97 + i)}" for w in prose.split()), "en", "s", 9) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(7) for c in ["score", "lang_pred", "own", "row", "t", "v", "n_words", "kept", "carried", "shard", "component_id", "digest", "root", "typical"]})
    stages = dict(corpus_pipeline.STAGES)
    said = stages["language_id"](spark, d, "")
    assert said.columns == d.columns and {1, 2} & {r["doc_id"] for r in said.collect()} == set() and said.filter("doc_id = 5 and lang is null").count() == 0
    ruled = stages["quality_rules"](spark, d, "")
    assert ruled.columns == d.columns and {r["doc_id"] for r in ruled.collect()} >= {3, 4, 5}
    near = stages["simhash_near_dedup"](spark, d, "")
    left = Counter((r["doc_id"], r["text"]) for r in near.collect())
    assert near.columns == d.columns and set(left.values()) == {1}
    assert (3, prose) in left and (4, prose) not in left and (None, other) in left
    cut = stages["substring_dedup"](spark, d, "")
    assert cut.columns == d.columns and cut.count() == d.count() and cut.filter("score <> 7").count() == 0
    packed = stages["packing"](spark, d, "")
    assert {r["doc_id"] for r in packed.collect()} == {r[0] for r in rows}
    for stage in stages.values():
        assert stage(spark, d.limit(0), "").count() == 0


def test_run_leaves_one_table(spark):
    from boleflow.llm.common import written

    before = written()
    corpus_pipeline.run(spark, DATA).count()
    assert len(written() - before) == 1  # the input of the last stage
