"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from boleflow.llm import langid, license_scan, packing, phrase_dedup, quality, sentencepiece_codec, simhash, suffix_dedup, topk, url_filter
from boleflow.llm.queries import tokenizer_path

LONG = " ".join(f"word{i % 977}x{i}" for i in range(20000))
PROSE = "The quick brown fox jumps over the lazy dog near the river bank. " * 2
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", "en", "a", 3),
    (4, LONG, "en", "a", 1),
    (5, PROSE, "en", "a", 1),
    (5, PROSE, "en", "a", 1),
    (6, "der die das und ist nicht ein eine wir sie", "de", "b", 1),
    (7, "!!! ??? 123", None, "b", 1),
    (None, "no id here", "en", None, None),
]
CLASHES = ["t", "w", "h", "m", "v", "own", "row", "fp", "shard", "kept", "quality", "n_words", "lang_pred", "score", "url_", "host", "path", "component_id", "__text"]


def table(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return d.withColumns({c: F.lit(7) for c in CLASHES})


OPERATORS = {
    "simhash": lambda d: simhash.group(d),
    "langid": lambda d: langid.predict(d, *langid.fit(d, tokenizer_path("piece_bpe_32k.model")), ["doc_id"]),
    "quality": lambda d: quality.judge(d),
    "license": lambda d: license_scan.scan(d),
    "suffix": lambda d: suffix_dedup.dedup(d),
    "phrase": lambda d: phrase_dedup.dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_a_document(spark, name):
    got = OPERATORS[name](table(spark, ROWS)).collect()
    ids = sorted((r["doc_id"] for r in got if r["doc_id"] is not None))
    if name == "simhash":  # a join by fingerprint: every row once
        assert len(got) == len(ROWS)
    assert ids == [1, 2, 3, 4, 5, 5, 6, 7] and len(got) == len(ROWS)
    assert OPERATORS[name](table(spark, [])).count() == 0


def test_packing_edges(spark):
    d = table(spark, ROWS)
    pieces = packing.pack_documents(d, tokenizer_path()).collect()
    assert {r["doc_id"] for r in pieces} == {None, 1, 2, 3, 4, 5, 6, 7}
    assert packing.pack_documents(table(spark, []), tokenizer_path()).count() == 0
    assert [r["doc_tokens"] for r in pieces if r["doc_id"] in (1, 2, 3)] == [1, 1, 1]


def test_defined_results(spark):
    d = table(spark, ROWS)
    lang = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in OPERATORS["langid"](d).collect()}
    assert lang[1] == lang[2] == lang[7] == ("und", 0.0) and lang[6][0] == "de"
    fp = {r["doc_id"]: r["fp"] for r in OPERATORS["simhash"](d).collect()}
    assert fp[1] == fp[2] == fp[3] == 0
    kept = {r["doc_id"]: r["kept"] for r in OPERATORS["quality"](d).collect()}
    assert kept[1] is False and kept[2] is False
    gone = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in OPERATORS["phrase"](d).collect()}
    assert gone[1] == (0, 0) and gone[4][1] == 0


def test_filters_keep_columns_and_rows(spark):
    d = table(spark, [*ROWS, *[(100 + i, " ".join(f"{w}{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" for j, w in enumerate(PROSE.split())) + "\nA second line, with an end.", "en", "s", 9) for i in range(40)]])
    good = quality.keep_good(d)
    assert good.columns == d.columns and good.filter("doc_id >= 100").count() == 40
    assert quality.keep_good(table(spark, [])).count() == 0


def test_topk_edges(spark):
    rows = [(1, None), (2, []), (3, [1.0, -1.0]), (3, [1.0, -1.0]), (4, [None, 1.0]), (None, [1.0] * 64)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(7) for c in ["code", "block", "part", "query_id", "distance", "rank", "i", "c"]})
    coded = topk.coded(d)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in topk.search(coded, coded.filter("vec_id = 3").toDF("query_id", "code"), 4).collect())
    want = [(3, 1, 3, 0), (3, 2, 3, 0), (3, 3, 2, 1), (3, 4, 4, 2)]
    assert got == want  # the query row is there twice and asked once
    assert topk.search(coded.limit(0), coded.limit(0).toDF("query_id", "code")).count() == 0
    with pytest.raises(Exception, match="more values"):
        topk.coded(spark.createDataFrame([(1, [1.0] * 65)], "vec_id long, embedding array<double>")).collect()


def test_sentencepiece_edges(spark):
    d = table(spark, ROWS).withColumns({c: F.lit(7) for c in ["ids", "round_trip", "n_ids"]})
    got = sentencepiece_codec.encode(d, tokenizer_path("piece_bpe_32k.model")).collect()
    assert len(got) == len(ROWS) and all(r["round_trip"] for r in got)
    assert sentencepiece_codec.encode(d.limit(0), tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTPS://WWW.Example.COM/en/71?x"), (5, "http://a.example.com/en/8"), (5, "http://a.example.com/en/8"), (6, "http://xcom/en/"), (7, "x://example.net?/de/8"), (8, "x://a.example.net/de/81#"), (9, "http://net/de/"), (10, "http://é.org/es/" + "a" * 50000)]
    d = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(7) for c in ["host", "path", "rule", "score", "verdict", "y", "u"]})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(d).collect()}
    assert got[1][:3] == got[2][:3] == got[3][:3] == ("", "", None)
    assert got[4] == ("www.example.com", "/en/71", "example.com/en/7", "allow")
    assert got[5] == ("a.example.com", "/en/8", "com/en/", "block")
    assert got[6][2] is None and got[7][:3] == ("example.net", "", None)
    assert got[8][2:] == ("example.net/de/8", "block") and got[9][2:] == ("net/de/", "allow") and got[10][2:] == ("org/es/", "block")
    assert url_filter.judge(d.filter("page_id > 99")).count() == 0


def test_workers_keep_nothing_of_earlier_operators():
    """A group's function leaves no table of an operator before it, and the tokenizer is not asked for all texts at once."""
    import pyarrow as pa

    from boleflow.llm import common, packing

    common.held("earlier", dict)
    out = common.tidy_pair(lambda a, b: a.append_column("b", b.column(0)))(pa.table({"a": [1]}), pa.table({"b": [2]}))
    assert out.to_pydict() == {"a": [1], "b": [2]} and not common._HELD
    calls = []

    class Encoding:
        def __init__(self, text):
            self.ids, self.word_ids = list(map(len, text.split(" "))), list(range(text.count(" ") + 1))

    class Tokenizer:
        def encode_batch(self, texts, add_special_tokens):
            calls.append(len(texts))
            return list(map(Encoding, texts))

    words = packing.WordIds(Tokenizer())
    assert words.encode_parts(["a" * (i % 7 + 1) for i in range(200_000)]) == [(i % 7 + 1).to_bytes(4, "little") for i in range(200_000)]
    assert max(calls) <= packing.CALL < sum(calls)
