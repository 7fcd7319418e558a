"""The queries of the training-data operators, and SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, license_scan, packing, phrase_dedup, quality, sentencepiece_codec, simhash, suffix_dedup, topk, url_filter
from .common import documents

#: Vocabulary files by name, for those that are elsewhere than the installed package says.
TOKENIZERS: dict[str, str] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    if name in TOKENIZERS:
        return TOKENIZERS[name]
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality")
    )


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    queries = rows.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return topk.search(rows, queries)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model")).drop("ids")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group(documents(spark, sf_dir)).select("doc_id", simhash.hex_of().alias("fingerprint"), "component_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model, pieces = langid.fit(docs.filter(~held_out()), tokenizer_path("piece_bpe_32k.model"))
    return langid.predict(docs, model, pieces, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "log_prob")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kept, the remaining bytes, also as text: a character that a cut parted becomes U+FFFD."""
    return suffix_dedup.dedup(documents(spark, sf_dir)).withColumn("text", F.expr("make_valid_utf8(cast(kept as string))")).drop("kept")


def op10_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.dedup(documents(spark, sf_dir)).drop("kept", "carried")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_simhash": op2_simhash,
    "op3_language_id": op3_language_id,
    "op7_license_scan": op7_license_scan,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_phrase_dedup": op10_phrase_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_topk": op5_topk,
    "op6_packing": op6_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op5_topk": """WITH c AS (SELECT vec_id, list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::HUGEINT << i::INTEGER) ELSE 0::HUGEINT END))::HUGEINT AS code FROM embeddings),
 d AS (SELECT q.vec_id AS query_id, b.vec_id, CAST(bit_count(xor(q.code, b.code)) AS BIGINT) AS distance FROM c q CROSS JOIN c b WHERE q.vec_id % 100 = 0)
 SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank, vec_id, distance FROM d) WHERE rank <= 10""",
}
