"""Corpus pipeline: five stages over documents, each a training-data operator.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns the columns of documents; the last returns the pieces of packed sequences. Null
and empty texts go at the first stage (no language). Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boleflow.llm import langid, near, packing, phrase_dedup, quality
from boleflow.llm.common import discard, materialise, sweep, written
from boleflow.llm.queries import tokenizer_path

#: The language's posterior that a document must reach.
MIN_LANGUAGE_SCORE = 0.5
#: Near copies: the Jaccard similarity of the sets of five-word shingles, compared in full.
SHINGLE, NEAR = 5, 0.8

#: Nothing below can be said in SQL: a fitted language model, expectation-maximisation,
#: bit counts of hashes, and a tokenizer.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with some certainty; a null lang takes the prediction.

    Beside the posterior a document of some length must be about as probable, character by
    character, as labelled ones of its language: junk and languages that no label has go.
    """
    model, pieces = langid.fit(docs, tokenizer_path("piece_bpe_32k.model"))
    said = langid.judged(docs, model, pieces, docs.columns)
    sure = said.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE) & F.col("typical"))
    lang = F.coalesce("own.lang", "lang_pred").alias("lang")
    return sure.select(*[lang if c == "lang" else F.col(f"own.`{c}`").alias(c) for c in docs.columns])


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are probably good."""
    return quality.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id.

    Rows that share a doc_id are one document and go or stay together; only rows of the
    same text and doc_id are one row. Rows without an id can't stand for a group and all stay.
    """
    grouped = near.group(docs, shingle=SHINGLE, threshold=NEAR)
    stays = grouped.filter("doc_id = component_id").select("doc_id").distinct()
    chosen = docs.join(stays, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    return chosen.unionByName(docs.filter("doc_id IS NULL"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the long word sequences that occur elsewhere too."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    left = phrase_dedup.dedup(docs, carry=others)
    text = F.col("kept").cast("string")
    made = left.select("doc_id", text.alias("text"), F.length(text).cast("long").alias("n_chars"), *[F.col(f"carried.`{c}`").alias(c) for c in others])
    return made.select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed token sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language),
    ("quality_rules", rules),
    ("simhash_near_dedup", near_copies),
    ("substring_dedup", passages),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before = written()
        made = materialise(stage(spark, docs, sf_dir))
        sweep(spark, before, [made])  # what the stage wrote for itself
        discard(docs)  # only what materialise() wrote: the input stays
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
