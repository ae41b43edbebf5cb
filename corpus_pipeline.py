"""From raw documents to token ids: STAGES in order, each reading what its predecessor wrote.

A stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one the tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, decontaminate, langid, lines, simhash
from palimpsest.llm.store import document_batches, written


SHORT = 20  # letters below which a text is kept whatever its language seems to be


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents whose language is told with a margin; learned from the labelled documents of the input.

    A text of fewer than SHORT letters is too short to be judged and stays; null and empty texts and texts without a letter go.
    Repeated rows are judged alike. Columns of `docs` may have any names but those with two underscores ahead.
    """
    document_batches(spark)
    judged = langid.identify(docs, langid.learn(docs), prefix="__")
    n_letters = F.length(F.regexp_replace("text", r"\P{L}+", ""))
    return judged.where(~F.col("__rejected") | n_letters.between(1, SHORT - 1)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents share are gone from every document; n_chars follows the text. A null text becomes an empty
    one, rows of one id are one document in the count, and every row stays."""
    document_batches(spark)
    store = lines.LineStore.empty(spark, lines.shards_for(docs.count())).insert(docs)
    return store.clean(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more. See `simhash.keep_one` for null and
    empty texts, repeated ids and ties."""
    document_batches(spark)
    return simhash.keep_one(docs, words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents that hold no benchmark item, neither as it is nor with other values. Null and empty texts hold none and stay."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded_sha256): token ids of every row, and the digest of what they decode to. Null and empty texts have no ids."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), digest=True)


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("tokens", tokens)]
ORACLE_SQL = None  # language, near copies and tokens are no SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
