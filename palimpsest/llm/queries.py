"""One query per operator, over whole tables, and the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, decontaminate, galloping, langid, lines, orchard, quotes, secretscan, simhash, sst, substrings, tokenfile, topk
from palimpsest.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and link group of every document."""
    return simhash.simhash_groups(table(spark, folder, "documents"))


def op2_site_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return sst.main_text(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the ids of every document and of the text they decode to."""
    return bpe.digests(bpe.encode_decode(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digest=True))


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other values."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_hash")


def op5_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best candidates of every vector whose id is divisible by 20."""
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_langid(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document, learned from those that are not held out."""
    docs = table(spark, folder, "documents")
    content = langid.learn(docs.where(~langid.held_out()))
    out = langid.identify(docs.select("doc_id", "text"), content)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
                      F.col("lang_rejected").alias("rejected"))


def op7_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that at least ten documents share."""
    docs = table(spark, folder, "documents")
    store = lines.LineStore.empty(spark, lines.shards_for(docs.count()), min_docs=10, min_chars=1).insert(docs)
    return store.clean(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Every message without quotes, linked to what it answers, with its place in reply order."""
    return quotes.link_quotes(table(spark, folder, "conversations")).withColumn("reply_path", F.array_join("reply_path", "/"))


def op9_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the words that runs of 20 words starting earlier cover."""
    return substrings.duplicate_spans(table(spark, folder, "documents"), 20).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as token files, read back: place, length and checksum of each document's ids."""
    place, manifest = tokenfile.token_files(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2)
    return tokenfile.read_files(spark, place, manifest).select(
        "doc_id", "start", (F.length("raw") / 4).cast("long").alias("n_tokens"), F.crc32("raw").alias("ids_crc32"))


def op11_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document, with what its owners' own values add; a source is an owner, a document a repository."""
    return secretscan.digests(secretscan.scan(table(spark, folder, "documents")))


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups, links and pair counts of every document between two vocabularies."""
    return galloping.align(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_orchard(spark: SparkSession, folder: str) -> DataFrame:
    """Product code, error and codebooks of every vector."""
    return orchard.digests(orchard.codes(table(spark, folder, "embeddings")))


QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_site_tree": op2_site_tree,
    "op3_bpe": op3_bpe,
    "op4_decontaminate": op4_decontaminate,
    "op5_topk": op5_topk,
    "op6_langid": op6_langid,
    "op7_lines": op7_lines,
    "op8_quotes": op8_quotes,
    "op9_substrings": op9_substrings,
    "op10_token_files": op10_token_files,
    "op11_secrets": op11_secrets,
    "op12_alignment": op12_alignment,
    "op13_orchard": op13_orchard,
}
