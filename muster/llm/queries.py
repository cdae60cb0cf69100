"""The registered queries of this package; each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm import bm25, bpe_count, centroids, chat, jaccard, langid, merkle, mixing, oddsketch, packing, quality, substring, warc
from muster.llm.tables import documents

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}

#: The vocabulary file of the token counts.
TOKENIZER = "piece_bpe_32k.model"
CONTEXT = 4096


def query(key: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        QUERIES[key] = run
        if sql is not None:
            SQL[key] = sql
        return run

    return add


@query("op1_substring_dedup", substring.SQL)
def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that windows of smaller documents cover, and a digest of the kept words."""
    cut = substring.dedup(documents(spark, folder))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


@query("op2_ngram_jaccard", jaccard.SQL)
def op2_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Set size and component of every document under links of 85 hundredths or more over four-word shingles."""
    return jaccard.join_components(documents(spark, folder), n=4, num=85, den=100)


@query("op3_preferences", chat.SQL)
def op3_preferences(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt and masked completions of every conversation against the same one with another's ending."""
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    told = chat.format_preferences(chat.with_other_endings(turns))
    return told.select(
        "pair_id", "n_prompt_turns", "prompt", "chosen", "rejected",
        chat.mask_text(F.col("chosen_mask")).alias("chosen_mask"), chat.mask_text(F.col("rejected_mask")).alias("rejected_mask"), "usable",
    )


@query("op4_quality_rules", quality.SQL)
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every document under thresholds of its language and source."""
    told = quality.verdicts(documents(spark, folder).select("doc_id", "text", "lang", "source"))
    return told.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op5_bm25_whole_text", bm25.SQL)
def op5_bm25_whole_text(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for every twentieth document, asked by all terms of its whole text, against all documents."""
    docs = documents(spark, folder)
    index = bm25.build_index(docs)
    df, n, average = bm25.frequencies(index)
    found = bm25.search(index, bm25.whole_queries(docs.where("doc_id % 20 = 0"), df, n), average)
    return found.select(F.col("query").alias("query_id"), F.col("doc").alias("doc_id"), F.col("rank").cast("bigint").alias("rank"), "score")


@query("op6_pack_lengths")
def op6_pack_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Bucket, batch and slot of every piece of every document."""
    return packing.pack(documents(spark, folder))


@query("op7_mix_sources")
def op7_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Words taken of every document when the sources are mixed to their target weights."""
    mixed = mixing.mix(documents(spark, folder))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every document."""
    path = public_tokenizers.path(TOKENIZER)
    counted = documents(spark, folder).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        bpe_count.token_count(F.col("text"), path).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > CONTEXT)


@query("op9_derived_records")
def op9_derived_records(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata and conversion record of every page, linked to its response record."""
    return warc.derive(warc.responses(spark.read.parquet(f"{folder}/pages.parquet")), key="page_id")


@query("op10_language_id")
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The predicted language of every document; a third of them is held out from learning."""
    docs = documents(spark, folder).select("doc_id", "text", "lang", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"))
    model = langid.fit(docs.where("NOT held_out"))
    return langid.predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


@query("op11_centroid_clusters", centroids.SQL)
def op11_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster, distance and inertia of every whole vector after five rounds around forty centroids."""
    assigned, last = centroids.cluster(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return centroids.told(assigned, last)


@query("op12_merkle_manifest", merkle.SQL)
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether the proof holds for a text that may have been changed."""
    manifest = merkle.build(merkle.document_leaves(documents(spark, folder)), "lang", "doc_id", carry=["tampered"])
    return merkle.proofs(manifest, "doc_id", "tampered")


@query("op13_near_duplicates", oddsketch.SQL)
def op13_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Set size and component of every document under links of 85 hundredths or more over five-word shingles."""
    return oddsketch.near_duplicates(documents(spark, folder))
