"""Registered queries of the operators for training data, and their SQL twins.

Each query takes ``(spark, sf_dir)``, applies one operator with its production parameters to a whole table and
derives the result columns from what the operator returns. Queries without SQL train or cannot be said in SQL at
table size; ``tests/llm`` holds those against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelake.llm import (
    decontaminate, html_text, language, line_dedup, mixing, near_dup, quality_classifier, quality_rules, resampling, sentence_pieces,
    token_counts, twins, warc, whitening,
)
from edgelake.llm.folds import fold
from edgelake.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query(twins.HOST_RULES)
def op1_host_rules(spark, sf):
    return quality_rules.apply_host_rules(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query(twins.MIX)
def op10_mix_sources(spark, sf):
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query(twins.NEAR_DUPLICATES)
def op4_near_duplicates(spark, sf):
    return near_dup.near_duplicates(table(spark, sf, "documents"))


@query()
def op5_decontaminate(spark, sf):
    found = decontaminate.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", F.size("items").cast("bigint").alias("n_items"), "items", "kept")


@query(twins.WARC)
def op2_warc_normalise(spark, sf):
    return warc.archive_round_trip(table(spark, sf, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query()
def op3_quality_attention(spark, sf):
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    model = quality_classifier.fit(docs, labels.where(fold(F.col("doc_id"), 4) != 2))
    return quality_classifier.score(docs, model).select(
        "doc_id",
        (fold(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= quality_classifier.THRESHOLD).cast("int").alias("predicted"),
    )


@query()
def op6_language_mixture(spark, sf):
    docs = table(spark, sf, "documents")
    model = language.fit(docs.where(fold(F.col("doc_id"), 3) != 1))
    return language.predict(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score"
    )


@query()
def op7_html_text(spark, sf):
    return html_text.extract(table(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")


@query()
def op8_line_runs(spark, sf):
    found = line_dedup.delete_copies(table(spark, sf, "documents"))
    return found.select(
        "doc_id",
        F.col("_lines").alias("n_lines"),
        F.col("_deleted").alias("n_deleted"),
        F.length("text").cast("bigint").alias("n_chars"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


@query()
def op9_token_recount(spark, sf):
    return token_counts.redacted_counts(table(spark, sf, "documents")).select(
        "doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_reencoded"
    )


@query(twins.RESAMPLE)
def op11_resample(spark, sf):
    return resampling.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query()
def op12_whiten(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings"))


@query()
def op13_sentence_pieces(spark, sf):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return sentence_pieces.encode(table(spark, sf, "documents"), model, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
