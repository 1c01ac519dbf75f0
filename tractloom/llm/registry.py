"""The corpus queries of the driver contract and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractloom.llm import (
    chat,
    decontaminate,
    hard_negatives,
    language_model,
    mixing,
    packing,
    quality,
    repeats,
    secrets,
    simhash,
    structure,
    toxicity,
    urls,
)
from tractloom.llm.common import table
from tractloom.llm.oracle import ORACLE_SQL


def op1_toxicity_chain(spark: SparkSession, folder: str) -> DataFrame:
    """The labels have two columns, so the chain has two links: low quality, then toxic."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    chain = {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}
    return toxicity.toxicity(docs, table(spark, folder, "labels"), chain).drop("text")


def op2_language_model(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return language_model.language_model_scores(docs, carried=["doc_id"])


def op3_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    left = repeats.without_repeats(docs, carried=["doc_id"], with_bytes=False)
    return left.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )


def op4_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return secrets.secret_spans(docs).select("doc_id", *secrets.digest())


def op5_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    views = chat.perspectives(table(spark, folder, "conversations"))
    spans = F.transform("mask", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return views.withColumn("mask", F.array_join(spans, ","))


def op6_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return urls.judged_urls(pages, urls.hosts_mostly_blocked(pages)).drop("url")


def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", mixing.sizes(F.col("text")).alias("size"))
    return mixing.fair_queue_mix(docs, F.col("size")).select("doc_id", "size", "source_size", "target", "taken")


def op8_simhash_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, carried=["doc_id"])


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.benchmark_hits(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    return quality.quality_verdicts(docs, carried=["doc_id"]).select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_curve_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    pieces = packing.packed_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), carried=["doc_id"])
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Dialogues with planted faults; turns that are dropped stay as rows that are not present."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    case = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", blank)
    return turns.select(
        "conv_id",
        "turn",
        F.when(case == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(case == 1, "").when(case == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (case != 0).alias("present"),
        F.explode(F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = damaged(table(spark, folder, "conversations"))
    return structure.structure_report(turns, present=F.col("present"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_chain": op1_toxicity_chain,
    "op2_language_model": op2_language_model,
    "op3_repeated_passages": op3_repeated_passages,
    "op4_secret_scans": op4_secret_scans,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_url_filters": op6_url_filters,
    "op7_source_mixing": op7_source_mixing,
    "op8_simhash_duplicates": op8_simhash_duplicates,
    "op9_decontamination": op9_decontamination,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_curve_packing": op12_curve_packing,
    "op13_conversation_repair": op13_conversation_repair,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
