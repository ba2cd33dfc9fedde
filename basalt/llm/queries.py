"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import ann, chat, decontam, licenses, lm, mixing, oracles, pii, quality, suffixes
from .jaccard import jaccard_join
from .scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), Scratch(spark)).drop("perplexity")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return chat.format_turns(chat.transcript_pieces(conversations), Scratch(spark), model=chat.fit(conversations))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_spans(table(spark, sf_dir, "documents"), Scratch(spark))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), Scratch(spark))


def op8_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join(table(spark, sf_dir, "documents"), Scratch(spark))
    return found.select("doc_id", "class_id", "n_links", "n_copies")


def queries() -> dict[str, Query]:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_pii_scan, op2_mix_sources, op3_language_model, op4_license_scan, op5_chat_turns, op6_repeated_passages, op7_nearest_neighbours, op8_quality_score, op9_decontaminate, op10_jaccard_join)}


def oracle_sql() -> dict[str, str]:
    known = {
        "pipeline": corpus_pipeline.ORACLE_SQL,
        "op5_chat_turns": oracles.CHAT_TURNS,
        "op6_repeated_passages": oracles.REPEATED_PASSAGES,
        "op10_jaccard_join": oracles.JACCARD_JOIN,
    }
    return {name: text for name, text in known.items() if text}
