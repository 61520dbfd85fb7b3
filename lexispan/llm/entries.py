"""Queries of the operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexispan.llm import chat, jaccard, langid, mixing, neargraph, pieces, quality, sharding, template, toxicity
from lexispan.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": lambda spark, sf: toxicity.scored(table(spark, sf, "documents"), table(spark, sf, "labels")),
        "op2_embedding_dedup": lambda spark, sf: neargraph.groups(table(spark, sf, "embeddings")),
        "near_copies_of_embeddings": lambda spark, sf: neargraph.groups(neargraph.with_near_copies(table(spark, sf, "embeddings"))),
        "op10_html_extraction": lambda spark, sf: template.extracted(table(spark, sf, "pages")),
        "op3_chat_format": lambda spark, sf: chat.conversations(table(spark, sf, "conversations")),
        "op4_sharding": lambda spark, sf: sharding.assignment(table(spark, sf, "documents")),
        "op5_jaccard_join": lambda spark, sf: jaccard.groups(table(spark, sf, "documents")),
        "op6_language_id": lambda spark, sf: langid.identified(table(spark, sf, "documents")),
        "op7_mixing": lambda spark, sf: mixing.manifest(table(spark, sf, "documents")),
        "op8_quality_rules": lambda spark, sf: quality.report(table(spark, sf, "documents")),
        "op9_sentencepiece": lambda spark, sf: pieces.encoded(table(spark, sf, "documents")),
        "sentencepiece_round_trip": lambda spark, sf: pieces.restored(table(spark, sf, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_embedding_dedup": neargraph.GROUPS_SQL,
        "near_copies_of_embeddings": neargraph.COPIES_SQL,
        "op3_chat_format": chat.SQL,
        "op4_sharding": sharding.ASSIGNMENT_SQL,
        "op5_jaccard_join": jaccard.GROUPS_SQL,
        "op7_mixing": mixing.MANIFEST_SQL,
        "op8_quality_rules": quality.REPORT_SQL,
        "sentencepiece_round_trip": pieces.RESTORED_SQL,
    }
