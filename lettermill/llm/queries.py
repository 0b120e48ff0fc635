"""Queries of the training-data problems and their SQL, where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lettermill.llm import entities, lookalike, mojibake, packing, quality, tokens
from lettermill.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.damaged_values(table(spark, sf_dir, "manifest"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.imitations(table(spark, sf_dir, "manifest"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.linked_rows(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "address_book"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_documents(table(spark, sf_dir, "documents"))


def p8_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "pack_sizes").select("pack_id", "capacity_tokens").orderBy("pack_id").limit(packing.MOST_CAPACITIES + 1).collect()
    return packing.pack_documents(table(spark, sf_dir, "documents"), [(r[0], r[1]) for r in sizes])


def p9_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.text_types(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p3_found": p3_found, "p5_found": p5_found, "p7_ids": p7_ids, "p8_packs": p8_packs, "p9_found": p9_found, "p9_stats": p9_stats}

SQL: dict[str, str] = {}
