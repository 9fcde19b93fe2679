"""Registered queries of the training-data operators and their SQL checks."""

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    bpe,
    divergence,
    exact,
    language,
    lines,
    mixing,
    negatives,
    packing,
    quality_model,
    quality_rules,
    sharding,
    simhash,
    substring,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _documents(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: make(table(spark, folder, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_language": _documents(language.predictions),
        "op2_simhash": _documents(simhash.near_duplicates),
        "op3_exact": _documents(exact.content_groups),
        "op4_quality_rules": _documents(quality_rules.judged),
        "op5_sharding": _documents(sharding.assignments),
        "op6_lines": _documents(lines.line_digests),
        "op7_quality_model": lambda spark, folder: quality_model.predictions(
            table(spark, folder, "documents"), table(spark, folder, "labels")
        ),
        "op8_substring": _documents(substring.passage_digests),
        "op9_packing": _documents(packing.pack_documents),
        "op10_bpe": _documents(bpe.digests),
        "op11_mixing": _documents(mixing.mixture),
        "op12_negatives": lambda spark, folder: negatives.mined(table(spark, folder, "embeddings")),
        "op13_divergence": _documents(divergence.audit),
        "pipeline": corpus_pipeline.run,
    }


def checks() -> dict[str, str]:
    return {
        "op3_exact": exact.EXACT_SQL,
        "op4_quality_rules": quality_rules.RULES_SQL,
        "op8_substring": substring.PASSAGES_SQL,
        "op11_mixing": mixing.MIX_SQL,
        "op12_negatives": negatives.NEGATIVES_SQL,
        "op13_divergence": divergence.AUDIT_SQL,
    }
