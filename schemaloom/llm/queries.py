"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import clustering, decontaminate, html_extract, line_dedup, mixing, packing, phrases, quality, secret_scan, sharding, simhash, sstable, toxicity
from .common import table


def _documents(op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(table(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": lambda spark, sf_dir: packing.op1_packing(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")),
        "op2_sharding": _documents(sharding.op2_sharding),
        "op3_secret_scan": _documents(secret_scan.op3_secret_scan),
        "op4_line_dedup": _documents(line_dedup.op4_line_dedup),
        "op5_quality_rules": lambda spark, sf_dir: quality.op5_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op6_toxicity": lambda spark, sf_dir: toxicity.op6_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op7_simhash": _documents(simhash.op7_simhash),
        "op8_html_extraction": lambda spark, sf_dir: html_extract.op8_html_extraction(table(spark, sf_dir, "pages")),
        "op9_decontamination": lambda spark, sf_dir: decontaminate.op9_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op10_token_output": lambda spark, sf_dir: sstable.op10_token_output(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")),
        "op11_clustering": lambda spark, sf_dir: clustering.op11_clustering(table(spark, sf_dir, "embeddings")),
        "op12_mixing": _documents(mixing.op12_mixing),
        "op13_phrases": _documents(phrases.op13_phrases),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_secret_scan": secret_scan.OP3_SQL,
        "op4_line_dedup": line_dedup.OP4_SQL,
        "op9_decontamination": decontaminate.OP9_SQL,
        "op11_clustering": clustering.OP11_SQL,
        "op13_phrases": phrases.OP13_SQL,
    }
