"""The queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import tune
from . import (
    huffman, importance, lexical, line_rules, mixing, near_text, near_vectors, packing, phrase_prints, pii, quotes, secret_scan, toxicity,
)
from .sql import SQL

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
# Weights of the quality domains that op8 fits rates for.
TARGET = {"good": 0.95, "poor": 0.05}


def _table(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_probminhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_text.near_digest(_table(spark, folder))


def op2_secret_linking(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secrets_digest(_table(spark, folder))


def op3_quantised_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors.near_vectors(_table(spark, folder, "embeddings"))


def op4_huffman_ids(spark: SparkSession, folder: str) -> DataFrame:
    return huffman.huffman_digest(_table(spark, folder), TOKENIZER, END_ID)


def op5_compression_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, folder), _table(spark, folder, "labels"))


def op6_cost_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packing_digest(_table(spark, folder), TOKENIZER, END_ID)


def op7_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    return line_rules.rules_digest(_table(spark, folder))


def op8_soft_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.rates(_table(spark, folder), mixing.quality_domains(_table(spark, folder, "labels")), TARGET)


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pii_digest(_table(spark, folder))


def op10_quote_linking(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.conversations(_table(spark, folder, "conversations"))


def op11_importance(spark: SparkSession, folder: str) -> DataFrame:
    return importance.importance_digest(_table(spark, folder), _table(spark, folder, "benchmark"))


def op12_dual_tree_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(_table(spark, folder, "benchmark"), _table(spark, folder))


def op13_phrase_prints(spark: SparkSession, folder: str) -> DataFrame:
    return phrase_prints.fingerprints(_table(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (
        op1_probminhash, op2_secret_linking, op3_quantised_vectors, op4_huffman_ids, op5_compression_toxicity,
        op6_cost_packing, op7_line_rules, op8_soft_mixing, op9_pii, op10_quote_linking,
        op11_importance, op12_dual_tree_search, op13_phrase_prints,
    )
}
