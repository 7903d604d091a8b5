"""From raw documents to packed sequences, in five stages that each write and reread a table.

STAGES lists (name, function); each function takes (spark, docs, folder) and returns the documents it keeps,
with the columns of the documents table, but for the last, which returns the pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ringwarden.llm import mixing, near_text, packing, pii, toxicity
from ringwarden.session import store, tune

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
# Weights of the quality domains in the mix; documents are repeated for it, and none is left out. The total follows from the two.
TARGET = {"good": 0.95, "poor": 0.05}
TOTAL_FACTOR = None
MIN_RATE = 1.0
# All stages run on the same executors, whose heap grows to the most that any stage takes. So few rows, which are whole texts, are read at
# once, and the encoder remembers fewer words than where it is all that runs.
READ_ROWS = "512"
REMEMBERED_WORDS = 150_000


def few_rows(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the compression-distance classifier does not call toxic."""
    few_rows(spark)
    return toxicity.without_toxic(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest doc_id."""
    few_rows(spark)
    return near_text.one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The same documents with personal data replaced by the kind it is of."""
    few_rows(spark)
    return pii.redact(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as their rates say, at least once."""
    few_rows(spark)
    labels = mixing.quality_domains(spark.read.parquet(f"{folder}/labels.parquet"))
    return mixing.mix(docs, labels, TARGET, TOTAL_FACTOR, MIN_RATE)


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with their ids."""
    few_rows(spark)
    return packing.pack(docs, TOKENIZER, END_ID, remembered=REMEMBERED_WORDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_to_targets),
    ("packing", pack_sequences),
]

# Compression, signatures, rates and tokenization have no form in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
