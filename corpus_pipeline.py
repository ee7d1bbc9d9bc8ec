"""The corpus pipeline: language ID, quality rules, near-dedup, suffix dedup, packing.

Each stage works on all documents that its predecessor kept. The first three drop documents, the fourth
takes passages of 50 words and more that occur elsewhere out of their texts, the last returns the packed pieces. A document whose text
loses all its bytes stays, as the end id alone. Stages bound the session's record batches (``small_batches``), so
that two tasks' workers fit beside an executor's heap.

Stages are tested against brute force; SQL can't express learning, sketches or packing, so there is no
SQL for the whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marlgrove.llm import language_id, near_dedup, quality_rules, suffix_dedup
from marlgrove.llm.common import made, scratch, small_batches, sweep, table
from marlgrove.llm.packing import pack_documents
from marlgrove.llm.queries import WORD_FILE

#: A repeated passage goes if it has as many words; 50 words have 200 bytes in any text of words of three letters.
PASSAGE_WORDS, PASSAGE_BYTES = 50, 200


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those of which no language has 35 % of the letters; texts in two languages stay."""
    small_batches(spark)
    return language_id.filter_docs(docs, least=0.35)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality_rules.filter_docs(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dedup.filter_docs(docs, percent=80)


def remove_repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return suffix_dedup.clean_docs(docs, window=PASSAGE_BYTES, least_words=PASSAGE_WORDS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack_documents(docs, public_tokenizers.path(WORD_FILE), end_id=1, room=4096)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", remove_repeated_bytes),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again."""
    docs, at = table(spark, sf_dir, "documents"), scratch(spark)
    for name, stage in STAGES[:-1]:
        before = made()
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        sweep(spark, since=before)
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
