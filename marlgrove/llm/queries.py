"""The operators' queries: each reads its whole table and returns its whole result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .hash_index import nearest
from .language_id import identify_held_out
from .near_dedup import near_duplicates
from .packing import pack_documents
from .piece_codec import encode_digests
from . import oracles, substring_dedup, suffix_dedup
from .quality_rules import judge
from .token_count import count_tokens
from .token_files import token_files

Query = Callable[[SparkSession, str], DataFrame]

WORD_FILE, BYTE_FILE, PIECE_FILE = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(table(spark, sf_dir, "documents"), window=400)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_FILE), end_id=1, room=4096)


def op3_hash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeat_digests(table(spark, sf_dir, "documents"), window=35)


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_FILE))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_held_out(table(spark, sf_dir, "documents"))


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_FILE), limit=512)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_FILE), end_id=2)


QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_hash_index": op3_hash_index,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_piece_codec": op5_piece_codec,
    "op6_near_dedup": op6_near_dedup,
    "op7_language_id": op7_language_id,
    "op8_token_count": op8_token_count,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_files": op10_token_files,
}

#: Of operators that SQL can express; the others are tested against the libraries or by measures.
ORACLES: dict[str, str] = {"op1_suffix_dedup": oracles.OP1, "op4_substring_dedup": oracles.OP4, "op6_near_dedup": oracles.OP6, "op9_quality_rules": oracles.OP9}
