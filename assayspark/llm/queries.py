"""The opN queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat_format, embedding_dedup, langid, minhash_dedup, mixing, nearest, prefix_trie, quality, secrets, substring_dedup, suffix_dedup, turn_repair

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": minhash_dedup.op1,
    "op2_vantage_point_search": nearest.op2,
    "op3_secret_scan": secrets.op3,
    "op4_suffix_dedup": suffix_dedup.op4,
    "op5_quality_classifier": quality.op5,
    "op6_language_id": langid.op6,
    "op7_byte_bpe": bpe.op7,
    "op8_source_mixing": mixing.op8,
    "op9_embedding_dedup": embedding_dedup.op9,
    "op10_substring_dedup": substring_dedup.op10,
    "op11_turn_repair": turn_repair.op11,
    "op12_prefix_trie": prefix_trie.op12,
    "op13_chat_format": chat_format.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": minhash_dedup.ORACLE,
    "op8_source_mixing": mixing.ORACLE,
    "op9_embedding_dedup": embedding_dedup.ORACLE,
    "op11_turn_repair": turn_repair.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_chat_format": chat_format.ORACLE,
}
