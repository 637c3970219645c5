"""The registered queries of the subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from karstflow.llm import bpe, class_lm, interleave, packing, pii, quality, secret_scan, sharding, simhash, token_matrix
from karstflow.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_simhash_near_dedup": lambda spark, d: simhash.query(table(spark, d, "documents")),
        "op2_interleaved_media": lambda spark, d: interleave.query(table(spark, d, "documents")),
        "op3_randomness_battery": lambda spark, d: secret_scan.query(table(spark, d, "documents")),
        "op4_quality_rules": lambda spark, d: quality.query(table(spark, d, "documents")),
        "op5_pair_index_bpe": lambda spark, d: bpe.query(table(spark, d, "documents")),
        "op6_disclosing_terms": lambda spark, d: pii.query(table(spark, d, "documents")),
        "op7_minimum_bin_slack": lambda spark, d: packing.query(table(spark, d, "documents")),
        "op8_packed_matrices": lambda spark, d: token_matrix.query(table(spark, d, "documents")),
        "op9_class_bigrams": lambda spark, d: class_lm.query(table(spark, d, "documents")),
        "op10_hash_tree_sharding": lambda spark, d: sharding.shard_rows(table(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    """SQL has neither XXH64 nor CRC-32 nor the places of a pattern's matches nor a tokeniser: it can state op4 alone."""
    return {"op4_quality_rules": quality.SQL}
