"""Registry of this subpackage's queries and of the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, embedding_dedup, exact_dedup, hard_negatives, mixing, near_dedup, pitman_yor, quality, secrets, sharding, suffix_dedup, target_encoding


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.op1_quality,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_embedding_near_dedup": embedding_dedup.op3_embedding_near_dedup,
        "op4_minhash_near_dedup": near_dedup.op4_minhash_near_dedup,
        "op5_pitman_yor": pitman_yor.op5_pitman_yor,
        "op6_bpe": bpe.op6_bpe,
        "op7_mixing": mixing.op7_mixing,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_secret_scans": secrets.op9_secret_scans,
        "op10_sharding": sharding.op10_sharding,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_target_encoding": target_encoding.op12_target_encoding,
        "op13_decontamination": decontamination.op13_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": mixing.OP7_SQL, "op8_exact_dedup": exact_dedup.OP8_SQL, "op11_hard_negatives": hard_negatives.OP11_SQL, "op12_target_encoding": target_encoding.OP12_SQL, "op13_decontamination": decontamination.OP13_SQL}
