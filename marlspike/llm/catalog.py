"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, interpolation, lines, mixing, neardup, quality, topk, toxicity, warc, wrappers


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_deleted_interpolation": interpolation.op2_deleted_interpolation,
        "op3_pfair_mixing": mixing.op3_pfair_mixing,
        "op4_segment_top_k": topk.op4_segment_top_k,
        "op5_bpe": bpe.op5_bpe,
        "op6_line_dedup": lines.op6_line_dedup,
        "op7_wrapper_extraction": wrappers.op7_wrapper_extraction,
        "op8_warc": warc.op8_warc,
        "op9_order_minhash": neardup.op9_order_minhash,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality.SQL,
        "op4_segment_top_k": topk.SQL,
        "op6_line_dedup": lines.SQL,
        "op8_warc": warc.SQL,
    }
