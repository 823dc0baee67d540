"""A training-corpus pipeline over the documents table: quality rules, line dedup, near duplicates, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlspike.llm import bpe, lines, mixing, neardup, quality
from marlspike.llm.common import table, written

#: (name, function of (spark, docs, sf_dir)): each works on all that the one before it kept.
STAGES = [
    ("quality_rules", quality.stage),
    ("line_dedup", lines.stage),
    ("near_dedup", neardup.stage),
    ("mix_sources", mixing.placed),
    ("bpe_encode", bpe.stage),
]

#: Near-duplicate classes are not expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
