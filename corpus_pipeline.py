"""The corpus pipeline: documents, stage by stage, each on all that its predecessor kept.

Every stage reads the Parquet that the one before wrote to the shared folder, so a lost executor costs a stage at
most; what a stage has read goes when its own result is written. Each has a null, empty or repeated row treated as its operator says; an empty table passes through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keystrata.llm import decontam, langid, pieces, pii, sigtree
from keystrata.llm.common import remove, shared_folder, table, written

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", langid.stage),
    ("jaccard_join", sigtree.stage),
    ("decontamination", decontam.stage),
    ("personal_data", pii.stage),
    ("sentencepiece", pieces.stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    folder, before = shared_folder(spark), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), folder, name)
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages learn models and search lattices, which SQL cannot express; tests hold them against plain versions.
ORACLE_SQL = None
