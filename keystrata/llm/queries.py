"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keystrata.llm import chat, decontam, langid, pieces, pii, ppm, rlz, sigtree, toxicity, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ppm": ppm.op1_ppm,
    "op2_chat": chat.op2_chat,
    "op3_langid": langid.op3_langid,
    "op4_pieces": pieces.op4_pieces,
    "op5_decontam": decontam.op5_decontam,
    "op6_substring": rlz.op6_substring,
    "op7_pii": pii.op7_pii,
    "op8_jaccard": sigtree.op8_jaccard,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_vectors": vectors.op10_vectors,
}
ORACLES: dict[str, str] = {
    "op2_chat": chat.ORACLE,
    "op6_substring": rlz.ORACLE,
    "op7_pii": pii.ORACLE,
    "op8_jaccard": sigtree.ORACLE,
    "op10_vectors": vectors.ORACLE,
}
