"""Provenance and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T

def rescued(relevant: DataFrame, attempt_evidence: DataFrame, memory_evidence: DataFrame) -> DataFrame:
    """(q, memory_id) that share evidence with a relevant attempt (q, attempt_id)."""
    seen = relevant.join(attempt_evidence, "attempt_id").select("q", "evidence_id").distinct()
    return seen.join(memory_evidence, "evidence_id").select("q", "memory_id").distinct()


def absorbed(root_causes: DataFrame, attempts: DataFrame) -> DataFrame:
    """(attempt_id, memory_id): each attempt under the first root cause (by pos) that shares evidence with it."""
    both = root_causes.join(attempts, "evidence_id")
    return both.groupBy("attempt_id").agg(F.min(F.struct("pos", "memory_id")).memory_id.alias("memory_id"))


def recall(memories: DataFrame, needle: str, limit: int = 20) -> DataFrame:
    """The current memories that hold the text most often."""
    if not needle or limit < 1:
        raise ValueError("an empty query or a limit below 1")
    found = memories.withColumn("hits", T.occurrences(F.col("content"), needle)).where("hits > 0")
    return found.orderBy(F.desc("hits"), F.desc("seq"), "memory_id").limit(limit)
