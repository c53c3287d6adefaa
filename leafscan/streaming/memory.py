"""Evidence memory kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscan.operators.memory import MEMORY_KEY


def memory_stream(notes: DataFrame) -> DataFrame:
    """J6 as a streaming aggregate (update or complete mode): newest fields win, uses add up."""
    cols = ["doc_id", "evidence_summary", "evidence_status", "source_turn", "last_used_at"]
    newest = F.max_by(F.struct(*cols), F.struct("source_turn", "last_used_at", "evidence_summary"))
    merged = notes.groupBy(*MEMORY_KEY).agg(newest.alias("n"), F.count("*").alias("use_count"), F.min("last_used_at").alias("created_at"))
    return merged.select(*MEMORY_KEY, "n.*", "use_count", "created_at")
