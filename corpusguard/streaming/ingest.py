"""Streaming forms: chunks scored against frozen statistics, and counts of security events. Beyond batch parity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusguard.operators.detector import score_chunks


def score_stream(chunks: DataFrame, stats: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Score each arriving batch of chunks with stored statistics and append it by level; a replayed batch overwrites its own folder."""

    def sink(batch: DataFrame, epoch: int) -> None:
        scored = score_chunks(batch, stats=stats).select(*batch.columns, "adjusted_risk", "risk_level", "triggered_rules")
        scored.write.mode("overwrite").partitionBy("risk_level").parquet(f"{out}/batch={epoch}")

    return chunks.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events per type and tumbling window; later than late is dropped from state, not from batch reads."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
