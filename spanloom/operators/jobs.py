"""Job records as rows: latest state, progress, lists, lookups, payloads and health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The stages of a job, in order.
STAGES = ("ingest", "transcribe", "index", "retrieve", "score", "render")


def latest(events: DataFrame) -> DataFrame:
    """Events (job, kind, seq, value): the last value of each kind for each job; works in batch and in update mode of a stream."""
    return events.groupBy("job", "kind").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"), F.count(F.lit(1)).alias("n_events"))


def overall_progress(status: Column, stage: Column, fraction: Column, stages: Sequence[str] = STAGES) -> Column:
    at = F.array_position(F.array(*map(F.lit, stages)), stage)
    part = F.least(F.greatest(F.coalesce(fraction, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.when(status == "done", 1.0).when(at > 0, (at - 1 + part) / len(stages)).otherwise(0.0)


def newest_first(jobs: DataFrame, n: int | None = None) -> DataFrame:
    rows = jobs.orderBy(F.desc("created_at"), "job")
    return rows if n is None else rows.limit(n)


def payload(row: Column) -> Column:
    """A server-sent event."""
    return F.concat(F.lit("data: "), F.to_json(row), F.lit("\n\n"))


def health(checks: DataFrame) -> DataFrame:
    return checks.agg(F.every("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.count(F.lit(1)).alias("checks"))


def without(jobs: DataFrame, gone: DataFrame) -> DataFrame:
    """Jobs left after a deletion."""
    return jobs.join(gone.select("job"), "job", "left_anti")


def public(jobs: DataFrame, transcript: bool = False) -> DataFrame:
    """Jobs (id, status, stage, stage_progress, ..., transcript) as shown to others: progress worked out, the transcript only if asked for."""
    part = F.coalesce(F.col("stage_progress"), F.lit(0.0))
    rows = jobs.withColumns({"progress": F.round(overall_progress(F.col("status"), F.col("stage"), part), 4), "stage_progress": F.round(part, 4)})
    return rows if transcript else rows.drop("transcript")
