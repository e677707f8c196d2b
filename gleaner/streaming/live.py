"""Live scans: each trigger's findings against what was seen before (A9, streaming)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.results import new_only


def first_seen(rows: DataFrame) -> DataFrame:
    """For each (group, value) the first batch that had it, and its hits: what a live scan shows as new, batch by batch."""
    return rows.groupBy("group", "value").agg(F.min("batch").alias("batch"), F.count("*").alias("hits"))


def watch(findings: DataFrame, state: str, sink: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 0) -> StreamingQuery:
    """Call sink with each micro-batch's new findings; the (group, value) pairs seen are a table that grows by appends.

    A batch that is run again after a failure replaces its own part of the table, so nothing is counted twice.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen_schema = "`group` string, value string, batch long"
        try:
            seen = spark.read.schema(seen_schema).parquet(state).filter(F.col("batch") < number)
        except Exception as e:  # the table doesn't exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            seen = spark.createDataFrame([], seen_schema)
        fresh = new_only(batch, seen).persist()
        try:
            sink(fresh, number)
            fresh.select("group", "value").distinct().write.mode("overwrite").parquet(f"{state}/batch={number}")
        finally:
            fresh.unpersist()

    writer = findings.writeStream.queryName(f"watch-{uuid.uuid4().hex[:8]}").option("checkpointLocation", checkpoint).foreachBatch(step)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def new_within(findings: DataFrame, time_col: str, lateness: str) -> DataFrame:
    """Stateful twin with bounded memory: the first hit of each (group, value) within the watermark."""
    return findings.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark(["group", "value"])
