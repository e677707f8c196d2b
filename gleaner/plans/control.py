"""Cancelling scans: jobs that run under a tag can be stopped from another thread (section 2.9)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Actions in the block carry the tag."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Stop the running jobs of a tag; what they had found so far is dropped."""
    spark.sparkContext.cancelJobsWithTag(tag)
