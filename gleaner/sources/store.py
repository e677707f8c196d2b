"""Saved scans, jobs, favourites and ignore rules as Parquet tables in one folder.

Findings are written first and the session's header last; a session exists once its header does, so a writer that is lost
leaves nothing visible. Small catalog tables are replaced as a whole, each version in a folder of its own.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.results import compare
from ..plans.options import Job, OptionError

_HEAD = "id long, name string, source string, created timestamp, folder string"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{path}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def save_session(self, findings: DataFrame, name: str, source: str) -> int:
        folder = uuid.uuid4().hex
        findings.write.parquet(f"{self.root}/findings/{folder}")
        number = (self.sessions().agg(F.max("id")).first()[0] or 0) + 1
        head = self.spark.range(1).select(F.lit(number).cast("long").alias("id"), F.lit(name).alias("name"), F.lit(source).alias("source"), F.current_timestamp().alias("created"), F.lit(folder).alias("folder"))
        head.coalesce(1).write.mode("append").parquet(f"{self.root}/sessions")
        return number

    def sessions(self) -> DataFrame:
        return self._read("sessions", _HEAD).orderBy(F.desc("id"))

    def load_session(self, number: int) -> DataFrame:
        head = self.sessions().filter(F.col("id") == number).first()
        if head is None:
            raise OptionError(f"unknown session {number}")
        return self.spark.read.parquet(f"{self.root}/findings/{head['folder']}")

    def compare_sessions(self, left: int, right: int) -> DataFrame:
        return compare(self.load_session(left), self.load_session(right))

    def _put(self, table: str, rows: list[tuple], schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{self.root}/{table}/version={time.time_ns()}")

    def _now(self, table: str, schema: str) -> DataFrame:
        rows = self._read(table, schema + ", version long")
        last = rows.agg(F.max("version")).first()[0]
        return rows.filter(F.col("version") == F.lit(last)).drop("version")

    def save_job(self, job: Job) -> None:
        """Insert, or replace the job of that name."""
        others = [tuple(r) for r in self._now("jobs", "name string, payload string").filter(F.col("name") != job.name).collect()]
        self._put("jobs", [*others, (job.name, job.payload())], "name string, payload string")

    def jobs(self) -> DataFrame:
        return self._now("jobs", "name string, payload string").select("name").orderBy(F.lower("name"), "name")

    def load_job(self, name: str) -> Job:
        row = self._now("jobs", "name string, payload string").filter(F.col("name") == name).first()
        if row is None:
            raise OptionError(f"unknown job: {name}")
        return Job.parse(row["payload"])

    def set_favorite(self, kind: str, target: str, on: bool = True) -> None:
        rows = {tuple(r) for r in self._now("favorites", "kind string, target string").collect()} - {(kind, target)}
        self._put("favorites", sorted(rows | ({(kind, target)} if on else set())) or [(None, None)], "kind string, target string")

    def favorites(self, kind: str) -> DataFrame:
        return self._now("favorites", "kind string, target string").filter(F.col("kind") == kind).select("target").orderBy(F.lower("target"), "target")

    def set_ignore_rules(self, rules: list[str]) -> None:
        self._put("ignore_rules", list(enumerate(rules)) or [(-1, "")], "pos int, rule string")

    def ignore_rules(self) -> DataFrame:
        return self._now("ignore_rules", "pos int, rule string").filter("pos >= 0").orderBy("pos")
