"""Files and byte windows."""

from __future__ import annotations

import glob as _glob
import os
import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.kernel import CHUNKS, scan_bytes
from ..operators.results import dedup, glob_regex
from ..plans.options import FileSelection, Options

WINDOW, OVERLAP, LIMIT = 1 << 20, 1 << 16, 2 << 30


def pattern_list(patterns: str) -> list[str]:
    return [p.strip() for p in re.split("[;,]", patterns) if p.strip()]


def matches_list(path: Column, patterns: str) -> Column:
    """Whether the file name, the path or, for a pattern with /, any later part of the path matches a glob."""
    out = F.lit(False)
    for p in pattern_list(patterns):
        body = glob_regex(p)[1:-1]
        if "/" in p:
            out = out | path.rlike(f"(?is)^(?:.*/)?{body}$")
        else:
            out = out | path.rlike(f"(?is)^{body}$") | F.regexp_extract(path, "[^/]*$", 0).rlike(f"(?is)^{body}$")
    return out


def under_excluded(path: Column, patterns: str) -> Column:
    """Whether the path or a folder above it matches."""
    out = F.lit(False)
    for p in pattern_list(patterns):
        body = glob_regex(p)[1:-1]
        if "/" in p:
            out = out | path.rlike(f"(?is)^(?:.*/)?{body}(?:/.*)?$")
        else:
            out = out | path.rlike(f"(?is)^{body}(?:/.*)?$") | F.exists(F.split(path, "/"), lambda s: s.rlike(f"(?is)^{body}$") & (s != ""))  # noqa: B023
    return out


def select_files(listing: DataFrame, selection: FileSelection) -> DataFrame:
    """A listing (path, length, modificationTime) by a selection, before any content is read."""
    path, out = F.col("path"), listing
    if selection.include and selection.include != "*":
        out = out.filter(matches_list(path, selection.include))
    if selection.exclude:
        out = out.filter(~under_excluded(path, selection.exclude))
    if selection.min_size:
        out = out.filter(F.col("length") >= selection.min_size)
    if selection.max_size:
        out = out.filter(F.col("length") <= selection.max_size)
    seconds = F.unix_timestamp("modificationTime")
    if selection.modified_after:
        out = out.filter(seconds >= selection.modified_after)
    if selection.modified_before:
        out = out.filter(seconds <= selection.modified_before)
    return out


def scan_paths(spark: SparkSession, paths: list[str], options: Options | None = None, selection: FileSelection | None = None) -> DataFrame:
    """Findings of files and folders in any store that Spark reads, whole files as cells; for huge files use chunks."""
    selection = selection or FileSelection()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    data = F.col("content")
    if selection.range_start or selection.range_end:
        length = F.lit(selection.range_end - selection.range_start) if selection.range_end else F.col("length").cast("int")
        data = F.substring(data, F.lit(selection.range_start + 1), length)
    rows = select_files(files, selection).select(F.regexp_replace("path", "^file:", "").alias("source"), data.alias("data"), F.lit(selection.range_start).cast("long").alias("origin"))
    return dedup(scan_bytes(rows, options))


class _Windows(InputPartition):
    def __init__(self, path: str, start: int, end: int, low: int, high: int):
        self.path, self.start, self.end, self.low, self.high = path, start, end, low, high


def plan_windows(size: int, selection: FileSelection, window: int = WINDOW, overlap: int = OVERLAP) -> list[tuple[int, int, bool, bool]]:
    """(start, end, cut at the head, cut at the tail): each window's fresh bytes with an overlap in front; the range's own
    ends count as ends of the data (S3, S4)."""
    low, high = selection.range_start, min(size, selection.range_end or size)
    out = []
    for at in range(low, high, window):
        start, end = max(low, at - overlap), min(high, at + window)
        out.append((start, end, start > low, end < high))
    return out


class ByteChunks(DataSource):
    """Format "bytechunks": windows of local or mounted files, with options path, include, exclude, rangeStart, rangeEnd,
    window, overlap, perTask. Sizes are taken when the scan is planned; what a file grows by later isn't read (S5)."""

    @classmethod
    def name(cls) -> str:
        return "bytechunks"

    def schema(self) -> str:
        return CHUNKS + ", status string"

    def reader(self, schema) -> DataSourceReader:
        return _ChunkReader(self.options)


class _ChunkReader(DataSourceReader):
    def __init__(self, options):
        get = lambda k, d: int(options.get(k, options.get(k.lower(), d)))
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.selection = FileSelection(include=options.get("include", "*"), exclude=options.get("exclude", ""), range_start=get("rangeStart", 0), range_end=get("rangeEnd", 0))
        self.window, self.overlap, self.per_task = get("window", WINDOW), get("overlap", OVERLAP), get("perTask", 32)

    def _files(self):
        accept = [re.compile("(?is)^(?:.*/)?" + glob_regex(p)[1:-1] + "$") for p in pattern_list(self.selection.include)]
        reject = [re.compile("(?is)^(?:.*/)?" + glob_regex(p)[1:-1] + "$") for p in pattern_list(self.selection.exclude)]
        for path in self.paths:
            for top in sorted(_glob.glob(path)) or [path]:
                if not os.path.isdir(top):
                    yield top
                for folder, names, files in os.walk(top):
                    names[:] = sorted(n for n in names if not any(r.match(f"{folder}/{n}") for r in reject))
                    yield from (f"{folder}/{f}" for f in sorted(files) if any(a.match(f"{folder}/{f}") for a in accept) and not any(r.match(f"{folder}/{f}") for r in reject))

    def partitions(self):
        parts = []
        for path in self._files():
            try:
                size = os.path.getsize(path)
            except OSError:
                size = -1
            count = len(plan_windows(max(size, 0), self.selection, self.window, self.overlap))
            for lo in range(0, max(count, 1 if size < 0 else 0), self.per_task):
                parts.append(_Windows(path, lo, min(lo + self.per_task, count), size, 0))
        return parts or [_Windows("", 0, 0, 0, 0)]

    def read(self, part):
        if not part.path:
            return
        try:
            with open(part.path, "rb") as f:
                for start, end, head, tail in plan_windows(part.low, self.selection, self.window, self.overlap)[part.start : part.end]:
                    f.seek(start)
                    yield part.path, f.read(end - start), start, head, tail, True, "read"
            if part.low < 0:
                yield part.path, None, 0, False, False, True, "unreadable"
        except OSError:  # a file that can't be read is counted, not fatal (S6)
            yield part.path, None, 0, False, False, True, "unreadable"


def scan_chunks(spark: SparkSession, path: str, options: Options | None = None, **settings) -> DataFrame:
    """Findings of files of any size, window by window; equal to scan_paths whatever the window."""
    spark.dataSource.register(ByteChunks)
    chunks = spark.read.format("bytechunks").options(**{k: str(v) for k, v in settings.items()}).load(path)
    return dedup(scan_bytes(chunks, options))


def unreadable(chunks: DataFrame) -> DataFrame:
    """The sources that could not be read."""
    return chunks.filter("status = 'unreadable'").select("source").distinct()


def observed(chunks: DataFrame) -> tuple[DataFrame, Observation]:
    """The chunks, and counts that are known once an action has read them: bytes, windows, unreadable sources."""
    seen = Observation("scan")
    counts = [F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("bytes"), F.count_if(F.col("status") == "read").alias("windows"), F.count_if(F.col("status") == "unreadable").alias("unreadable")]
    return chunks.observe(seen, *counts), seen
