"""Rendered results: TXT, plain list, CSV, JSON, Parquet."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .results import fold, ordered


def lines(findings: DataFrame, kind: str) -> DataFrame:
    """(part, group, nth, line) in the order in which a file has them: part 0 is a header, 2 a footer.

    txt: for each group its name and count, an empty line, then each value with its offset; plain: folded values alone.
    """
    if kind in ("txt", "plain"):
        rows = fold(findings) if kind == "plain" else findings
        line = F.col("value") if kind == "plain" else tx.txt_line(F.col("value"), F.col("offset"))
        body = rows.select("group", F.lit(2).alias("step"), "value", "source", "offset", line.alias("line"))
        heads = rows.groupBy("group").agg(F.count("*").alias("n")).withColumn("l", F.array(F.concat("group", F.lit("  ("), "n", F.lit(")")), F.lit("")))
        heads = heads.select("group", F.posexplode("l").alias("step", "line")).select("group", (F.col("step") - 1).alias("step"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("offset"), "line")
        return heads.unionByName(body).orderBy(F.desc("group"), "step", F.desc("value"), "source", "offset").select("line")
    if kind in ("csv", "json"):
        return ordered(findings).select((tx.csv_line() if kind == "csv" else tx.json_object()).alias("line"))
    raise ValueError(f"unknown format {kind}")


def pieces(findings: DataFrame, kind: str) -> Iterator[str]:
    """The export as the pieces of one file, of which the driver holds one partition's at a time."""
    body = (r["line"] for r in lines(findings, kind).toLocalIterator())
    end, between = ("", ",\n") if kind == "json" else ("\r\n", "")
    yield "[\n" if kind == "json" else tx.CSV_HEADER + "\r\n" if kind == "csv" else ""
    for n, line in enumerate(body):
        yield (between if n else "") + line + end
    yield "\n]\n" if kind == "json" else ""


def export_text(findings: DataFrame, kind: str) -> str:
    """The whole export as text, for results that a person reads; use pieces() or write() for large ones."""
    return "".join(pieces(findings, kind))


def write(findings: DataFrame, path: str, kind: str) -> None:
    """A folder of parts, in parallel and in order: text lines, JSON lines, CSV rows with their header, or Parquet."""
    if kind == "parquet":
        findings.write.mode("overwrite").partitionBy("encoding").parquet(path)
    else:
        lines(findings, kind).write.mode("overwrite").text(path, lineSep="\r\n" if kind != "json" else "\n")


def export(findings: DataFrame, kind: str, folded: bool = False) -> DataFrame:
    """What a filtered view exports: TXT folded rows where asked, CSV and JSON every hit."""
    return lines(fold(findings) if folded and kind == "txt" else findings, kind)
