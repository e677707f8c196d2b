"""Byte inspector: lines of sixteen bytes as offset, hex and ASCII."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 16


def hex_lines(df: DataFrame, data_col: str, offset: int, length: int, keep: list[str]) -> DataFrame:
    """The lines of data from offset (rounded down to a line) on; what lies beyond the end is left out."""
    start = offset // WIDTH * WIDTH
    at = F.explode(F.sequence(F.lit(start), F.lit(offset + length - 1), F.lit(WIDTH)))
    rows = df.select(*keep, data_col, at.alias("at")).withColumn("part", F.substring(F.col(data_col), F.col("at") + 1, F.lit(WIDTH)))
    text = F.regexp_replace(F.decode("part", "ISO-8859-1"), r"[^\x20-\x7e]", ".")
    hexed = F.rtrim(F.regexp_replace(F.hex("part"), "(..)", "$1 "))
    return rows.filter(F.octet_length("part") > 0).select(*keep, F.lpad(F.hex("at"), 12, "0").alias("offset"), hexed.alias("hex"), text.alias("ascii"))
