"""Spans of address space in dumps and executables: planning under a byte cap, labels, PE sections."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST = 2 << 30


def plan_spans(spans: DataFrame, low: int = 0, high: int = 0, most: int = MOST) -> DataFrame:
    """Readable spans (source, base, size, readable, label) clipped to a range, in address order, to exactly `most` bytes a source."""
    end = F.col("base") + F.col("size")
    cut = spans.filter("readable").select("source", "label", F.greatest("base", F.lit(low)).cast("long").alias("base"), (F.least(end, F.lit(high)) if high else end).cast("long").alias("end")).filter("end > base")
    before = Window.partitionBy("source").orderBy("base").rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumn("used", F.coalesce(F.sum(F.col("end") - F.col("base")).over(before), F.lit(0)))
    return summed.filter(F.col("used") < most).select("source", "label", "base", F.least(F.col("end") - F.col("base"), F.lit(most) - F.col("used")).cast("long").alias("size"))


def label_source():
    """The source column of a labelled span: source [label]."""
    return F.when(F.col("label").isNull() | (F.col("label") == ""), F.col("source")).otherwise(F.concat("source", F.lit(" ["), "label", F.lit("]")))


def label_offsets(findings: DataFrame, spans: DataFrame, step: int = 1 << 16) -> DataFrame:
    """Findings with the label of the span that holds their offset in brackets after the source.

    A point-in-interval join on pages of `step` bytes, so that it is an equi join at any number of spans.
    """
    pages = spans.filter("size > 0").select("source", F.col("base").alias("lo"), (F.col("base") + F.col("size")).alias("hi"), "label", F.explode(F.sequence(F.floor(F.col("base") / step), F.floor((F.col("base") + F.col("size") - 1) / step))).alias("page"))
    f = findings.withColumn("page", F.floor(F.col("offset") / step)).alias("f")
    p = pages.alias("p")
    joined = f.join(p, (F.col("f.source") == F.col("p.source")) & (F.col("f.page") == F.col("p.page")) & (F.col("offset") >= F.col("lo")) & (F.col("offset") < F.col("hi")), "left")
    named = F.when(F.col("label").isNotNull(), F.concat("f.source", F.lit(" ["), "label", F.lit("]"))).otherwise(F.col("f.source"))
    return joined.select(*[(named if c == "source" else F.col(f"f.{c}")).alias(c) for c in findings.columns])


def read_sections(data: bytes) -> list[tuple[str, int, int]]:
    """(name, first address, end rounded up to the alignment) of a PE image's sections; nothing for other data."""
    if len(data) < 64 or data[:2] != b"MZ":
        return []
    (head,) = struct.unpack_from("<I", data, 60)
    if head + 64 > len(data) or data[head : head + 4] != b"PE\0\0":
        return []
    (count,), (optional,), (align,) = struct.unpack_from("<H", data, head + 6), struct.unpack_from("<H", data, head + 20), struct.unpack_from("<I", data, head + 56)
    if align == 0 or align & (align - 1):
        align = 4096
    table = data[head + 24 + optional : head + 24 + optional + 40 * count]
    out = []
    for raw in (table[i : i + 40] for i in range(0, len(table) - 39, 40)):
        name, size, start, stored = struct.unpack("<8sIII20x", raw)
        label = "".join(chr(b) for b in name.split(b"\0")[0] if 32 <= b <= 126)
        out.append((label, start, -(-(start + (size or stored)) // align) * align))
    return out


def pe_sections(files: DataFrame) -> DataFrame:
    """Spans (source, label, base, size) of the PE files among (source, data)."""

    def run(batches):
        for batch in batches:
            rows = [(s, n, a, e - a) for s, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for n, a, e in read_sections(d or b"")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.string(), pa.int64(), pa.int64()], strict=True)], ["source", "label", "base", "size"])

    return files.select("source", "data").mapInArrow(run, "source string, label string, base long, size long")
