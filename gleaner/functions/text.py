"""Byte offsets, contexts and rendered fields as column expressions (G-8, G-13, W1 to W6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NEAR = 32
BLOCK = 256


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def hit_structs(text: Column, pattern: str) -> Column:
    """array<struct<value, at (characters before), offset (bytes before)>> of all matches, left to right.

    Running sums are taken in blocks of BLOCK hits, then over blocks, so that a text of many hits isn't copied for each.
    """
    found = F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h"), F.split(text, pattern, -1).alias("g")))
    return F.transform(found, lambda f: _placed(F.zip_with(f["h"], F.slice(f["g"], F.lit(1), F.size(f["h"])), lambda h, g: F.struct(h.alias("h"), g.alias("g")))))[0]


def _placed(pairs: Column) -> Column:
    """Hits with their places, from (hit, gap before it)."""
    zero, none = F.lit(0).cast("bigint"), F.expr("cast(array() as array<struct<value:string,at:bigint,offset:bigint>>)")

    def add(acc: Column, length: Column, size: Column, item: Column) -> Column:
        return F.struct((acc["at"] + length).cast("bigint").alias("at"), (acc["offset"] + size).cast("bigint").alias("offset"), F.concat(acc["out"], F.array(item)).alias("out"))

    def hit(acc: Column, p: Column) -> Column:
        item = F.struct(p["h"].alias("value"), (acc["at"] + F.length(p["g"])).cast("bigint").alias("at"), (acc["offset"] + F.octet_length(p["g"])).cast("bigint").alias("offset"))
        return add(acc, F.length(p["g"]) + F.length(p["h"]), F.octet_length(p["g"]) + F.octet_length(p["h"]), item)

    def block(n: Column) -> Column:
        return F.aggregate(F.slice(pairs, n * BLOCK + 1, F.lit(BLOCK)), F.struct(zero.alias("at"), zero.alias("offset"), none.alias("out")), hit)

    def follow(acc: Column, b: Column) -> Column:
        return add(acc, b["at"], b["offset"], F.transform(b["out"], lambda x: F.struct(x["value"].alias("value"), (x["at"] + acc["at"]).alias("at"), (x["offset"] + acc["offset"]).alias("offset"))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), block)
    start = F.struct(zero.alias("at"), zero.alias("offset"), F.expr("cast(array() as array<array<struct<value:string,at:bigint,offset:bigint>>>)").alias("out"))
    return F.when(F.size(pairs) > 0, F.flatten(F.aggregate(blocks, start, follow, lambda acc: acc["out"]))).otherwise(none)


def context_before(text: Column, at: Column) -> Column:
    """At most 32 bytes of whole characters before a match, within its run of text."""
    near = F.regexp_extract(F.substring(text, F.greatest(F.lit(1), at - NEAR + 1).cast("int"), F.least(at, F.lit(NEAR)).cast("int")), r"[^\x00-\x1f\x7f]*$", 0)
    return F.when(F.octet_length(near) <= NEAR, near).otherwise(F.array_max(F.filter(F.transform(F.sequence(F.lit(1), F.lit(NEAR)), lambda n: F.struct(n.alias("n"), F.right(near, n).alias("s"))), lambda x: F.octet_length(x["s"]) <= NEAR))["s"])


def context_after(text: Column, at: Column, value: Column) -> Column:
    near = F.regexp_extract(F.substring(text, (at + F.length(value) + 1).cast("int"), F.lit(NEAR)), r"^[^\x00-\x1f\x7f]*", 0)
    return F.when(F.octet_length(near) <= NEAR, near).otherwise(F.array_max(F.filter(F.transform(F.sequence(F.lit(1), F.lit(NEAR)), lambda n: F.struct(n.alias("n"), F.left(near, n).alias("s"))), lambda x: F.octet_length(x["s"]) <= NEAR))["s"])


def csv_field(c: Column) -> Column:
    """Quoted; a formula's first character gets an apostrophe, NUL is written \\0."""
    guarded = F.concat(F.when(c.rlike(r"^[=+\-@\t]"), F.lit("'")).otherwise(F.lit("")), c)
    return F.concat(F.lit('"'), F.replace(F.replace(guarded, F.lit("\0"), F.lit("\\0")), F.lit('"'), F.lit('""')), F.lit('"'))


def capture_text(captures: Column) -> Column:
    return F.array_join(F.transform(captures, lambda c: F.concat(c["name"], F.lit("="), c["value"])), "; ")


def csv_line(f: str = "") -> Column:
    cols = ["group", "value", "encoding", "source", "offset", "context_before", "context_after"]
    texts = [F.coalesce(F.col(f"`{f}{c}`").cast("string"), F.lit("")) for c in cols] + [capture_text(F.col(f"{f}captures"))]
    return F.concat_ws(",", *[csv_field(t) for t in texts])


CSV_HEADER = "group,value,encoding,source,offset,context_before,context_after,captures"


def txt_line(value: Column, offset: Column) -> Column:
    """The value, and its offset in upper-case hex where there is one."""
    return F.concat(value, F.coalesce(F.concat(F.lit("  @0x"), F.hex(offset)), F.lit("")))


def json_text(c: Column) -> Column:
    """A JSON string: quotes and backslashes escaped, control characters as \\u00xx."""
    plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        plain = F.replace(plain, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), plain, F.lit('"'))


def json_object() -> Column:
    """One finding as a JSON object; offset null where unknown, captures as an object."""
    captures = F.array_join(F.transform("captures", lambda c: F.concat(json_text(c["name"]), F.lit(":"), json_text(c["value"]))), ",")
    pairs = [("group", json_text(F.col("group"))), ("value", json_text(F.col("value"))), ("encoding", json_text(F.col("encoding"))), ("source", json_text(F.col("source"))), ("offset", F.coalesce(F.col("offset").cast("string"), F.lit("null"))), ("contextBefore", json_text(F.col("context_before"))), ("contextAfter", json_text(F.col("context_after"))), ("captures", F.concat(F.lit("{"), captures, F.lit("}")))]
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in pairs]), F.lit("}"))
