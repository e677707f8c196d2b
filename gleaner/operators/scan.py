"""Findings of a text column, as Catalyst expressions from end to end (S12, U1-U12, R-1 to R-13, D2-D5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decoders, text as tx, urls
from ..functions.patterns import LONGEST_MATCH, Matcher, matchers
from ..plans.options import Options

CAPTURES = "array<struct<name:string,value:string>>"
COLUMNS = ["group", "value", "encoding", "source", "offset", "context_before", "context_after", "captures", "occurrences"]
#: Of hits of one place by several decoders the first in this order stays (G-5).
ENCODINGS = ("ASCII", "Escaped", "UTF-16", "Base64", "Hex")


def _hits(pattern: str, guard: Column | None, captures: tuple[tuple[int, str], ...] = (), number: int = 0) -> Column:
    """array of (hit, captures, number) of one pattern in column text, null where it has none; captures hold what they
    matched in the whole text, where lookaheads see what follows."""
    text = F.col("text")
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(f"c{i}") for i, _ in captures]
    zipped = F.arrays_zip(tx.hit_structs(text, pattern).alias("hit"), *found)

    def row(z: Column) -> Column:
        named = F.array(*[F.struct(F.lit(n).alias("name"), z[f"c{i}"].alias("value")) for i, n in captures])
        return F.struct(z["hit"].alias("hit"), F.filter(named.cast(CAPTURES), lambda c: c["value"] != "").alias("captures"), F.lit(number).alias("number"))

    any_hit = text.rlike(pattern)
    return F.when(any_hit if guard is None else guard & any_hit, F.transform(zipped, row))


def _rows(df: DataFrame, hits: list[Column]) -> DataFrame:
    """A row for each hit of all patterns, in one reading of the texts."""
    each = hits[0] if len(hits) == 1 else F.flatten(F.array_compact(F.array(*hits)))
    return df.select("source", "text", F.explode(each).alias("z")).select("source", "text", "z.*")


def _findings(rows: DataFrame, value: Column, group: Column, captures: Column, placed: bool, encoding: str) -> DataFrame:
    at, offset = F.col("hit.at"), F.col("hit.offset")
    return rows.select(
        group.alias("group"), value.alias("value"), F.lit(encoding).alias("encoding"), "source",
        (offset if placed else F.lit(None)).cast("bigint").alias("offset"),
        tx.context_before(F.col("text"), at).alias("context_before"), tx.context_after(F.col("text"), at, value).alias("context_after"),
        captures.alias("captures"), F.lit(1).cast("bigint").alias("occurrences"),
    )


def url_findings(df: DataFrame, options: Options, encoding: str = "ASCII", placed: bool = True) -> DataFrame:
    """URLs of (source, text)."""
    rows = _rows(df, [_hits(urls.URL_JAVA, F.col("text").contains("://"))])
    rows = rows.withColumn("url", urls.trim_url(F.col("hit.value"))).filter(F.col("url").contains("://"))
    rows = rows.withColumns({"host": urls.url_host(F.col("url")), "scheme": urls.url_scheme(F.col("url"))})
    rows = rows.filter(F.octet_length("url").between(8, options.max_candidate) & urls.plausible_host(F.col("host")))
    if options.drop_noise:
        rows = rows.filter(~urls.noise_host(F.col("host")))
    if options.schemes:
        rows = rows.filter(F.col("scheme").isin(*options.schemes))
    return _findings(rows, F.col("url"), F.col("host"), F.array().cast(CAPTURES), placed, encoding)


def pattern_findings(df: DataFrame, found: list[Matcher], options: Options, encoding: str = "ASCII", placed: bool = True) -> DataFrame:
    """Matches of patterns in (source, text); a required character is looked for first (R-10)."""
    rows = _rows(df, [_hits(m.java, F.col("text").contains(m.hint) if m.hint else None, m.captures, n) for n, m in enumerate(found)])
    value = F.col("hit.value")
    rows = rows.filter(F.octet_length(value).between(1, min(LONGEST_MATCH, options.max_candidate)))
    label = F.element_at(F.array(*[F.lit(m.label) for m in found]), F.col("number") + 1)
    return _findings(rows, value, label, F.col("captures"), placed, encoding)


def scan_column(df: DataFrame, text_col: str, source: Column, options: Options | None = None) -> DataFrame:
    """All findings of a text column, before dedup. Only the branches of decoders that are on are planned.

    Text is taken as it is; runs, UTF-16 and escapes are the kernel's (scan_bytes). Null texts have no findings.
    """
    options = options or Options()
    base = df.select(source.cast("string").alias("source"), F.col(text_col).alias("text"))

    def branch(rows: DataFrame, encoding: str, placed: bool) -> list[DataFrame]:
        if options.mode == "urls":
            return [url_findings(rows, options, encoding, placed)]
        return [pattern_findings(rows, matchers(options), options, encoding, placed)]

    parts = branch(base, "ASCII", True) if options.ascii else []
    if options.base64:
        parts += branch(base.filter(F.col("text").rlike("[A-Za-z0-9+/_-]{16}")).select("source", F.explode(decoders.base64_texts(F.col("text"))).alias("text")), "Base64", False)
    if options.hex:
        parts += branch(base.filter(F.col("text").rlike("[0-9A-Fa-f]{16}")).select("source", F.explode(decoders.hex_texts(F.col("text"))).alias("text")), "Hex", False)
    if not parts:
        return branch(base.filter(F.lit(False)), "ASCII", True)[0]
    return reduce(DataFrame.unionByName, parts)


def scan_lines(df: DataFrame, text_col: str, options: Options) -> DataFrame:
    """Line by line, source Sample (S12): what a pattern's author tries it on."""
    lines = df.select(F.explode(F.split(text_col, "\r?\n")).alias("line"))
    return scan_column(lines, "line", F.lit("Sample"), options)
