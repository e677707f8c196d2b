"""The analytics on findings: dedup, fold, dashboard, comparison, ignore rules, search, download hosts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower
from .scan import ENCODINGS


def dedup(findings: DataFrame) -> DataFrame:
    """One finding for each (group, value, source, offset), whatever decoder found it (K1, A1, A2, G-5, G-15)."""
    rank = F.coalesce(*[F.when(F.col("encoding") == e, F.lit(i)) for i, e in enumerate(ENCODINGS)], F.lit(9))
    rest = [c for c in findings.columns if c not in ("group", "value", "source", "offset")]
    first = F.min_by(F.struct(*rest), F.struct(rank, "context_before", "context_after"))
    return findings.groupBy("group", "value", "source", "offset").agg(first.alias("f")).select(*[F.col(f"f.{c}").alias(c) if c in rest else F.col(c) for c in findings.columns])


def ordered(findings: DataFrame) -> DataFrame:
    """Z to A by group, then value, with source and offset as ties (A2, G-6, G-7)."""
    return findings.orderBy(F.desc("group"), F.desc("value"), "source", "offset")


def group_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("group").agg(F.count("*").alias("findings"))


def fold(findings: DataFrame) -> DataFrame:
    """One row for each value of a group: the first by (source, offset), occurrences summed (A5, G-20)."""
    rest = [c for c in findings.columns if c not in ("group", "value", "occurrences")]
    first = F.min_by(F.struct(*rest), F.struct("source", F.coalesce("offset", F.lit(0)), "encoding"))
    out = findings.groupBy("group", "value").agg(first.alias("f"), F.sum("occurrences").alias("occurrences"))
    return out.select(*[F.col(f"f.{c}").alias(c) if c in rest else F.col(c) for c in findings.columns])


def dashboard(findings: DataFrame) -> DataFrame:
    """Counts in all and by group, source and encoding, in one pass (A6); order by kind, count down, name.

    An empty scan gives no rows."""
    kind = F.expr("CASE grouping_id(`group`, source, encoding) WHEN 3 THEN 'group' WHEN 5 THEN 'source' WHEN 6 THEN 'encoding' ELSE 'total' END")
    sets = findings.groupingSets([["group"], ["source"], ["encoding"], []], "group", "source", "encoding")
    return sets.agg(kind.alias("kind"), F.count("*").alias("findings")).select("kind", F.coalesce("group", "source", "encoding", F.lit("")).alias("name"), "findings")


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of two scans with status added, removed or unchanged, by (group, value)."""
    key = ["group", "value"]
    old, new = left.select(*key).distinct(), right.select(*key).distinct()
    known = right.join(old.withColumn("known", F.lit(True)), key, "left")
    fresh = known.withColumn("status", F.when(F.col("known"), "unchanged").otherwise("added")).drop("known")
    return fresh.unionByName(left.join(new, key, "left_anti").withColumn("status", F.lit("removed")))


def new_only(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """What the baseline doesn't hold by (group, value)."""
    return findings.join(baseline.select("group", "value").distinct(), ["group", "value"], "left_anti")


def glob_regex(glob: str) -> str:
    """* and ? as an anchored expression; * also crosses slashes."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


@dataclass(frozen=True)
class IgnoreRules:
    """Groups (equal or a dotted suffix), globs on values, exact values; all in lower case."""

    groups: tuple[str, ...] = ()
    globs: tuple[str, ...] = ()
    exact: tuple[str, ...] = ()

    @staticmethod
    def parse(lines: str) -> IgnoreRules:
        groups, globs, exact = [], [], []
        for line in lines.splitlines():
            rule = re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\r"))
            if not rule or rule[0] == "#":
                continue
            if rule[0] == "=":
                exact.append(rule[1:])
            elif "*" in rule or "?" in rule:
                globs.append(rule)
            else:
                groups.append(rule)
        return IgnoreRules(tuple(groups), tuple(globs), tuple(exact))

    def hides(self, group: Column, value: Column) -> Column:
        """Whether a finding is hidden (A12, A13, G-22)."""
        g, v, out = ascii_lower(group), ascii_lower(value), F.lit(False)
        for rule in self.groups:
            out = out | (g == rule) | g.endswith("." + rule)
        if self.exact:
            out = out | v.isin(*self.exact)
        for rule in self.globs:
            out = out | v.rlike("(?s)" + glob_regex(rule))
        return out


def ignore(findings: DataFrame, rules: IgnoreRules) -> DataFrame:
    return findings.filter(~rules.hides(F.col("group"), F.col("value")))


def hidden_count(findings: DataFrame, rules: IgnoreRules) -> DataFrame:
    return findings.agg(F.count_if(rules.hides(F.col("group"), F.col("value"))).alias("hidden"), F.count("*").alias("findings"))


def search(findings: DataFrame, query: str) -> DataFrame:
    """Rows whose group, value, source or encoding holds the text, whatever its ASCII case."""
    q = re.sub("[A-Z]", lambda m: m[0].lower(), query)
    if not q:
        return findings
    found = F.lit(False)
    for c in ("group", "value", "source", "encoding"):
        found = found | ascii_lower(F.col(c)).contains(q)
    return findings.filter(found)


def view(findings: DataFrame, baseline: DataFrame | None, rules: IgnoreRules, query: str) -> DataFrame:
    """New only, then ignore rules, then search, then fold."""
    rows = new_only(findings, baseline) if baseline is not None else findings
    return fold(search(ignore(rows, rules), query))


def _folders(path: Column) -> Column:
    """Lower-case segments of a path, without query, that a slash follows; empty ones are left out."""
    parts = F.split(ascii_lower(F.regexp_replace(path, r"[?#].*$", "")), "/")
    return F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda s: s != "")


def _prefixes(folders: Column) -> Column:
    """array<struct<depth, prefix>> of the leading folders, at every depth."""
    return F.transform(F.sequence(F.lit(1), F.size(folders)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(folders, F.lit(1), n), "/").alias("prefix")))


def resolve_download_hosts(findings: DataFrame, label: str = "Download URL") -> DataFrame:
    """Path-only downloads get the origin of the URL of their source that shares most leading folders.

    Origins vote at the greatest depth; a tie or no common folder leaves the value. Resolved findings get the captures
    path and host from in front. A path whose first segment is a known host of the source only gets that URL's scheme.
    """
    place = F.regexp_replace("source", r" \[[^\]]*\]$", "")
    rows = findings.withColumn("place", place)
    known = rows.filter(F.instr("value", "://") > 1).select(
        "place", F.col("value").alias("url"), F.regexp_extract("value", r"^(.*?://[^/?#]*)", 1).alias("origin"),
        F.regexp_replace(ascii_lower(F.regexp_extract("value", r"://([^/?#]*)", 1)), ":.*$", "").alias("host"), _folders(F.regexp_extract("value", r"://[^/?#]*(.*)$", 1)).alias("kd"),
    ).distinct()
    key = ["group", "value", "source", "offset", "encoding"]
    asked = rows.filter((F.col("group") == label) & ~F.col("value").contains("://") & F.col("value").contains("/")).select(*key, "place").distinct()
    head = ascii_lower(F.regexp_extract("value", "^([^/]*)", 1))
    bare = asked.filter(~F.col("value").startswith("/")).withColumn("host", F.regexp_replace(head, ":.*$", "")).join(known, ["place", "host"])
    bare = bare.groupBy(*key).agg(F.max("url").alias("from")).select(*key, F.concat(F.regexp_extract("from", "^(.*?://)", 1), "value").alias("resolved"), "from", F.col("value").alias("path"))
    paths = _without(asked, bare, key)
    paths = paths.withColumn("path", F.when(F.col("value").startswith("/"), F.col("value")).otherwise(F.concat(F.lit("/"), "value"))).withColumn("cd", _folders(F.col("path")))
    # votes by leading folders: a candidate's longest known ones decide, so each URL and candidate gives a row for each of its folders
    spread = known.filter(F.size("kd") > 0).select("place", "url", "origin", F.explode(_prefixes(F.col("kd"))).alias("at"))
    votes = spread.groupBy("place", "at.prefix", ascii_lower("origin").alias("o")).agg(F.count("*").alias("n"), F.max(F.struct("url", "origin")).alias("best"))
    tops = votes.groupBy("place", "prefix", "n").agg(F.count("*").alias("k"), F.max("best").alias("best")).groupBy("place", "prefix").agg(F.max(F.struct("n", "k", "best")).alias("top"))
    asking = paths.filter(F.size("cd") > 0).select(*key, "place", "path", F.explode(_prefixes(F.col("cd"))).alias("at")).select(*key, "place", "path", "at.depth", "at.prefix")
    won = asking.join(tops, ["place", "prefix"]).groupBy(*key, "path").agg(F.max(F.struct("depth", "top.k", "top.best")).alias("top")).filter("top.k = 1")
    won = won.select(*key, F.concat("top.best.origin", "path").alias("resolved"), F.col("top.best.url").alias("from"), "path")
    hits = won.unionByName(bare)
    joined = rows.alias("r").join(hits.alias("h"), [F.col(f"r.{c}").eqNullSafe(F.col(f"h.{c}")) for c in key], "left")
    more = F.array(F.struct(F.lit("path").alias("name"), F.col("h.path").alias("value")), F.struct(F.lit("host from").alias("name"), F.col("h.from").alias("value")))
    special = {"value": F.coalesce("h.resolved", "r.value"), "captures": F.when(F.col("h.resolved").isNotNull(), F.concat(more, F.col("r.captures"))).otherwise(F.col("r.captures"))}
    return joined.select(*[special.get(c, F.col(f"r.{c}")).alias(c) for c in findings.columns])


def _without(rows: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    return rows.alias("a").join(found.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key], "left_anti")
