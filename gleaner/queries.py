"""Registered queries of the string-extraction engine, each with DuckDB SQL for the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import decoders, patterns, text as tx, urls
from .operators import export, results
from .operators.kernel import scan_bytes
from .operators.scan import scan_column, scan_lines
from .plans.options import FileSelection, Options
from .sources.files import select_files
from .sources.inspect import hex_lines
from .sources.spans import label_offsets, plan_spans
from .streaming.live import first_seen

URLS = Options(mode="urls", base64=False, hex=False, utf16=False, escaped=False)
TICKET = r"\b(?:la|der|the)\b"
NOISE_TEXT = " http://www.w3.org/x http://example.com/y http://www.years http://foo.local/z "


def _regex(*presets: str, **more) -> Options:
    return Options(mode="regex", presets=presets, base64=False, hex=False, utf16=False, escaped=False, **more)


def _pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet")


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _page_source():
    return F.concat(F.lit("page-"), F.col("page_id"))


def _doc_source():
    return F.concat(F.lit("doc-"), F.col("doc_id"))


def _page_urls(spark, d, text=None, options=URLS):
    rows = _pages(spark, d).withColumn("t", text() if text else F.col("url"))
    return scan_column(rows, "t", _page_source(), options)


def _doc_hits(spark, d, options):
    return scan_column(_docs(spark, d), "text", _doc_source(), options)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---- SQL for the same ------------------------------------------------------------------------------------------

_HOST_SQL = "lower(regexp_replace(regexp_replace(regexp_extract(value, '://([^/?#]*)', 1), '^.*@', ''), ':.*$', ''))"


def _noise_sql(h: str = "host") -> str:
    ends = " OR ".join(f"ends_with({h}, {_q(e)})" for e in urls.NOISE_SUFFIXES + urls.NOISE_TLDS)
    return f"({h} IN ({', '.join(map(_q, urls.NOISE_HOSTS))}) OR ({h} LIKE 'www.%' AND length({h}) > 4 AND NOT contains(substr({h}, 5), '.')) OR {ends})"


def _url_sql(table: str, text: str, source: str, noise: bool = False) -> str:
    """CTE body: source, raw text, value, host, scheme of the URLs of a table's text."""
    return f"""SELECT *, lower(split_part(value, '://', 1)) AS scheme FROM (
      SELECT *, {_HOST_SQL} AS host FROM (
        SELECT *, rtrim(raw, {_q(urls.TRAILING)}) AS value FROM (
          SELECT {source} AS source, {text} AS text, unnest(regexp_extract_all({text}, {_q(urls.URL_RE)})) AS raw, * FROM {table})))
      WHERE contains(value, '://') AND strlen(value) BETWEEN 8 AND 8192 AND length(host) BETWEEN 4 AND 253 AND regexp_matches(host, {_q(urls.HOST_RE)}) {'' if noise else 'AND NOT ' + _noise_sql()}"""


def _hits_sql(name: str, text: str = "text", table: str = "documents", source: str = "'doc-' || doc_id", label: str | None = None, pattern: str | None = None) -> str:
    """Hits of one pattern in order, with byte offsets by the text before each."""
    title, regexp, _ = patterns.BUILT_IN.get(name, (label, pattern, ""))
    return f"""SELECT {_q(label or title)} AS "group", value, source, text, n, offset_ AS "offset", chars FROM (
      SELECT source, text, hits[n] AS value, n, list_sum([strlen(x) FOR x IN gaps[1:n]]) + coalesce(list_sum([strlen(x) FOR x IN hits[1:n-1]]), 0) AS offset_,
        list_sum([length(x) FOR x IN gaps[1:n]]) + coalesce(list_sum([length(x) FOR x IN hits[1:n-1]]), 0) AS chars FROM (
        SELECT source, text, hits, gaps, unnest(range(1, len(hits) + 1)) AS n FROM (
          SELECT {source} AS source, {text} AS text, regexp_extract_all({text}, {_q(pattern or regexp)}) AS hits, regexp_split_to_array({text}, {_q(pattern or regexp)}) AS gaps FROM {table})))
      WHERE strlen(value) BETWEEN 1 AND 512"""


def _found_sql(*parts: str) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


_EMAIL, _IPV4 = _hits_sql("email"), _hits_sql("ipv4")
_BOTH = f"SELECT \"group\", value, source, CAST(\"offset\" AS BIGINT) AS \"offset\", 'ASCII' AS encoding FROM ({_found_sql(_EMAIL, _IPV4)})"
_MD5 = "md5(CAST(doc_id AS VARCHAR))"


def _md5():
    return F.md5(F.col("doc_id").cast("string").cast("binary"))


#: Text with values of rare kinds, from the document's number: Spark expression and SQL.
INJECTED = {
    "regex_ipv6": ("ipv6", lambda m: F.concat(F.lit("at "), F.substring(m, 1, 4), F.lit(":"), F.substring(m, 5, 4), F.lit(":"), F.substring(m, 9, 4), F.lit(" end. "), F.col("text")), f"'at ' || substr({_MD5}, 1, 4) || ':' || substr({_MD5}, 5, 4) || ':' || substr({_MD5}, 9, 4) || ' end. ' || text"),
    "regex_guid": ("guid", lambda m: F.concat(F.col("text"), F.lit(" {"), F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), F.substring(m, 13, 4), F.substring(m, 17, 4), F.substring(m, 21, 12)), F.lit("}")), f"text || ' {{' || concat_ws('-', substr({_MD5}, 1, 8), substr({_MD5}, 9, 4), substr({_MD5}, 13, 4), substr({_MD5}, 17, 4), substr({_MD5}, 21, 12)) || '}}'"),
    "regex_apikey": ("apikey", lambda m: F.concat(F.lit("key=AKIA"), F.upper(F.substring(m, 1, 16)), F.lit("; "), F.col("text")), f"'key=AKIA' || upper(substr({_MD5}, 1, 16)) || '; ' || text"),
    "regex_filepath": ("filepath", lambda m: F.concat(F.lit("open C:\\data\\"), F.substring(m, 1, 6), F.lit(".txt\n"), F.col("text")), f"'open C:\\data\\' || substr({_MD5}, 1, 6) || '.txt' || chr(10) || text"),
    "regex_fileurl": ("fileurl", lambda m: F.concat(F.lit("get /dl/"), F.substring(m, 1, 6), F.lit(".zip now "), F.col("text")), f"'get /dl/' || substr({_MD5}, 1, 6) || '.zip now ' || text"),
}


def _plain(df, *more):
    return df.select("group", "value", "source", *more)


def _pair(spark, d):
    return results.dedup(_doc_hits(spark, d, _regex("email", "ipv4")))


def _kernel(spark, d, data, options=None):
    rows = _pages(spark, d).select(_page_source().alias("source"), data.alias("data"))
    return results.dedup(scan_bytes(rows, options or Options())).select("group", "value", "encoding", "source", "offset")


_EXPECTED = "SELECT host AS \"group\", value, {encoding} AS encoding, source, CAST({offset} AS BIGINT) AS \"offset\" FROM ({urls})"
_PAGE_SQL = _url_sql("pages", "url", "'page-' || page_id")


def _expected(encoding: str, offset: str) -> str:
    return _EXPECTED.format(encoding=_q(encoding), offset=offset, urls=_PAGE_SQL)


def _b64(spark, d):
    unbroken = F.translate(F.base64(F.col("url").cast("binary")), "\r\n", "")  # Spark breaks lines after 76 characters, and a span ends with its line
    rows = _pages(spark, d).withColumn("t", F.concat(F.lit("k="), unbroken, F.lit(" ;")))
    out = scan_column(rows, "t", _page_source(), Options(ascii=False, hex=False, utf16=False, escaped=False))
    return results.dedup(out).select("group", "value", "encoding", "source", "offset")


def _hexed(spark, d):
    rows = _pages(spark, d).withColumn("t", F.concat(F.lit("k="), F.lower(F.hex(F.col("url").cast("binary"))), F.lit(" ;")))
    out = scan_column(rows, "t", _page_source(), Options(ascii=False, base64=False, utf16=False, escaped=False))
    return results.dedup(out).select("group", "value", "encoding", "source", "offset")


def _gate(spark, d):
    """Hex spans of 16 and more digits, those whose decoding is readable and those that are not (D2, G-16)."""
    spans = F.regexp_extract_all("text", F.lit("[0-9A-Fa-f]{16,}"), F.lit(0))
    rows = _docs(spark, d).select("doc_id", F.size(spans).alias("spans"), F.size(decoders.hex_texts(F.col("text"))).alias("kept"))
    return rows.filter("spans > 0").select("doc_id", F.col("spans").cast("long"), F.col("kept").cast("long"))


def _runs(spark, d):
    """Printable ASCII runs of four characters and more: their number and length."""
    runs = F.filter(F.split("text", r"[^\x20-\x7e]+"), lambda r: F.length(r) >= 4)
    return _docs(spark, d).select("doc_id", F.size(runs).cast("long").alias("runs"), F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + F.length(r)).alias("chars"))


def _captures(spark, d):
    options = _regex(custom=r"/(?<lang>[a-z]{2})/(?<id>[0-9]+)")
    out = _page_urls(spark, d, options=options)
    return out.select("value", "source", tx.capture_text(F.col("captures")).alias("captures"))


_LEFT = _regex("email", "ipv4")
_RIGHT = _regex("email", custom=TICKET)
_RIGHT_SQL = f"SELECT DISTINCT \"group\", value, source, CAST(\"offset\" AS BIGINT) AS \"offset\" FROM ({_found_sql(_EMAIL, _hits_sql('', label='Custom', pattern=TICKET))})"
_IGNORE = "# noise\nexample.net\n=https://a.example.org/\n*page=2*\n"
_IGNORED_SQL = "(host = 'example.net' OR ends_with(host, '.example.net') OR lower(value) = 'https://a.example.org/' OR regexp_matches(lower(value), '^.*page=2.*$'))"


def _compare(spark, d):
    out = results.compare(results.dedup(_doc_hits(spark, d, _LEFT)), results.dedup(_doc_hits(spark, d, _RIGHT)))
    return out.groupBy("status", "group", "value").agg(F.count("*").alias("n"))


def _downloads(spark, d):
    """Path-only downloads beside full URLs of the same source: language folders that occur, and one that doesn't."""
    pages = _pages(spark, d).select(F.concat(F.lit("lang-"), F.coalesce(F.nullif(F.regexp_extract("url", "://[^/]*/([^/?#]*)/", 1), F.lit("")), F.lit("none"))).alias("source"), "page_id", "url")
    base = [F.lit("ASCII").alias("encoding"), "source", F.col("page_id").alias("offset"), F.lit("").alias("context_before"), F.lit("").alias("context_after"), F.array().cast("array<struct<name:string,value:string>>").alias("captures"), F.lit(1).cast("long").alias("occurrences")]
    full = pages.select(F.regexp_extract("url", "://([^/?#:]*)", 1).alias("group"), F.col("url").alias("value"), *base)
    path = F.concat(F.regexp_extract("url", "://[^/?#]*([^?#]*/)", 1), F.lit("file_"), F.col("page_id"), F.lit(".zip"))
    found = pages.select(F.lit("Download URL").alias("group"), path.alias("value"), *base).filter(F.col("value").startswith("/"))
    return results.resolve_download_hosts(full.unionByName(found)).filter(F.col("group") == "Download URL").select("value", "source", "offset", tx.capture_text(F.col("captures")).alias("captures"))


_DOWNLOADS_SQL = r"""
WITH p AS (SELECT 'lang-' || coalesce(nullif(regexp_extract(url, '://[^/]*/([^/?#]*)/', 1), ''), 'none') AS source, page_id, url FROM pages),
known AS (SELECT DISTINCT source, url, regexp_extract(url, '^(.*?://[^/?#]*)', 1) AS origin,
  string_split(lower(regexp_replace(regexp_extract(url, '://[^/?#]*(.*)$', 1), '[?#].*$', '')), '/') AS kd0 FROM p),
k AS (SELECT source, url, origin, list_filter(kd0[1:len(kd0) - 1], lambda s: s <> '') AS kd FROM known),
asked AS (SELECT source, page_id, regexp_extract(url, '://[^/?#]*([^?#]*/)', 1) || 'file_' || page_id || '.zip' AS path FROM p),
c AS (SELECT source, page_id, path, list_filter(cd0[1:len(cd0) - 1], lambda s: s <> '') AS cd FROM (
  SELECT *, string_split(lower(path), '/') AS cd0 FROM asked WHERE path LIKE '/%')),
pairs AS (SELECT c.source, page_id, path, url, origin,
  (SELECT coalesce(max(i), 0) FROM range(1, least(len(cd), len(kd)) + 1) t(i) WHERE cd[1:i] = kd[1:i]) AS depth FROM c JOIN k USING (source)),
votes AS (SELECT source, page_id, path, depth, lower(origin) AS o, count(*) AS n, max(url) AS url, arg_max(origin, url) AS origin FROM pairs WHERE depth >= 1 GROUP BY ALL),
top AS (SELECT * FROM votes v WHERE depth = (SELECT max(depth) FROM votes w WHERE w.source = v.source AND w.page_id = v.page_id AND w.path = v.path)),
best AS (SELECT * FROM top t WHERE n = (SELECT max(n) FROM top w WHERE w.source = t.source AND w.page_id = t.page_id AND w.path = t.path)),
won AS (SELECT source, page_id, path, max(origin) AS origin, max(url) AS url FROM best GROUP BY ALL HAVING count(*) = 1)
SELECT coalesce(w.origin || c.path, c.path) AS value, c.source, c.page_id AS "offset", CASE WHEN w.url IS NULL THEN '' ELSE 'path=' || c.path || '; host from=' || w.url END AS captures
FROM c LEFT JOIN won w USING (source, page_id, path)"""


def _files(spark, d):
    """A table of paths made from documents, with the predicates of a file selection."""
    rows = _docs(spark, d).select(
        F.concat(F.lit("/data/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/Doc_"), F.col("doc_id"), F.when(F.col("n_chars") % 2 == 0, F.lit(".TXT")).otherwise(F.lit(".bin"))).alias("path"),
        F.octet_length("text").cast("long").alias("length"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("modificationTime"),
    )
    chosen = FileSelection(include="*.txt, doc_1*.bin, src*", exclude="de; */src1/*; doc_7?.*", min_size=500, max_size=20_000, modified_after=1_700_000_010)
    return select_files(rows, chosen).select("path", "length")


_FILES_SQL = """SELECT path, length FROM (
  SELECT '/data/' || source || '/' || lang || '/Doc_' || doc_id || CASE WHEN n_chars % 2 = 0 THEN '.TXT' ELSE '.bin' END AS path, CAST(strlen(text) AS BIGINT) AS length, lang, source, doc_id, n_chars FROM documents)
  WHERE (n_chars % 2 = 0 OR CAST(doc_id AS VARCHAR) LIKE '1%') AND lang <> 'de' AND source <> 'src1' AND NOT regexp_full_match(CAST(doc_id AS VARCHAR), '7[0-9]') AND length BETWEEN 500 AND 20000 AND 1700000000 + doc_id >= 1700000010"""


def _inspect(spark, d):
    rows = _docs(spark, d).select("doc_id", F.col("text").cast("binary").alias("data"))
    return hex_lines(rows, "data", 256, 64, ["doc_id"])


_INSPECT_SQL = r"""
SELECT doc_id, printf('%012X', pos) AS "offset", rtrim(regexp_replace(h, '(..)', '\1 ', 'g')) AS hex, list_aggregate([CASE WHEN x BETWEEN 32 AND 126 THEN chr(x) ELSE '.' END FOR x IN codes], 'string_agg', '') AS ascii FROM (
  SELECT doc_id, pos, h, [('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2))::INTEGER FOR i IN range(len(h) // 2)] AS codes FROM (
    SELECT doc_id, pos, substr(whole, 2 * pos + 1, 32) AS h FROM (SELECT doc_id, hex(encode(text)) AS whole, unnest([256, 272, 288, 304]) AS pos FROM documents)))
  WHERE h <> ''"""


def _span_rows(spark, d):
    """Spans of one dump for each source, from documents: a page each, some unreadable, with the language as label."""
    return _docs(spark, d).select("source", (F.col("doc_id") * 4096).alias("base"), (F.col("n_chars") % 4096 + 1).alias("size"), (F.col("n_chars") % 5 != 0).alias("readable"), F.col("lang").alias("label"))


def _points(spark, d):
    """Findings at addresses of a dump, from conversations."""
    return spark.read.parquet(f"{d}/conversations.parquet").select(
        F.col("role").alias("group"), F.concat("conv_id", F.lit("/"), "turn").alias("value"), F.lit("ASCII").alias("encoding"), F.concat(F.lit("src"), F.col("turn") % 3).alias("source"), (F.col("conv_id") * 4099 + F.col("turn") * 13).alias("offset")
    )


_SPANS_SQL = "SELECT source, doc_id * 4096 AS base, n_chars % 4096 + 1 AS size, n_chars % 5 <> 0 AS readable, lang AS label FROM documents"


def catalogue() -> dict[str, tuple]:
    """name: (query, SQL)."""
    url_cols = lambda df: df.select(F.regexp_extract("source", "([0-9]+)$", 1).cast("long").alias("page_id"), "value", F.col("group").alias("host"), urls.url_scheme(F.col("value")).alias("scheme"))
    url_out = "SELECT page_id, value, host, scheme FROM ({})"
    twice = lambda: F.concat(F.lit("see "), F.col("url"), F.lit("), then <"), F.col("url"), F.lit(">."))
    twice_sql = "'see ' || url || '), then <' || url || '>.'"
    noisy, noisy_sql = lambda: F.concat(F.col("url"), F.lit(NOISE_TEXT)), f"url || {_q(NOISE_TEXT)}"
    login = lambda: F.regexp_replace("url", "://([^/]*)", "://user:pw@$1:8443")
    login_sql = r"regexp_replace(url, '://([^/]*)', '://user:pw@\1:8443')"
    noise_off = Options(mode="urls", base64=False, hex=False, utf16=False, escaped=False, drop_noise=False)
    out: dict[str, tuple] = {
        "url_scan": (lambda s, d: url_cols(_page_urls(s, d)), url_out.format(_PAGE_SQL)),
        "url_scan_embedded": (lambda s, d: url_cols(_page_urls(s, d, twice)), url_out.format(_url_sql("pages", twice_sql, "'page-' || page_id"))),
        "url_scheme_filter": (lambda s, d: url_cols(_page_urls(s, d, options=Options(schemes=("https",), base64=False, hex=False, utf16=False, escaped=False))), url_out.format(_PAGE_SQL) + " WHERE scheme = 'https'"),
        "url_crap_filter": (lambda s, d: url_cols(_page_urls(s, d, noisy)), url_out.format(_url_sql("pages", noisy_sql, "'page-' || page_id"))),
        "url_crap_kept": (lambda s, d: url_cols(_page_urls(s, d, noisy, noise_off)), url_out.format(_url_sql("pages", noisy_sql, "'page-' || page_id", noise=True))),
        "url_host_groups": (lambda s, d: results.group_counts(results.dedup(_page_urls(s, d))), f'SELECT host AS "group", count(*) AS findings FROM (SELECT DISTINCT host, value, source FROM ({_PAGE_SQL})) GROUP BY 1'),
        "url_userinfo_port_host": (lambda s, d: url_cols(_page_urls(s, d, login)), url_out.format(_url_sql("pages", login_sql, "'page-' || page_id"))),
        "url_ipv4_hosts": (
            lambda s, d: scan_column(_doc_hits(s, d, _regex("ipv4")).select(F.concat(F.lit("http://"), F.col("value"), F.lit("/a ftp://"), F.regexp_replace("value", r"^[0-9]+", "300"), F.lit("/b")).alias("t"), "source"), "t", F.col("source"), URLS).select(F.col("group").alias("host"), "value", "source"),
            "SELECT host, value, source FROM (" + _url_sql(f"(SELECT 'http://' || value || '/a ftp://' || regexp_replace(value, '^[0-9]+', '300') || '/b' AS t, source AS place FROM ({_IPV4}))", "t", "place") + ")",
        ),
        "regex_email": (lambda s, d: _plain(_doc_hits(s, d, _regex("email"))), f'SELECT "group", value, source FROM ({_EMAIL})'),
        "regex_ipv4": (lambda s, d: _plain(_doc_hits(s, d, _regex("ipv4"))), f'SELECT "group", value, source FROM ({_IPV4})'),
        "regex_custom_icase": (lambda s, d: _plain(_doc_hits(s, d, _regex(custom="[a-z]+tion[.,]", ignore_case=True))), 'SELECT "group", value, source FROM (' + _hits_sql("", label="Custom", pattern="(?i)[a-z]+tion[.,]") + ")"),
        "regex_whole_word": (lambda s, d: _plain(_doc_hits(s, d, _regex(custom="la|der|the", whole_word=True))).groupBy("group", "value", "source").agg(F.count("*").alias("n")), 'SELECT "group", value, source, count(*) AS n FROM (' + _hits_sql("", label="Custom", pattern=TICKET) + ") GROUP BY ALL"),
        "regex_named_captures": (_captures, "SELECT value, 'page-' || page_id AS source, 'lang=' || regexp_extract(value, '/([a-z]{2})/([0-9]+)', 1) || '; id=' || regexp_extract(value, '/([a-z]{2})/([0-9]+)', 2) AS captures FROM (SELECT page_id, unnest(regexp_extract_all(url, '/[a-z]{2}/[0-9]+')) AS value FROM pages)"),
        "regex_profile": (lambda s, d: _plain(_doc_hits(s, d, _regex("email", "ipv4", custom=r"[A-Z]{4,}!!", extra=(("Digest", "[0-9a-f]{40}"),)))), f'SELECT "group", value, source FROM ({_found_sql(_EMAIL, _IPV4, _hits_sql("", label="Custom", pattern="[A-Z]{4,}!!"), _hits_sql("", label="Digest", pattern="[0-9a-f]{40}"))})'),
        "regex_oversize": (lambda s, d: _doc_hits(s, d, _regex(custom="[^\n]+")).groupBy("source").agg(F.count("*").alias("n"), F.max(F.octet_length("value")).cast("long").alias("longest")), 'SELECT source, count(*) AS n, max(strlen(value)) AS longest FROM (' + _hits_sql("", label="Custom", pattern="[^\n]+") + ") GROUP BY 1"),
        "regex_hint_prefilter": (lambda s, d: _plain(_doc_hits(s, d, _regex("email", "ipv6", "guid", "filepath"))), f'SELECT "group", value, source FROM ({_found_sql(_EMAIL, _hits_sql("ipv6"), _hits_sql("guid"), _hits_sql("filepath"))})'),
        "finding_offsets": (lambda s, d: _plain(_doc_hits(s, d, _regex("email", "ipv4")), "offset"), _BOTH.replace(", 'ASCII' AS encoding", "")),
        "finding_context": (
            lambda s, d: _page_urls(s, d, twice).select("value", "source", "offset", "context_before", "context_after"),
            f"""SELECT value, 'page-' || page_id AS source, CAST(CASE WHEN n = 1 THEN 4 ELSE 4 + strlen(url) + 9 END AS BIGINT) AS "offset",
              right(CASE WHEN n = 1 THEN 'see ' ELSE 'see ' || url || '), then <' END, 32) AS context_before, left(CASE WHEN n = 1 THEN substr(url, length(value) + 1) || '), then <' || url || '>.' ELSE substr(url, length(value) + 1) || '>.' END, 32) AS context_after
              FROM (SELECT page_id, url, unnest([1, 2]) AS n, value FROM ({_PAGE_SQL}))""",
        ),
        "decode_base64_urls": (_b64, _expected("Base64", "NULL")),
        "decode_hex_urls": (_hexed, _expected("Hex", "NULL")),
        "decode_printable_gate": (_gate, r"""SELECT doc_id, CAST(len(spans) AS BIGINT) AS spans, CAST(len(list_filter(spans, lambda s: 2 * len(list_filter(range(len(s) // 2), lambda i: ('0x' || substr(s, 2 * i + 1, 2))::INTEGER BETWEEN 32 AND 126)) >= len(s) // 2)) AS BIGINT) AS kept
            FROM (SELECT doc_id, regexp_extract_all(text, '[0-9A-Fa-f]{16,}') AS spans FROM documents) WHERE len(spans) > 0"""),
        "decode_percent_urls": (lambda s, d: _kernel(s, d, F.encode(F.concat(F.lit("q="), F.replace("url", F.lit("://"), F.lit("%3A%2F%2F"))), "UTF-8")), _expected("Escaped", "2")),
        "decode_json_escaped_urls": (lambda s, d: _kernel(s, d, F.encode(F.concat(F.lit('{"u":"'), F.replace("url", F.lit("/"), F.lit("\\/")), F.lit('"}')), "UTF-8")), _expected("Escaped", "6")),
        "decode_plain_percent20": (lambda s, d: _kernel(s, d, F.encode(F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("/a%20b")), "UTF-8")), "SELECT host AS \"group\", regexp_replace(url, '[?#].*$', '') || '/a%20b' AS value, 'ASCII' AS encoding, source, CAST(0 AS BIGINT) AS \"offset\" FROM (" + _PAGE_SQL + ")"),
        "utf16_urls_le_be": (
            lambda s, d: _kernel(s, d, F.encode("url", "UTF-16LE")).unionByName(_kernel(s, d, F.concat(F.lit("\0").cast("binary"), F.encode("url", "UTF-16BE"), F.lit("\0").cast("binary")))),
            _expected("UTF-16", "0") + " UNION ALL " + _expected("UTF-16", "2"),
        ),
        "runs_ascii": (_runs, r"SELECT doc_id, CAST(len(r) AS BIGINT) AS runs, CAST(coalesce(list_sum([length(x) FOR x IN r]), 0) AS BIGINT) AS chars FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[^\x20-\x7e]+'), lambda x: length(x) >= 4) AS r FROM documents)"),
        "dedup_k1": (lambda s, d: results.dedup(_doc_hits(s, d, _regex("email", "ipv4", extra=(("Email address", patterns.BUILT_IN["email"][1]),)))).select("group", "value", "source", "offset"), _BOTH.replace(", 'ASCII' AS encoding", "").replace("SELECT", "SELECT DISTINCT", 1)),
        "fold_duplicates": (
            lambda s, d: results.fold(_pair(s, d)).select("group", "value", "source", "offset", "occurrences"),
            f'SELECT "group", value, (min({{\'s\': source, \'o\': "offset"}})).s AS source, (min({{\'s\': source, \'o\': "offset"}})).o AS "offset", count(*) AS occurrences FROM (SELECT DISTINCT * FROM ({_BOTH})) GROUP BY 1, 2',
        ),
        "dashboard": (
            lambda s, d: results.dashboard(_pair(s, d)),
            f"""WITH f AS (SELECT DISTINCT * FROM ({_BOTH})) SELECT 'total' AS kind, '' AS name, count(*) AS findings FROM f UNION ALL SELECT 'group', "group", count(*) FROM f GROUP BY 2
              UNION ALL SELECT 'source', source, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'encoding', encoding, count(*) FROM f GROUP BY 2""",
        ),
        "session_compare": (
            _compare,
            f"""WITH l AS (SELECT DISTINCT * FROM ({_BOTH})), r AS ({_RIGHT_SQL}), k AS (SELECT DISTINCT "group", value FROM l), m AS (SELECT DISTINCT "group", value FROM r)
              SELECT CASE WHEN k.value IS NULL THEN 'added' ELSE 'unchanged' END AS status, r."group", r.value, count(*) AS n FROM r LEFT JOIN k ON k."group" = r."group" AND k.value = r.value GROUP BY 1, 2, 3
              UNION ALL SELECT 'removed', l."group", l.value, count(*) FROM l ANTI JOIN m ON m."group" = l."group" AND m.value = l.value GROUP BY 2, 3""",
        ),
        "new_only": (lambda s, d: results.new_only(_pair(s, d), _doc_hits(s, d, _regex("email"))).select("group", "value", "source", "offset"), f'SELECT DISTINCT "group", value, source, CAST("offset" AS BIGINT) AS "offset" FROM ({_IPV4})'),
        "ignore_rules": (lambda s, d: results.ignore(_page_urls(s, d), results.IgnoreRules.parse(_IGNORE)).select("group", "value", "source"), f'SELECT host AS "group", value, source FROM ({_PAGE_SQL}) WHERE NOT {_IGNORED_SQL}'),
        "ignore_hidden_count": (lambda s, d: results.hidden_count(_page_urls(s, d), results.IgnoreRules.parse(_IGNORE)), f"SELECT count(*) FILTER ({_IGNORED_SQL}) AS hidden, count(*) AS findings FROM ({_PAGE_SQL})"),
        "result_search": (lambda s, d: results.search(_page_urls(s, d), "/FR/").select("group", "value", "source"), f"SELECT host AS \"group\", value, source FROM ({_PAGE_SQL}) WHERE contains(lower(host), '/fr/') OR contains(lower(value), '/fr/') OR contains(lower(source), '/fr/') OR contains('ascii', '/fr/')"),
        "view_pipeline": (
            lambda s, d: results.view(results.dedup(_page_urls(s, d, twice)), _page_urls(s, d, lambda: F.regexp_replace("url", "^https:", "none:")), results.IgnoreRules.parse(_IGNORE), "example").select("group", "value", "source", "occurrences"),
            f"""SELECT host AS "group", value, min(source) AS source, CAST(2 * count(*) AS BIGINT) AS occurrences FROM ({_PAGE_SQL}) WHERE NOT {_IGNORED_SQL} AND contains(value, 'example')
              AND value NOT IN (SELECT value FROM ({_PAGE_SQL}) WHERE scheme <> 'https') GROUP BY 1, 2""",
        ),
        "resolve_download_hosts": (_downloads, _DOWNLOADS_SQL),
        "export_csv_rows": (
            lambda s, d: _page_urls(s, d, lambda: F.concat(F.lit('=say "'), F.col("url"), F.lit('"'))).select(tx.csv_line().alias("line")),
            f'''SELECT '"' || host || '","' || value || '","ASCII","' || source || '","6","''=say ""","' || left(replace(substr(url, length(value) + 1) || '"', '"', '""'), 64) || '",""' AS line FROM ({_PAGE_SQL})''',
        ),
        "export_txt_rows": (lambda s, d: _doc_hits(s, d, _LEFT).select("source", tx.txt_line(F.col("value"), F.col("offset")).alias("line")), f"SELECT source, value || '  @0x' || printf('%X', \"offset\") AS line FROM ({_BOTH})"),
        "export_json_rows": (
            lambda s, d: _page_urls(s, d, lambda: F.concat(F.lit('=say "'), F.col("url"))).select(tx.json_object().alias("line")),
            f"""SELECT '{{"group":"' || host || '","value":"' || value || '","encoding":"ASCII","source":"' || source || '","offset":6,"contextBefore":"=say \\"","contextAfter":"' || substr(url, length(value) + 1) || '","captures":{{}}}}' AS line FROM ({_PAGE_SQL})""",
        ),
        "sample_lines": (
            lambda s, d: scan_lines(_docs(s, d), "text", _regex("email", "ipv4")).select("group", "value", "source", "offset"),
            "SELECT \"group\", value, source, CAST(\"offset\" AS BIGINT) AS \"offset\" FROM (" + _found_sql(*[_hits_sql(n, "line", "(SELECT unnest(regexp_split_to_array(text, '\\r?\\n')) AS line FROM documents)", "'Sample'") for n in ("email", "ipv4")]) + ")",
        ),
        "export_plain_rows": (
            lambda s, d: export.lines(_pair(s, d), "plain").filter("line <> ''"),
            f"""WITH f AS (SELECT DISTINCT "group", value FROM ({_BOTH})) SELECT value AS line FROM f UNION ALL SELECT "group" || '  (' || count(*) || ')' FROM f GROUP BY "group\"""",
        ),
        "span_plan": (
            lambda s, d: plan_spans(_span_rows(s, d), 4096, 0, 50_000),
            f"""SELECT source, label, base, CAST(least(size, 50000 - used) AS BIGINT) AS size FROM (
              SELECT source, label, base, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY base ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM (
                SELECT source, label, greatest(base, 4096) AS base, base + size - greatest(base, 4096) AS size FROM ({_SPANS_SQL}) WHERE readable AND base + size > greatest(base, 4096)))
              WHERE used < 50000""",
        ),
        "span_labels": (
            lambda s, d: label_offsets(_points(s, d), _span_rows(s, d)),
            f"""WITH p AS (SELECT role AS "group", conv_id || '/' || turn AS value, 'ASCII' AS encoding, 'src' || turn % 3 AS source, conv_id * 4099 + turn * 13 AS "offset" FROM conversations)
              SELECT "group", value, encoding, CASE WHEN label IS NULL THEN p.source ELSE p.source || ' [' || label || ']' END AS source, "offset"
              FROM p LEFT JOIN ({_SPANS_SQL}) s ON s.source = p.source AND "offset" >= base AND "offset" < base + size""",
        ),
        "inspect_bytes": (_inspect, _INSPECT_SQL),
        "file_selection": (_files, _FILES_SQL),
        "live_first_seen": (
            lambda s, d: first_seen(s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("group"), F.col("user_id").cast("string").alias("value"), F.date_format("ts", "yyyy-MM-dd").alias("batch"))),
            "SELECT event_type AS \"group\", CAST(user_id AS VARCHAR) AS value, min(strftime(ts, '%Y-%m-%d')) AS batch, CAST(count(*) AS BIGINT) AS hits FROM events GROUP BY 1, 2",
        ),
    }
    for name, (preset, spark_text, sql_text) in INJECTED.items():
        out[name] = (
            lambda s, d, preset=preset, t=spark_text: _plain(scan_column(_docs(s, d).withColumn("t", t(_md5())), "t", _doc_source(), _regex(preset)), "offset"),
            f'SELECT "group", value, source, CAST("offset" AS BIGINT) AS "offset" FROM (' + _hits_sql(preset, sql_text) + ")",
        )
    return out


def queries():
    return {name: run for name, (run, _) in catalogue().items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in catalogue().items() if sql}
