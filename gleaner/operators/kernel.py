"""Findings in bytes: text runs, UTF-16, one layer of escapes, Base64 and hex, in an Arrow function.

Runs are found by byte expressions; each carries its text as UTF-8 and, where text and source bytes don't map one to one,
an array with the source byte of every text byte. Patterns run on the text's bytes, so boundaries are those of ASCII.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import LONGEST_MATCH, matchers, utf8_class
from ..functions.urls import NOISE_HOSTS, NOISE_SUFFIXES, NOISE_TLDS, PATH_RANGES, TRAILING, URL_CHARS, HOST_RE
from ..plans.options import Options

FINDINGS = "`group` string, value string, encoding string, source string, offset long, context_before string, context_after string, captures array<struct<name:string,value:string>>, occurrences long"
CHUNKS = "source string, data binary, origin long, cut_head boolean, cut_tail boolean, known boolean"
NEAR = 32
SHORTEST_SPAN = 16

# Characters of UTF-8 text from U+00A0 on, without surrogates and non-characters.
_TEXT = [(0xA0, 0xD7FF), (0xE000, 0xFEFE), (0xFF00, 0xFFFD)] + [(p << 16, (p << 16) | 0xFFFD) for p in range(1, 17)]
_MB = utf8_class(_TEXT)
_L, _LAT = r"[A-Za-z]", r"[\xC0-\xD6\xD8-\xF6\xF8-\xFF]"
# What may stand at a word's edge.
_E = r"[ \\/_\-.,:;()\[\]\"']"


def _inside(char: str, before: str, after: str) -> str:
    """A character with a letter on one side, and on the other a letter, an edge, a NUL or nothing."""
    return rf"(?:(?<={before}){char}(?={after}|{_E}|\x00|\Z)|(?:(?<={_E}|\x00)|\A){char}(?={after}))"


_WIDE = f"(?:{_inside(_MB, f'{_L}|{_MB}', f'{_L}|{_MB}')}|(?![\\xC2-\\xF4][\\x80-\\xBF]){_inside(_LAT, f'{_L}|{_L}{_LAT}', f'{_L}|{_LAT}{_L}')})"
_RUN8 = regex.compile((rf"(?:[\x20-\x7E]++|{_WIDE})+").encode("latin-1"))
_ONE8 = regex.compile((rf"[\x20-\x7E]++|{_MB}|{_LAT}").encode("latin-1"))
_LATU = "[À-ÖØ-öø-ɏ]"
_U_WORD = rf"(?:(?<={_L}|{_L}{_LATU}){_LATU}(?={_L}|{_LATU}{_L}|{_E}|\x00|\Z)|(?:(?<={_E}|\x00)|\A){_LATU}(?={_L}|{_LATU}{_L}))"
_ESCAPE = re.compile(rb"%([0-9A-Fa-f]{2})|\\/|\\x([0-9A-Fa-f]{2})|\\u([Dd][89ABab][0-9A-Fa-f]{2})\\u([Dd][C-Fc-f][0-9A-Fa-f]{2})|\\u(?![Dd][89A-Fa-f])([0-9A-Fa-f]{4})")
_B64 = re.compile(rb"[A-Za-z0-9+/_-]{%d,}" % SHORTEST_SPAN)
_HEX = re.compile(rb"[0-9A-Fa-f]{%d,}" % SHORTEST_SPAN)
_PATH = utf8_class(PATH_RANGES)
_URL = re.compile(rf"(?i:https?|ftps?|wss?|rtsp|rtmp|mms|udp)://[{URL_CHARS}]*(?:[/?#](?:[{URL_CHARS}/?#]|{_PATH})*)?".encode("latin-1"))
_HOST = re.compile(HOST_RE)


class Run:
    """Text as UTF-8 bytes; at(i): source byte of text byte i."""

    __slots__ = ("text", "base", "stride", "map", "kind", "cut_head", "cut_tail")

    def __init__(self, text, base, stride=1, places=None, kind=None, cut_head=False, cut_tail=False):
        self.text, self.base, self.stride, self.map, self.kind, self.cut_head, self.cut_tail = text, base, stride, places, kind, cut_head, cut_tail

    def at(self, i: int) -> int:
        return self.base + (int(self.map[i]) if self.map is not None else i * self.stride)


@lru_cache(16)
def _utf16_run(least: int) -> tuple:
    near = rf"(?:(?<=[\x20-\x7E]{{{least}}}){_U_WORD}|{_U_WORD}(?=[\x20-\x7E]{{{least}}})|(?<=[\x20-\x7E]{{{least}}}{_LATU}){_U_WORD}|{_U_WORD}(?={_LATU}[\x20-\x7E]{{{least}}}))"
    return regex.compile(rf"(?:[\x20-\x7E]++|{near})+"), re.compile(rb"[\x20-\x7E]{%d}" % least)


def runs8(data: bytes, least: int, cut_head=False, cut_tail=False) -> list[Run]:
    """Printable stretches of at least `least` bytes with the letters inside words beyond ASCII."""
    out, enough = [], _utf16_run(least)[1]
    for m in _RUN8.finditer(data):
        raw = m[0]
        if not enough.search(raw):
            continue
        places = None
        if not raw.isascii():
            parts, where, plain = [], [], True
            for p in _ONE8.finditer(raw):
                piece = p[0]
                if len(piece) == 1 and piece[0] >= 0xC0:
                    piece, plain = piece.decode("latin-1").encode(), False
                    where.append(np.full(len(piece), p.start()))
                else:
                    where.append(np.arange(p.start(), p.end()))
                parts.append(piece)
            if not plain:
                raw, places = b"".join(parts), np.concatenate(where)
        out.append(Run(raw, m.start(), 1, places, None, cut_head and m.start() == 0, cut_tail and m.end() == len(data)))
    return out


def runs16(data: bytes, least: int, little: bool, phase: int, cut_head=False, cut_tail=False) -> list[Run]:
    """UTF-16 runs of one byte order and phase."""
    units = np.frombuffer(data, "<u2" if little else ">u2", (len(data) - phase) // 2, phase)
    text = units.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    out = []
    for m in _utf16_run(least)[0].finditer(text):
        if len(m[0]) < least:
            continue
        value, places = m[0].encode(), None
        if not m[0].isascii():
            places = np.repeat(np.arange(len(m[0])) * 2, [len(c.encode()) for c in m[0]])
        start, end = phase + 2 * m.start(), phase + 2 * m.end()
        out.append(Run(value, start, 2, places, None, cut_head and start == 0, cut_tail and end == len(data)))
    return out


def all_runs16(data: bytes, least: int, cut_head=False, cut_tail=False) -> list[Run]:
    """Both orders and phases; a big-endian run beside an equal little-endian one is the same text."""
    if not re.search(rb"(?:[\x20-\x7E]\x00){2}|(?:\x00[\x20-\x7E]){2}", data):
        return []
    little = [r for p in (0, 1) if p < len(data) for r in runs16(data, least, True, p, cut_head, cut_tail)]
    big = [r for p in (0, 1) if p < len(data) for r in runs16(data, least, False, p, cut_head, cut_tail)]
    seen = {(r.base, r.text) for r in little}
    return little + [r for r in big if (r.base + 1, r.text) not in seen and (r.base - 1, r.text) not in seen]


def unescape(run: Run) -> Run | None:
    """One layer of %XX, backslash-slash, \\xXX and \\uXXXX; kind tells plain (0), backslash (1) and percent (2) bytes."""
    parts, where, kinds, at = [], [], [], 0

    def plain(to: int) -> None:
        parts.append(run.text[at:to])
        where.append(np.arange(at, to))
        kinds.append(np.zeros(to - at, np.uint8))

    for m in _ESCAPE.finditer(run.text):
        plain(m.start())
        percent, code, high, low, unit = m.groups()
        if percent or code:
            made = bytes([int(percent or code, 16)])
        elif high:
            made = chr(0x10000 + ((int(high, 16) - 0xD800) << 10) + int(low, 16) - 0xDC00).encode()
        else:
            made = chr(int(unit, 16)).encode() if unit else b"/"
        parts.append(made)
        where.append(np.full(len(made), m.start()))
        kinds.append(np.full(len(made), 2 if percent else 1, np.uint8))
        at = m.end()
    if not at:
        return None
    plain(len(run.text))
    places = np.concatenate(where)
    places = run.map[places] if run.map is not None else places * run.stride
    return Run(b"".join(parts), run.base, 1, places, np.concatenate(kinds), run.cut_head, run.cut_tail)


def decoded_spans(run: Run, use64: bool, use16: bool) -> Iterator[tuple[str, bytes, bool, bool]]:
    """Decoded Base64 and hex spans that are half printable or more."""
    for name, find, on in (("Base64", _B64, use64), ("Hex", _HEX, use16)):
        for m in find.finditer(run.text) if on else ():
            span = m[0]
            if name == "Hex":
                data = bytes.fromhex(span[: len(span) // 2 * 2].decode())
            else:
                span = span[: len(span) - (len(span) % 4 == 1)]
                data = base64.b64decode(span.translate(bytes.maketrans(b"-_", b"+/")) + b"=" * (-len(span) % 4))
            readable = sum(0x20 <= b <= 0x7E for b in data)
            if len(data) >= 4 and 2 * readable >= len(data):
                yield name, data, run.cut_head and m.start() == 0, run.cut_tail and m.end() == len(run.text)


def shown(data: bytes) -> str:
    """Text for a column; a byte that is no UTF-8 is read as Latin-1 (G-18)."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("utf-8", "surrogateescape").translate({0xDC00 + b: b for b in range(0x80, 0x100)})


def clip(data: bytes) -> bytes:
    """Without the parts of characters at either end."""
    while data and data[0] & 0xC0 == 0x80:
        data = data[1:]
    for back in range(1, min(4, len(data)) + 1):
        b = data[-back]
        if b & 0xC0 != 0x80:
            return data if b < 0xC0 or back >= (4 if b >= 0xF0 else 3 if b >= 0xE0 else 2) else data[:-back]
    return data


def host_of(url: bytes) -> str:
    authority = re.split(rb"[/?#]", url.split(b"://", 1)[1], maxsplit=1)[0]
    return authority.rsplit(b"@", 1)[-1].split(b":", 1)[0].decode("latin-1").lower()


def is_noise(host: str) -> bool:
    return host in NOISE_HOSTS or host.endswith(NOISE_SUFFIXES + NOISE_TLDS) or (host.startswith("www.") and len(host) > 4 and "." not in host[4:])


class Detector:
    """Compiled once for each process; detect() gives a chunk's findings without repeats."""

    def __init__(self, options: Options):
        self.options = options
        self.patterns = [] if options.mode == "urls" else [(m, re.compile(m.python.encode("latin-1")), m.hint.encode()) for m in matchers(options)]

    def matches(self, run: Run) -> Iterator[tuple[str, int, int, list]]:
        """(group, start, end, captures) in a run's text."""
        o, text = self.options, run.text
        edge = lambda a, b: (run.cut_head and a == 0) or (run.cut_tail and b == len(text))
        if o.mode == "urls":
            at = 0
            while True:
                m = _URL.search(text, at)
                if not m:
                    return
                url = m[0].rstrip(TRAILING.encode())
                mark = text.find(b"://", m.start())
                at = mark + 3 if run.kind is not None else m.end()
                if b"://" not in url or not 8 <= len(url) <= o.max_candidate or edge(m.start(), m.end()):
                    continue
                if run.kind is not None and not run.kind[mark : mark + 3].any() and not (run.kind[m.start() : m.start() + len(url)] == 1).any():
                    continue
                host = host_of(url)
                if not 4 <= len(host) <= 253 or not _HOST.match(host) or (o.drop_noise and is_noise(host)):
                    continue
                if not o.schemes or url.split(b"://", 1)[0].decode().lower() in o.schemes:
                    yield host, m.start(), m.start() + len(url), []
        else:
            for m, find, hint in self.patterns:
                if hint and hint not in text:
                    continue
                for hit in find.finditer(text):
                    a, b = hit.span()
                    if not 0 < b - a <= min(LONGEST_MATCH, o.max_candidate) or edge(a, b) or (run.kind is not None and not run.kind[a:b].any()):
                        continue
                    yield m.label, a, b, [{"name": n, "value": shown(hit[i])} for i, n in m.captures if hit[i] is not None]

    def detect(self, data: bytes, source: str, origin: int = 0, known: bool = True, cut_head: bool = False, cut_tail: bool = False) -> list[tuple]:
        o, seen, out = self.options, set(), []

        def take(run: Run, encoding: str, placed: bool) -> None:
            for group, a, b, captures in self.matches(run):
                offset = origin + run.at(a) if placed else None
                key = (group, run.text[a:b], offset)
                if key not in seen:
                    seen.add(key)
                    out.append((group, shown(run.text[a:b]), encoding, source, offset, shown(clip(run.text[max(0, a - NEAR) : a])), shown(clip(run.text[b : b + NEAR])), captures, 1))

        narrow = runs8(data, o.min_run, cut_head, cut_tail) if o.ascii or o.base64 or o.hex or o.escaped else []
        wide = all_runs16(data, o.min_run, cut_head, cut_tail) if o.utf16 else []
        for runs, encoding, on in ((narrow, "ASCII", o.ascii), (wide, "UTF-16", True)):
            for run in runs:
                if on:
                    take(run, encoding, known)
                if o.escaped and (plain := unescape(run)):
                    take(plain, "Escaped", known)
        for run in narrow + wide if o.base64 or o.hex else []:
            for encoding, inner, head, tail in decoded_spans(run, o.base64, o.hex):
                for r in runs8(inner, o.min_run, head, tail) + runs16(inner, o.min_run, True, 0, head, tail):
                    take(r, encoding, False)
        return out


#: Findings of one batch to Spark, about.
ROWS = 2000


@lru_cache(8)
def detector(options: Options) -> Detector:
    return Detector(options)


def scan_bytes(chunks: DataFrame, options: Options | None = None) -> DataFrame:
    """Findings of chunks (source, data; origin, cut_head, cut_tail, known where the frame has them). Repeats within a
    chunk are gone; dedup() does the rest. Null data has no findings; other columns are ignored."""
    options = options or Options()
    have = set(chunks.columns)
    extra = {"origin": F.lit(0).cast("long"), "cut_head": F.lit(False), "cut_tail": F.lit(False), "known": F.lit(True)}
    rows = chunks.select(F.col("source").cast("string").alias("source"), "data", *[(F.col(c) if c in have else v).alias(c) for c, v in extra.items()])
    names = ["group", "value", "encoding", "source", "offset", "context_before", "context_after", "captures", "occurrences"]
    types = [pa.string()] * 4 + [pa.int64()] + [pa.string()] * 2 + [pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), pa.int64()]

    def pack(found):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    def run(batches):
        d, out = detector(options), []
        for batch in batches:
            for i, place in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5)), strict=True)):
                source, origin, head, tail, known = place
                data = batch.column(1)[i].as_py()
                out += d.detect(data, source, origin, known, head, tail) if data else []
                if len(out) >= ROWS:
                    yield pack(out)
                    out = []
        if out:
            yield pack(out)

    return rows.mapInArrow(run, FINDINGS)
