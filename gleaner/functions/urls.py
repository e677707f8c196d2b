"""URLs in text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of a URL, other letters that a path may hold, schemes, what is trimmed from the end.
URL_CHARS = r"A-Za-z0-9._~:\[\]@!$&'()*+,;=%\-"
PATH_RANGES = [(0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x1FFF), (0x2070, 0x2FFF), (0x3040, 0xD7FF), (0xE000, 0xFEFE), (0xFF21, 0xFFFD), (0x10000, 0x10FFFF)]
SCHEME = "https?|ftps?|wss?|rtsp|rtmp|mms|udp"
TRAILING = ".,;:!?)]}'\"><"
# Hosts that are noise.
NOISE_HOSTS = ("example.com", "example.org", "example.net", "example.edu", "localhost", "127.0.0.1", "0.0.0.0", "domain.com", "test.com", "www.w3.org", "w3.org", "purl.org", "xml.org", "java.sun.com")
NOISE_SUFFIXES = (".w3.org", ".xmlsoap.org", "schemas.microsoft.com", "schemas.android.com", ".openxmlformats.org", ".docbook.org", "ns.adobe.com", "iptc.org")
NOISE_TLDS = (".local", ".localhost", ".example", ".test", ".invalid", ".lan", ".internal", ".arpa")

_WIDE = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in [(0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x1FFF), (0x2070, 0x2FFF), (0x3040, 0xFEFE), (0xFF21, 0xFFFD), (0x10000, 0x10FFFF)])
URL_RE = rf"(?i:{SCHEME})://[{URL_CHARS}]*(?:[/?#](?:[{URL_CHARS}/?#]|[{_WIDE}])*)?"
#: The same for Java, whose stack grows with each round of a loop over alternatives.
URL_JAVA = rf"(?i:{SCHEME})://[{URL_CHARS}]*(?:[/?#][{URL_CHARS}/?#{_WIDE}]*)?"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
HOST_RE = rf"^(?:localhost|(?:{_OCTET}\.){{3}}{_OCTET}|(?:[A-Za-z0-9](?:[A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?\.)+[A-Za-z]{{2,63}})$"


def trim_url(raw: Column) -> Column:
    """Without the punctuation that ends a sentence or bracket (U4)."""
    return F.rtrim(raw, F.lit(TRAILING))


def url_scheme(url: Column) -> Column:
    return F.lower(F.substring_index(url, "://", 1))


def url_host(url: Column) -> Column:
    """Between :// and / ? #, after the last @, before the first colon, in lower case."""
    authority = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":.*$", ""))


def plausible_host(host: Column) -> Column:
    return F.length(host).between(4, 253) & host.rlike(HOST_RE)


def noise_host(host: Column) -> Column:
    """Placeholders, reserved domains, namespaces, and www. with a single word."""
    out = host.isin(*NOISE_HOSTS) | (host.startswith("www.") & (F.length(host) > 4) & ~F.substring(host, 5, 300).contains("."))
    for end in NOISE_SUFFIXES + NOISE_TLDS:
        out = out | host.endswith(end)
    return out
