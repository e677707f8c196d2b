"""Base64 and hex spans in text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHORTEST = 16


def _readable(binary: Column) -> Column:
    """At least four bytes, of which half or more are printable ASCII, as UTF-8 or, where they are none, as Latin-1; else null."""
    each, text = F.decode(binary, "ISO-8859-1"), binary.cast("string")
    printable = F.length(F.regexp_replace(each, r"[^\x20-\x7e]", ""))
    return F.when((F.length(each) >= 4) & (printable * 2 >= F.length(each)), F.when(F.is_valid_utf8(text), text).otherwise(each))


def base64_texts(text: Column) -> Column:
    """Decoded texts of all spans of 16 or more base64 characters (either alphabet)."""
    spans = F.regexp_extract_all(text, F.lit(f"[A-Za-z0-9+/_-]{{{SHORTEST},}}"), F.lit(0))

    def read(s: Column) -> Column:
        whole = F.left(s, F.length(s) - F.when(F.length(s) % 4 == 1, 1).otherwise(0))
        return _readable(F.unbase64(F.translate(whole, "-_", "+/")))

    return F.filter(F.transform(spans, read), lambda x: x.isNotNull())


def hex_texts(text: Column) -> Column:
    """Decoded texts of all spans of 16 or more hex digits; an odd last digit is left out."""
    spans = F.regexp_extract_all(text, F.lit(f"[0-9A-Fa-f]{{{SHORTEST},}}"), F.lit(0))
    return F.filter(F.transform(spans, lambda s: _readable(F.unhex(F.left(s, (F.length(s) / 2).cast("int") * 2)))), lambda x: x.isNotNull())
