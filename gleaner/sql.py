"""Table functions for SQL: scan_text and scan_bytes, usable with LATERAL (user-defined table functions)."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .operators.kernel import FINDINGS, detector
from .plans.options import Options


def _options(text: str | None) -> Options:
    d = json.loads(text or "{}")
    return Options(**{k: tuple(map(tuple, v)) if k == "extra" else tuple(v) if isinstance(v, list) else v for k, v in d.items()})


class _Scan:
    def eval(self, data, source: str, options: str):
        raw = data.encode() if isinstance(data, str) else bytes(data or b"")
        for f in detector(_options(options)).detect(raw, source or ""):
            yield (*f[:7], [(c["name"], c["value"]) for c in f[7]], f[8])


def register(spark: SparkSession) -> None:
    """scan_text(text, source, options as JSON) and scan_bytes(data, source, options as JSON)."""
    for name in ("scan_text", "scan_bytes"):
        spark.udtf.register(name, udtf(_Scan, returnType=FINDINGS))
