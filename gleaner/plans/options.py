"""What a scan looks for and which files it reads (S4, P1-P6, R-8, A10)."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

#: Schemes that make a URL.
SCHEMES = ("http", "https", "ftp", "ftps", "ws", "wss", "rtsp", "rtmp", "mms", "udp")


class OptionError(ValueError):
    """A scan or a file selection that can't run."""


@dataclass(frozen=True)
class Options:
    """mode: urls or regex. Decoders are on unless switched off."""

    mode: str = "urls"
    ascii: bool = True
    utf16: bool = True
    base64: bool = True
    hex: bool = True
    escaped: bool = True
    min_run: int = 4
    max_candidate: int = 8192
    schemes: tuple[str, ...] = ()
    presets: tuple[str, ...] = ()
    custom: str = ""
    custom_label: str = "Custom"
    extra: tuple[tuple[str, str], ...] = ()
    whole_word: bool = False
    ignore_case: bool = False
    drop_noise: bool = True

    def __post_init__(self):
        if self.mode not in ("urls", "regex"):
            raise OptionError(f"unknown mode {self.mode}")
        if unknown := [s for s in self.schemes if s not in SCHEMES]:
            raise OptionError(f"unknown scheme {unknown[0]}")
        if not (self.ascii or self.utf16 or self.base64 or self.hex or self.escaped):
            raise OptionError("no decoder is on")

    def decoders(self) -> dict[str, bool]:
        return {k: getattr(self, k) for k in ("ascii", "utf16", "base64", "hex", "escaped")}


@dataclass(frozen=True)
class FileSelection:
    """Globs, sizes (0: no bound), times in Unix seconds (0: no bound) and a byte range (end 0: to the end)."""

    include: str = "*"
    exclude: str = ""
    min_size: int = 0
    max_size: int = 0
    modified_after: int = 0
    modified_before: int = 0
    range_start: int = 0
    range_end: int = 0

    def __post_init__(self):
        if self.max_size and self.max_size < self.min_size:
            raise OptionError("the greatest size is below the least")
        if self.range_end and self.range_end <= self.range_start:
            raise OptionError("the range ends before it begins")
        if self.modified_before and self.modified_before < self.modified_after:
            raise OptionError("the last time is before the first")


@dataclass(frozen=True)
class Job:
    """A saved query: sources, options, selection and the seconds between live scans."""

    name: str
    sources: tuple[str, ...]
    options: Options = field(default_factory=Options)
    selection: FileSelection = field(default_factory=FileSelection)
    interval: int = 0

    def payload(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def parse(payload: str) -> Job:
        """The job of a payload; OptionError if it isn't one."""
        try:
            d = json.loads(payload)
            o = d["options"]
            o |= {k: tuple(o[k]) for k in ("schemes", "presets")} | {"extra": tuple(tuple(x) for x in o["extra"])}
            return Job(d["name"], tuple(d["sources"]), Options(**o), FileSelection(**d["selection"]), d["interval"])
        except (ValueError, KeyError, TypeError) as e:
            raise OptionError(f"not a job: {e}") from e


def context_key(options: Options, selection: FileSelection, sources: list[str]) -> str:
    """Fingerprint of a query: results are comparable where it is equal (A10)."""
    return hashlib.sha256(json.dumps([asdict(options), asdict(selection), sorted(sources)], sort_keys=True).encode()).hexdigest()
