"""User presets in an INI file, profiles of several presets, and their examples."""

from __future__ import annotations

import os
import re
import shutil
from dataclasses import dataclass, fields, replace

from ..functions.patterns import matchers
from .options import OptionError, Options

SECTION = "Regex User Preset:"
# Keys of a section, with the field that each fills.
TEXT_KEYS = {"Description": "description", "Regex": "regex", "Positive": "positive", "Negative": "negative"}
FLAG_KEYS = {
    "Validated": "validated", "ASCII": "ascii", "UTF-16": "utf16", "HEX": "hex", "BASE64": "base64", "ESCAPED": "escaped", "Custom": "custom", "Email": "email",
    "IPv4": "ipv4", "IPv6": "ipv6", "GUID": "guid", "APIKey": "apikey", "Filepath": "filepath", "Download": "fileurl",
}
BUILT_INS = ("email", "ipv4", "ipv6", "guid", "apikey", "filepath", "fileurl")
DECODERS = ("ascii", "utf16", "hex", "base64", "escaped")
_TRUTH = {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}
_BACK = {"\\n": "\n", "\\r": "\r", "\\\\": "\\"}


@dataclass(frozen=True)
class UserPreset:
    name: str
    description: str = ""
    regex: str = ""
    positive: str = ""
    negative: str = ""
    validated: bool = False
    ascii: bool = True
    utf16: bool = True
    hex: bool = False
    base64: bool = False
    escaped: bool = True
    custom: bool = True
    email: bool = False
    ipv4: bool = False
    ipv6: bool = False
    guid: bool = False
    apikey: bool = False
    filepath: bool = False
    fileurl: bool = False

    def options(self) -> Options:
        """The scan of this preset; OptionError for an empty own pattern or no decoder."""
        if self.custom and not self.regex:
            raise OptionError("the preset's pattern is empty")
        on = {d: getattr(self, d) for d in DECODERS}
        return Options(mode="regex", presets=tuple(b for b in BUILT_INS if getattr(self, b)), custom=self.regex if self.custom else "", custom_label=self.name, **on)


def profile(presets: list[UserPreset]) -> Options:
    """Several presets in one scan: any decoder, all built-ins in their order, the first own pattern and then the others."""
    parts = [p.options() for p in presets]
    if not parts:
        raise OptionError("no preset")
    own = [(p.name, o.custom) for p, o in zip(presets, parts, strict=True) if o.custom]
    named = {b for o in parts for b in o.presets}
    label, first = own[0] if own else ("Custom", "")
    return replace(parts[0], presets=tuple(b for b in BUILT_INS if b in named), custom=first, custom_label=label, extra=tuple(own[1:]), **{d: any(getattr(o, d) for o in parts) for d in DECODERS})


def parse(text: str) -> list[UserPreset]:
    """Sections of a preset file; OptionError names the line that can't be read."""
    out: list[dict] = []
    for number, line in enumerate(text.removeprefix("\ufeff").split("\n"), 1):
        line = line.removesuffix("\r")
        bare = line.strip()
        if not bare or bare[0] in ";#":
            continue
        if bare[0] == "[" and bare[-1] == "]":
            head = bare[1:-1].strip()
            name = head.removeprefix(SECTION).strip()
            wrong = "unknown section" if not head.startswith(SECTION) else "a section without name" if not name else "a name twice" if any(p["name"].lower() == name.lower() for p in out) else "the section before has no Regex" if out and "regex" not in out[-1] else ""
            if wrong:
                raise OptionError(f"line {number}: {wrong}")
            out.append({"name": name})
            continue
        key, eq, value = line.partition("=")
        key = key.strip()
        field = TEXT_KEYS.get(key) or FLAG_KEYS.get(key)
        wrong = "a key before any section" if not out else "no = in the line" if not eq else f"unknown key {key}" if not field else f"{key} twice" if field in out[-1] else ""
        if not wrong and key in FLAG_KEYS and value.strip().lower() not in _TRUTH:
            wrong = f"{key} is neither on nor off"
        if wrong:
            raise OptionError(f"line {number}: {wrong}")
        out[-1][field] = _TRUTH[value.strip().lower()] if key in FLAG_KEYS else re.sub(r"\\[nr\\]", lambda m: _BACK[m[0]], value)
    if out and "regex" not in out[-1]:
        raise OptionError("the last section has no Regex")
    return [UserPreset(**p) for p in out]


def render(presets: list[UserPreset]) -> str:
    parts = []
    for p in presets:
        texts = [f"{k}=" + getattr(p, f).replace("\\", "\\\\").replace("\r", "\\r").replace("\n", "\\n") for k, f in TEXT_KEYS.items()]
        parts.append("\n".join([f"[{SECTION} {p.name}]", *texts, *[f"{k}={int(getattr(p, f))}" for k, f in FLAG_KEYS.items()], ""]))
    return "\n".join(parts)


def load(path: str) -> list[UserPreset]:
    """A preset file, or its backup where the file is damaged or missing."""
    try:
        with open(path, encoding="utf-8") as f:
            return parse(f.read())
    except (OptionError, OSError):
        if not os.path.exists(path + ".bak"):
            raise
        with open(path + ".bak", encoding="utf-8") as f:
            return parse(f.read())


def save(path: str, presets: list[UserPreset]) -> None:
    """Write beside, keep a valid old file as .bak, put in place; a damaged old file never replaces the backup."""
    text = render(presets)
    parse(text)
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        f.write(text)
    try:
        with open(path, encoding="utf-8") as f:
            parse(f.read())
        shutil.copyfile(path, path + ".bak")
    except (OptionError, OSError):
        pass
    os.replace(path + ".tmp", path)


def example_failures(preset: UserPreset) -> list[tuple[str, str]]:
    """Lines of the examples that fail: (positive or negative, line)."""
    found = [re.compile(m.python.encode("latin-1")) for m in matchers(preset.options())]
    out = []
    for kind, want in (("positive", True), ("negative", False)):
        for line in getattr(preset, kind).splitlines():
            if line.strip() and any(f.search(line.encode()) for f in found) != want:
                out.append((kind, line))
    return out


assert {f.name for f in fields(UserPreset)} == {"name", *TEXT_KEYS.values(), *FLAG_KEYS.values()}
