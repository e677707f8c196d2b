"""Built-in patterns and the regular-expression dialect (R-1 to R-10, G-1 to G-4, G-25)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..plans.options import OptionError, Options

# Identifiers, labels, patterns and required characters of the built-in patterns. \x{C0}-\x{27F} are the
# code points of two bytes C3 to C9, 80 to BF.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
BUILT_IN = {
    "email": ("Email address", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "@"),
    "ipv4": ("IPv4 address", rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b", "."),
    "ipv6": ("IPv6 address", r"\b(?:[A-Fa-f0-9]{1,4}:){2,7}[A-Fa-f0-9]{1,4}\b", ":"),
    "guid": ("GUID", r"\b[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\b", "-"),
    "apikey": ("API key", r"\b(?:AKIA[0-9A-Z]{16}|gh[opusr]_[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9\-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,})\b", ""),
    "filepath": ("File path", r"(?:\b[A-Za-z]:\\|\\\\)[^\r\n\"<>|?*\x00]{2,}", "\\"),
    "fileurl": ("Download URL", r"(?:[A-Za-z0-9._~:/?#@!$&'()*+,;=%\-]|[\x{C0}-\x{27F}]){2,}\.(?:exe|msi|zip|7z|rar|gz|tgz|tar|bz2|xz|dmg|pkg|app|iso|deb|rpm|apk|cab|jar|whl|nupkg|vsix|appimage|bin|run)\b", "."),
}
LONGEST_PATTERN = 512
LONGEST_MATCH = 512
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_CLASSES = {"alpha": "A-Za-z", "digit": "0-9", "alnum": "A-Za-z0-9", "upper": "A-Z", "lower": "a-z", "space": r"\x20\t\n\x0b\f\r", "xdigit": "0-9A-Fa-f", "punct": r"!-/:-@\[-`{-~", "print": r"\x20-~", "graph": "!-~", "cntrl": r"\x00-\x1f\x7f", "blank": r"\x20\t"}
#: An ASCII word boundary, in engines whose own boundary knows other letters.
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_INNER = "[A-Za-z0-9_]"
_NO_EDGE = r"(?:(?<=[A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<![A-Za-z0-9_])(?![A-Za-z0-9_]))"


@dataclass(frozen=True)
class Matcher:
    """One pattern: its group label, its Java form, its form for bytes in Python, its named captures by number."""

    label: str
    java: str
    python: str
    captures: tuple[tuple[int, str], ...]
    hint: str


def translate(pattern: str) -> tuple[str, str, tuple[tuple[int, str], ...]]:
    """(Java form, Python bytes form, named captures). Rejects back references, lookbehind, inline flags and unknown syntax."""
    java, python, names, group, i = [], [], [], 0, 0

    def both(text: str) -> None:
        java.append(text)
        python.append(text)

    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                raise OptionError("a backslash at the end")
            e = pattern[i + 1]
            if e in "123456789":
                raise OptionError("back references aren't supported")
            if e in "bB":
                java.append(_edge(pattern, i + 2) if e == "b" else _NO_EDGE)
                python.append("\\" + e)
            elif e == "x" and pattern[i + 2 : i + 3] == "{":
                end = pattern.index("}", i)
                java.append(pattern[i : end + 1])
                python.append(_utf8_class(int(pattern[i + 3 : end], 16), int(pattern[i + 3 : end], 16)))
                i = end + 1
                continue
            elif e in "ux":
                n = 4 if e == "u" else 2
                code = pattern[i + 2 : i + 2 + n]
                if len(code) < n or not re.fullmatch("[0-9A-Fa-f]+", code):
                    raise OptionError("a bad escape")
                java.append(f"\\x{{{code}}}")
                python.append(_utf8_class(int(code, 16), int(code, 16)))
                i += n
            elif e.isalpha() and e not in "dDwWsSnrtfv":
                raise OptionError(f"unknown escape \\{e}")
            else:
                both("\\x0b" if e == "v" else {"d": "[0-9]", "D": "[^0-9]", "w": "[A-Za-z0-9_]", "W": "[^A-Za-z0-9_]"}.get(e, "\\" + e))
            i += 2
        elif c == "[":
            j, parts, wide = i + 1, [], []
            negated = pattern[j : j + 1] == "^"
            j += negated
            first = True
            while j < len(pattern) and (pattern[j] != "]" or first):
                first = False
                if pattern.startswith("[:", j) and (end := pattern.find(":]", j)) > 0:
                    if pattern[j + 2 : end] not in _CLASSES:
                        raise OptionError(f"unknown class {pattern[j + 2 : end]}")
                    parts.append(_CLASSES[pattern[j + 2 : end]])
                    j = end + 2
                elif pattern.startswith("\\x{", j):
                    m = re.match(r"\\x\{([0-9A-F]+)\}-\\x\{([0-9A-F]+)\}", pattern[j:])
                    wide.append((m[0], int(m[1], 16), int(m[2], 16)))
                    j += m.end()
                elif pattern[j] == "\\":
                    parts.append({"\\d": "0-9", "\\w": "A-Za-z0-9_", "\\v": "\\x0b"}.get(pattern[j : j + 2], pattern[j : j + 2]))
                    j += 2
                else:
                    parts.append("\\" + pattern[j] if pattern[j] in "[&~|" else pattern[j])
                    j += 1
            if j >= len(pattern):
                raise OptionError("a class without end")
            body = "".join(parts)
            java.append(f"[{'^' * negated}{body}{''.join(w for w, _, _ in wide)}]")
            alternatives = [f"[{'^' * negated}{body}]"] * bool(body) + [_utf8_class(a, b) for _, a, b in wide]
            python.append(alternatives[0] if len(alternatives) == 1 else f"(?:{'|'.join(alternatives)})")
            i = j + 1
        elif c == "(":
            if pattern.startswith("(?", i):
                if pattern.startswith(("(?:", "(?=", "(?!"), i):
                    both(pattern[i : i + 3])
                    i += 3
                    continue
                m = re.match(r"\(\?<([^>=!]*)>", pattern[i:])
                if not m or not _NAME.fullmatch(m[1]):
                    raise OptionError("unsupported group")
                group += 1
                names.append((group, m[1]))
                both("(")
                i += m.end()
                continue
            group += 1
            both("(")
            i += 1
        elif ord(c) > 127:
            java.append(c)
            python.append(_utf8_class(ord(c), ord(c)))
            i += 1
        else:
            both(c)
            i += 1
    return "".join(java), "".join(python), tuple(names)


_ESCAPE = re.compile(r"\\(?:x\{[^}]*\}|x..|u....|.)", re.S)
_CLASS = re.compile(r"\[\^?\]?(?:\[:\w+:\]|\\.|[^\]\\])*\]", re.S)
_REPEAT = re.compile(r"(?:[*+?]|\{(\d*)[^}]*\})[?+]?")


def _edge(pattern: str, i: int) -> str:
    """A word boundary before position i. Where only word characters can follow, what follows is looked at first, which
    rules out most places of a text at once, and one look back says the rest."""
    chars = None if _REPEAT.match(pattern, i) else _opening(pattern, i, alone=True)[0]
    if not chars or not all(c.isalnum() or c == "_" for c in chars):
        return _EDGE
    return f"(?=[{''.join(sorted(chars))}])(?<!{_INNER})"


def _opening(pattern: str, i: int, alone: bool = False) -> tuple[frozenset[str] | None, int]:
    """The ASCII characters that open any match of the alternatives from i to the end of their group (alone: of the first
    alternative), None where others or nothing can; and the place where they end."""
    found, known, empty = set(), True, True
    while i < len(pattern) and pattern[i] != ")" and not (alone and pattern[i] == "|"):
        if pattern[i] == "|":
            known, empty, i = known and not empty, True, i + 1
            continue
        chars, i = _atom(pattern, i)
        repeat = _REPEAT.match(pattern, i)
        if empty:
            known = known and chars is not None
            found |= chars or set()
            empty = bool(repeat) and (repeat[0][0] in "*?" or repeat[1] is not None and int(repeat[1] or 0) == 0)
        i = repeat.end() if repeat else i
    return (frozenset(found) if known and not empty else None), i


def _atom(pattern: str, i: int) -> tuple[frozenset[str] | None, int]:
    """The ASCII characters that open one group, class, escape or character, None as above; and the place after it."""
    if pattern[i] == "(":
        named = re.compile(r"\(\?<[^>]*>|\(\?:|\((?!\?)").match(pattern, i)
        chars, end = _opening(pattern, named.end() if named else i + 3)
        return (chars if named else None), end + 1
    if pattern[i] in "*+?{":
        return None, i + 1
    whole = (_ESCAPE if pattern[i] == "\\" else _CLASS if pattern[i] == "[" else re.compile(".", re.S)).match(pattern, i)
    if not whole:
        return None, len(pattern)
    one = re.compile(translate(whole[0])[1].encode("latin-1"))
    codes = [c for c in range(256) if one.fullmatch(bytes([c]))]
    return (frozenset(map(chr, codes)) if codes and codes[-1] < 128 else None), whole.end()


def _utf8_class(lo: int, hi: int) -> str:
    """Bytes expression for the UTF-8 forms of a range of code points."""
    if hi < 0x80:
        return f"[\\x{lo:02x}-\\x{hi:02x}]" if hi > lo else f"\\x{lo:02x}"
    out = []
    for top in (0x7F, 0x7FF, 0xFFFF, 0x10FFFF):
        if lo <= top:
            out += _same_length(list(chr(lo).encode("utf-8", "surrogatepass")), list(chr(min(hi, top)).encode("utf-8", "surrogatepass")))
            lo = top + 1
            if lo > hi:
                break
    return f"(?:{'|'.join(out)})"


def _same_length(a: list[int], b: list[int]) -> list[str]:
    """Alternatives for all byte strings between two of one length, the later bytes being 80 to BF."""
    show = lambda x, y: f"[\\x{x:02x}-\\x{y:02x}]" if x != y else f"\\x{x:02x}"
    if len(a) == 1:
        return [show(a[0], b[0])]
    if a[0] == b[0]:
        return [show(a[0], a[0]) + rest for rest in _same_length(a[1:], b[1:])]
    out, lo, hi, n = [], a[0], b[0], len(a) - 1
    if a[1:] != [0x80] * n:
        out += [show(lo, lo) + rest for rest in _same_length(a[1:], [0xBF] * n)]
        lo += 1
    last = b[1:] != [0xBF] * n
    if lo <= hi - last:
        out.append(show(lo, hi - last) + show(0x80, 0xBF) * n)
    if last:
        out += [show(hi, hi) + rest for rest in _same_length([0x80] * n, b[1:])]
    return out


def utf8_class(ranges: list[tuple[int, int]]) -> str:
    return f"(?:{'|'.join(_utf8_class(a, b) for a, b in ranges)})"


def matcher(label: str, pattern: str, hint: str = "", whole_word: bool = False, ignore_case: bool = False) -> Matcher:
    """A checked pattern; OptionError says why it can't be used (R-3, R-5, R-8)."""
    if whole_word:
        pattern = rf"\b(?:{pattern})\b"
    if not pattern or len(pattern.encode()) > LONGEST_PATTERN and not hint:
        raise OptionError("an empty or too long pattern")
    java, python, names = translate(pattern)
    flags = "(?i)" if ignore_case else ""
    try:
        re.compile((flags + python).encode("latin-1"))
    except (re.error, UnicodeEncodeError) as e:
        raise OptionError(f"bad pattern: {e}") from e
    return Matcher(label, flags + java, flags + python, names, hint)


def matchers(options: Options) -> list[Matcher]:
    """The patterns of a scan in order: built-ins, the custom one, further ones (R-1, R-2, R-4)."""
    out = []
    for name in options.presets:
        if name not in BUILT_IN:
            raise OptionError(f"unknown preset {name}")
        label, pattern, hint = BUILT_IN[name]
        out.append(matcher(label, pattern, hint, ignore_case=options.ignore_case))
    if options.custom:
        out.append(matcher(options.custom_label, options.custom, whole_word=options.whole_word, ignore_case=options.ignore_case))
    out += [matcher(label, pattern, whole_word=options.whole_word, ignore_case=options.ignore_case) for label, pattern in options.extra]
    if not out:
        raise OptionError("no pattern")
    return out
