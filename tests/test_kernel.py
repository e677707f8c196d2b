"""Bytes to findings: runs, UTF-16, decoders, escapes, cut edges, contexts, patterns."""

import base64
import random

import pytest

from gleaner.operators.kernel import Detector, clip, runs8
from gleaner.plans.options import Options

URL = "https://a.site.com/x"


def found(data, options=None, **k):
    return [(f[1], f[2], f[4]) for f in Detector(options or Options()).detect(data if isinstance(data, bytes) else data.encode(), "s", **k)]


@pytest.mark.parametrize("data, encoding, offset", [
    (b"\0" + URL.encode() + b"\0", "ASCII", 1),
    (URL.encode("utf-16-le"), "UTF-16", 0),
    (b"\x01" + URL.encode("utf-16-le") + b"\x03\x03", "UTF-16", 1),
    (b"\x01" + URL.encode("utf-16-be") + b"\0", "UTF-16", 2),
    (b"k=" + base64.b64encode(URL.encode()) + b" ;", "Base64", None),
    (b"k=" + base64.urlsafe_b64encode(URL.encode()).rstrip(b"="), "Base64", None),
    (b"k=" + URL.encode().hex().upper().encode() + b"g", "Hex", None),
    (URL.replace("/", "\\/").encode(), "Escaped", 0),
    (URL.replace("://", "%3A%2F%2F").encode(), "Escaped", 0),
    (URL.replace("/", "\\u002F").encode(), "Escaped", 0),
    (URL.replace("/", "\\x2F").encode(), "Escaped", 0),
])
def test_each_decoder_finds_once(data, encoding, offset):
    assert found(data) == [(URL, encoding, offset)]


def test_decoders_off():
    data = URL.encode() + b" " + base64.b64encode(b"http://b.site.com/abc")
    assert [f[1] for f in found(data, Options(ascii=False, utf16=False, hex=False, escaped=False))] == ["Base64"]


@pytest.mark.parametrize("host, good", [
    ("nodot", False), ("a.c", False), ("256.1.1.1", False), ("10.0.0.1", True), ("site.com", True), ("-a.com", False), ("a-.com", False), ("localhost", True), ("a..com", False), ("x" * 64 + ".com", False),
])
def test_hosts(host, good):
    assert bool(found(f"http://{host}/p", Options(drop_noise=False))) == good


def test_scheme_prefix_offset_and_trim():
    assert found("x7https://a.com/b). ") == [("https://a.com/b", "ASCII", 2)]


@pytest.mark.parametrize("host", ["www.w3.org", "example.com", "x.local", "www.word", "schemas.microsoft.com", "ns.adobe.com"])
def test_noise(host):
    assert not found(f"http://{host}/abc") and (found(f"http://{host}/abc", Options(drop_noise=False)) or host == "www.word")


def test_cut_edges():
    assert not found(b"x " + URL.encode(), cut_tail=True) and found(b"x " + URL.encode())
    assert not found("a.b@c.de x", Options(mode="regex", presets=("email",)), cut_head=True)


def test_letters_beyond_ascii():
    assert found("J\u00fcrgen http://d.site.com/stra\u00dfe\u201d ok")[0][0] == "http://d.site.com/stra\u00dfe"
    latin = "see http://e.site.com/Gr\u00f6\u00dfe/k x".encode("latin-1")
    assert found(latin) == [("http://e.site.com/Gr\u00f6\u00dfe/k", "ASCII", 4)]
    assert found("http://f.site.com/Gr\u00f6\u00dfe".encode("utf-16-le")) == [("http://f.site.com/Gr\u00f6\u00dfe", "UTF-16", 0)]
    assert not runs8(b"\x00ab\xe9\x00", 4) and [r.text for r in runs8(b"\x00\xe9\x01text\x00", 4)] == [b"text"]


def test_plain_percent20_is_not_escaped():
    assert found("http://a.com/x%20y") == [("http://a.com/x%20y", "ASCII", 0)]


def test_nested_redirect_in_escapes():
    values = {f[0] for f in found("http%3A%2F%2Fa.com%2F%3Fu%3Dhttp%3A%2F%2Fb.com%2Fz")}
    assert "http://b.com/z" in values


def test_patterns_and_captures():
    o = Options(mode="regex", custom=r"ID-(?<site>[A-Z]+)-(?<serial>\d+)")
    (f,) = Detector(o).detect(b"---- ID-AB-42 ----", "s", 100)
    assert f[4] == 105 and f[5:7] == ("---- ", " ----") and [c["name"] for c in f[7]] == ["site", "serial"]
    assert not found("x" * 600, Options(mode="regex", custom="x+")) and len(found("A" * 1200, Options(mode="regex", custom="[A-Z]{20}"))) == 60


def test_context_keeps_characters():
    (f,) = Detector(Options(mode="regex", custom="TKTX")).detect(("\u00e4" * 40 + "TKTX" + "\u00e4" * 40).encode(), "s")
    assert f[5] == "\u00e4" * 16 and f[6] == "\u00e4" * 16 and clip(b"\xa4ab\xc3") == b"ab"


def test_invalid_bytes_are_shown():
    (f,) = Detector(Options(mode="regex", custom="a.b")).detect(b"%61%FC%62", "s")
    assert f[1] == "a\u00fcb" and f[2] == "Escaped"
    assert found(b"http%3A%2F%2Fa.com%2F\\u00e4")[0][0] == "http://a.com/\u00e4"


def test_any_window_gives_the_same():
    from gleaner.plans.options import FileSelection
    from gleaner.sources.files import plan_windows

    rng = random.Random(3)
    data = b"".join(bytes(rng.choices(range(256), k=rng.randint(5, 300))) + f" http://h{i % 7}.site.com/p{i} ".encode() for i in range(60))
    whole = set(found(data))
    for window in (150, 1000, 4096):
        parts = set()
        for start, end, head, tail in plan_windows(len(data), FileSelection(), window, 128):
            parts |= set(found(data[start:end], origin=start, cut_head=head, cut_tail=tail))
        assert {x for x in whole if x[2] is not None} <= parts
