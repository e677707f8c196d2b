"""URL detection of both paths against an independent model, on random strings; encoders at random places."""

import base64
import random
import re

from pyspark.sql import functions as F

from gleaner.functions.urls import NOISE_HOSTS, NOISE_SUFFIXES, NOISE_TLDS
from gleaner.operators.kernel import Detector
from gleaner.operators.scan import scan_column
from gleaner.plans.options import SCHEMES, Options

URL_CHARS = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._~:[]@!$&'()*+,;=%-/?#")


def labels_fit(host):
    if host == "localhost":
        return True
    labels = host.split(".")
    if len(labels) < 2 or not all(re.fullmatch("[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?", x) for x in labels):
        return False
    if all(x.isdigit() for x in labels):
        return len(labels) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in labels)
    return bool(re.fullmatch("[A-Za-z]{2,}", labels[-1]))


def model(text):
    """Walks the text by characters; shares no expression with the library."""
    out, pos = [], 0
    while (mark := text.find("://", pos)) >= 0:
        start = next((q for q in range(max(pos, mark - 5), mark) if text[q:mark].lower() in SCHEMES), -1)
        if start < 0:
            pos = mark + 3
            continue
        end, path = mark + 3, False
        while end < len(text) and (text[end] in URL_CHARS or path and text[end] == "é"):
            path |= text[end] in "/?#"
            end += 1
        url = text[start:end].rstrip(".,;:!?)]}'\"><")
        pos = end
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.split("[/?#]", rest)[0].rsplit("@", 1)[-1].split(":")[0].lower()
        noise = host in NOISE_HOSTS or host.endswith(NOISE_SUFFIXES + NOISE_TLDS) or (host.startswith("www.") and host.count(".") == 1)
        if len(url.encode()) >= 8 and 4 <= len(host) <= 253 and labels_fit(host) and not noise:
            out.append((url, len(text[:start].encode())))
    return out


def strings(n, seed):
    rng = random.Random(seed)
    atoms = ["http", "https", "ftp", "ws", "udp", "x", "7", "://", "://", ":", "/", "//", ".", "a", "b9", "com", "org", "site", "10", "255", "256", "@", "u:p@", ":80", "?q=1", "#f", ")", ".,", "-", " ", "é", "localhost", "www.", "w3", "example", "local", "\n", "[", "%20"]
    some = lambda pool, n: "".join(rng.choice(pool) for _ in range(rng.randint(0, n)))
    hosts = ["a.com", "b9.org", "10.0.0.1", "10.0.0.256", "localhost", "www.w3.org", "www.a", "x.local", "-a.com", "a..com", "u@v.w.com", "a.c", "é.com", "A.Com:80"]
    return [some(atoms, 4) + "".join(rng.choice(["http", "HTTPS", "ftp", "wss", "udp", "xhttp", "7ws", "no"]) + "://" + rng.choice(hosts) + some(atoms, 5) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def test_native_path_equals_the_model(spark):
    texts = strings(4000, 1)
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    options = Options(base64=False, hex=False, utf16=False, escaped=False)
    got = sorted((int(r["source"]), r["value"], r["offset"]) for r in scan_column(df, "t", F.col("i"), options).collect())
    want = sorted((i, u, o) for i, t in enumerate(texts) for u, o in model(t))
    assert len(want) > 150 and got == want


def test_kernel_equals_the_model():
    d = Detector(Options(base64=False, hex=False, utf16=False, escaped=False))
    hits = 0
    for t in strings(6000, 2):
        t = t.replace("é", "e")  # runs end at letters outside words, which the model doesn't know
        found = [(f[1], f[4]) for f in d.detect(t.encode(), "s")]
        assert found == model(t), t
        hits += len(found)
    assert hits > 200


def test_encoded_urls_at_random_places():
    rng, d = random.Random(3), Detector(Options())
    for i in range(120):
        url = f"https://h{i}.site.com/p{rng.randint(0, 10**6)}"
        forms = [(url.encode(), "ASCII"), (url.encode("utf-16-le"), "UTF-16"), (b"k=" + base64.b64encode(url.encode()) + b" ", "Base64"), (b"k=" + url.encode().hex().encode() + b" ", "Hex"), (url.replace("/", "\\/").encode(), "Escaped"), (url.replace(":", "%3a").encode(), "Escaped")]
        data, want = b"", []
        del forms[2 + i % 2]  # the two forms without offset are one finding
        for form, name in rng.sample(forms, 5):
            data += b"\x03" * rng.randint(2, 9)
            want.append((url, name, None if name in ("Base64", "Hex") else len(data)))
            data += form + b"\x03\x03\x03"
        assert sorted(map(str, [(f[1], f[2], f[4]) for f in d.detect(data, "s")])) == sorted(set(map(str, want)))
