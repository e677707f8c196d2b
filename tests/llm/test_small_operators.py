"""Media, sharding, mixing and licences against direct computation, with the edge cases of every operator."""

import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from gleaner.llm import licenses, media, mixing, sharding

SF = "/root/testdata/sf0.001"


def test_media_formats():
    rng = np.random.default_rng(0)
    for shape in [(5, 7), (1, 1), (4, 3, 3), (33, 24)]:
        image = rng.integers(0, 256, shape).astype(np.uint8)
        for encode in (media.encode_pgm, media.encode_bmp):
            assert (media.decode_media(encode(image)) == image).all()
    assert (media.decode_media(b"P2 # note\n2 1\n255\n7 9\n") == [[7, 9]]).all()
    for bad in (b"", b"P5 1 1 70000 xx", b"GIF89a", b"BM", b"P5 2 2 255\nabc", b"P5 0 2 255\n", b"P2 1 1 9\n10", b"P2 2 1 255\n1 x", b"P1 2 1\n1 2", b"P5 1 1", media.encode_bmp(image)[:60]):
        with pytest.raises(ValueError):
            media.decode_media(bad)


def bmp(w, h, bits, packed, palette, body, masks=b""):
    at = 54 + len(masks) + len(palette)
    return b"BM" + struct.pack("<IHHI", at + len(body), 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, packed, len(body), 0, 0, len(palette) // 4, 0) + masks + palette + body


def test_media_depths():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, (5, 11)).astype(np.uint8)
    plain = "\n".join("".join(map(str, r)) for r in bits)
    white = ((1 - bits) * 255).astype(np.uint8)
    assert (media.decode_media(b"P1\n# note\n11 5\n" + plain.encode() + b"\n") == white).all()
    assert (media.decode_media(b"P4 11 5\n" + np.packbits(bits, axis=1).tobytes()) == white).all()
    deep = rng.integers(0, 65536, (3, 4, 3)).astype(np.uint16)
    got = media.decode_media(b"P6 4 3 65535\n" + deep.astype(">u2").tobytes())
    assert got.dtype == np.uint16 and (got == deep).all()
    assert (media.decode_media(b"P3 4 3 65535\n" + b" ".join(b"%d" % v for v in deep.reshape(-1))) == deep).all()
    assert media.decode_media(b"P2 3 1 15\n0 # x\n7 15").tolist() == [[0, 119, 255]]
    assert media.decode_media(b"P5 2 1 1000\n" + struct.pack(">HH", 1000, 500)).tolist() == [[65535, 32768]]
    assert np.load(io.BytesIO(media.npy_tile(np.full((4, 4), 65535, np.uint16)))).max() == 255
    colours = bytes((1, 2, 3, 0, 40, 50, 60, 0))
    one = np.packbits(np.pad(bits, ((0, 0), (0, 21))), axis=1)
    rgb = np.array([(3, 2, 1), (60, 50, 40)], np.uint8)
    assert (media.decode_media(bmp(11, 5, 1, 0, colours, one[::-1].tobytes())) == rgb[bits]).all()
    assert (media.decode_media(bmp(11, -5, 1, 0, colours, one.tobytes())) == rgb[bits]).all()
    nibbles = np.pad(bits, ((0, 0), (0, 5)))
    four = nibbles[:, ::2] << 4 | nibbles[:, 1::2]
    assert (media.decode_media(bmp(11, -5, 4, 0, colours, four.tobytes())) == rgb[bits]).all()
    with pytest.raises(ValueError):
        media.decode_media(bmp(11, -5, 4, 0, colours, (four | 8).tobytes()))
    assert media.decode_media(bmp(2, 1, 16, 0, b"", struct.pack("<HH", 0x7C00, 0x03FF))).tolist() == [[[255, 0, 0], [0, 255, 255]]]
    masks = struct.pack("<III", 0xF800, 0x07E0, 0x001F)
    assert media.decode_media(bmp(2, 1, 16, 3, b"", struct.pack("<HH", 0xF800, 0x07E0), masks)).tolist() == [[[255, 0, 0], [0, 255, 0]]]
    core = b"BM" + struct.pack("<IHHI", 0, 0, 0, 32) + struct.pack("<IHHHH", 12, 3, 1, 1, 1) + bytes((0, 0, 0, 9, 9, 9)) + b"\xa0\0\0\0"
    assert media.decode_media(core).tolist() == [[9, 0, 9]]


def test_media_runs():
    grey = b"".join(bytes((i, i, i, 0)) for i in range(256))
    body = bytes((3, 7, 0, 3, 1, 2, 3, 0, 0, 0, 0, 2, 2, 0, 4, 9, 0, 1))  # run, literal of three and a pad, end of row, delta, run, end
    assert media.decode_media(bmp(6, -2, 8, 1, grey, body)).tolist() == [[7, 7, 7, 1, 2, 3], [0, 0, 9, 9, 9, 9]]
    assert media.decode_media(bmp(5, 1, 4, 2, grey[:64], bytes((3, 0x12, 0, 2, 0, 0, 0, 1)))).tolist() == [[1, 2, 1, 0, 0]]
    assert media.decode_media(bmp(5, 1, 4, 2, grey[:64], bytes((0, 5, 0x12, 0x34, 0x50, 0, 0, 1)))).tolist() == [[1, 2, 3, 4, 5]]
    for bad in (bytes((9, 1, 0, 1)), bytes((3, 7)), bytes((0, 200, 1)), bytes((0, 0, 0, 0, 0, 0, 1, 1))):
        with pytest.raises(ValueError):
            media.decode_media(bmp(6, 2, 8, 1, grey, bad))
    with pytest.raises(ValueError):
        media.decode_media(bmp(60000, 60000, 8, 1, grey, bytes((0, 1))))


def test_media_column(spark):
    image = np.arange(35, dtype=np.uint8).reshape(5, 7)
    rows = [(1, media.encode_pgm(image)), (2, media.encode_bmp(image)), (3, None), (4, b""), (5, b"P5 9 9 255\nshort"), (None, media.encode_pgm(image)), (1, media.encode_pgm(image[:1]))]
    df = spark.createDataFrame([(i, m, "x", "y") for i, m in rows], "id long, media binary, shape string, error string")
    out = media.describe_media(df, "id", "media", side=4, with_samples=True).collect()
    assert len(out) == len(rows)
    good = [r for r in out if r["error"] is None]
    assert sorted((r["id"] or 0, r["shape"]) for r in good) == [(0, [5, 7]), (1, [1, 7]), (1, [5, 7]), (2, [5, 7])]
    same = [r for r in good if r["shape"] == [5, 7]]
    assert len({(r["samples_sha256"], r["feature"], bytes(r["tile"])) for r in same}) == 1
    assert all((np.load(io.BytesIO(r["samples"])) == image).all() and np.load(io.BytesIO(r["tile"])).shape == (4, 4) for r in same)
    assert sorted(r["id"] for r in out if r["error"] and r["tile"] is None and r["shape"] is None) == [3, 4, 5]
    assert media.describe_media(df.filter("id > 9"), "id", "media").count() == 0


def test_area_resize_against_exact_means():
    rng = np.random.default_rng(1)
    for h, w, r, c in [(24, 24, 8, 9), (7, 5, 3, 2), (3, 24, 8, 9), (1, 1, 4, 4)]:
        image = rng.integers(0, 256, (h, w)).astype(np.uint8)
        fine = np.kron(image.astype(float), np.ones((r, c)))  # each pixel as r x c equal parts, so cells have whole parts
        want = fine.reshape(r, h, c, w).mean(axis=(1, 3))
        assert np.allclose(media.area_resize(image, r, c), want)
    assert np.load(io.BytesIO(media.npy_tile(image))).shape == (16, 16)
    assert media.difference_hash(np.zeros((24, 24), np.uint8)) == "0" * 16


def test_media_query(edges, empty):
    rows = {r["doc_id"]: r for r in media.text_media(edges, with_media=True).collect()}
    assert len(rows) == 8 and media.text_media(empty).count() == 0
    for i, text in [(1, b""), (4, b"same text here again and again"), (7, b"long word " * 30_000)]:
        payload = text + b"\xff" * ((-len(text)) % 576 or (0 if text else 576))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert media.decode_media(bytes(r["media"])).tobytes() == payload and r["media_bytes"] == len(r["media"])
    assert rows[4]["feature"] == rows[5]["feature"]


def check_shards(df, rows, tolerance):
    out = sharding.byte_shards(df).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in out) == sorted((i is None, i or 0, len((t or "").encode()) + 1) for i, t in rows)
    sums = np.zeros(8)
    for s in range(8):
        own = [r for r in out if r["shard"] == s]
        sums[s] = sum(r["size"] for r in own)
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert sums.max() - sums.min() <= tolerance, sums
    return out


def test_shards(spark, docs, edges, empty):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    check_shards(d, rows, 2 * max(len(t.encode()) + 1 for _, t in rows))
    hot = docs([(i, "hot text" if i % 3 else f"own {i}", "en", "a") for i in range(3000)])
    out = check_shards(hot, [(i, "hot text" if i % 3 else f"own {i}") for i in range(3000)], 60)
    assert {r["text_crc32"] for r in out} >= {zlib.crc32(b"hot text")}
    assert sharding.byte_shards(empty).count() == 0 and sharding.byte_shards(edges).count() == 8
    small = docs([(i, f"group {i // 2}", "en", "a") for i in range(4000)])
    where = {}
    for r in sharding.byte_shards(small, tolerance=0.02).collect():
        where.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())  # equal texts stay together


def test_targets():
    assert mixing.fill_targets([100, 100, 100], [3, 1, 2], 1.5, 2) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.fill_targets([0, 10], [3, 1], 1.5, 2) == [0.0, 15.0] and mixing.fill_targets([], [], 1.5, 2) == []


def test_permutation_and_counts():
    for n in (1, 2, 3, 64, 1000, 4097):
        p = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 12345))
        assert sorted(p.tolist()) == list(range(n))
    c = mixing.shard_counts([10, 0, 5000, 37], 7, 1)
    assert c.sum(axis=0).tolist() == [10, 0, 5000, 37] and c.sum(axis=1).max() - c.sum(axis=1).min() <= 1


def test_mix(spark, edges, empty):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    out, pieces = mixing.mix(d, block=16)
    rows = out.collect()
    texts = {r["doc_id"]: r for r in d.collect()}
    by = {}
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]]["text"].encode().split()) and 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(texts[r["doc_id"]]["source"], []).append(r)
    names = sorted(by)
    want = mixing.fill_targets([sum(r["size"] for r in by[n]) for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2)
    for n, t in zip(names, want, strict=True):
        assert by[n][0]["target"] == pytest.approx(t) and abs(sum(r["taken"] for r in by[n]) - t) <= 17 and by[n][0]["source_size"] == sum(r["size"] for r in by[n])
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(d, block=16)[0].collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    mixed = {r["doc_id"]: r["text"] for r in mixing.mixed_texts(d, pieces).collect()}
    for r in rows:
        assert len(mixed.get(r["doc_id"], "").encode().split()) == r["taken"]
    got = {r["doc_id"]: r for r in mixing.mix(edges)[0].collect()}
    assert len(got) == 8 and got[1]["size"] == 0 == got[1]["taken"] and mixing.mix(empty)[0].count() == 0


def test_mix_tells_rows_apart(docs):
    """Equal rows, and rows with null ids, take at most twice their own size, and sources meet their targets."""
    rows = [(1, "w " * 200, "en", "a")] * 2 + [(i, f"own{i} " * 150, "en", "a") for i in range(2, 8)] + [(None, "x " * 90, "en", "b"), (None, "y " * 110, "en", "b"), (9, "", "en", "b"), (10, "z " * 500, "en", None)]
    out, pieces = mixing.mix(docs(rows), block=16, keep=["lang"])
    got = out.collect()
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    for s in ("a", "b", None):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 17, s
    texts = mixing.mixed_texts(docs(rows), pieces, keep=["lang"]).collect()
    assert sorted(len(r["text"].split()) for r in texts) == sorted(r["taken"] for r in got if r["taken"]) and {r["lang"] for r in texts} == {"en"}


def test_licenses(edges, empty):
    s = licenses.Scanner()
    for name, text in licenses.TEMPLATES.items():
        whole = f"A sentence before.\n{text}\nand after that " * 2
        found = s.scan(whole.encode())
        assert [f[0] for f in found] == [name] * 2 and all(whole.encode()[f[1] : f[2]].decode() == text for f in found)
    changed = licenses.TEMPLATES["MIT"].replace("sell copies", "vend copies")
    assert s.scan(("x " * 9000 + changed).encode())[0][4] == "-sell +vend"
    assert s.scan(b"He has a license to drive; without permission.") == [] == s.scan(None) == s.scan(b"")
    bsd = licenses.TEMPLATES["BSD"].replace("Redistribution", "Redistributing")
    assert [f[::4] for f in s.scan(f"some words {bsd} {'more words ' * 100}".encode())] == [("BSD", "-redistribution +redistributing")]
    for name, text in licenses.TEMPLATES.items():  # whatever words are changed, as far as a notice may differ, it is looked at
        words, rng = text.split(), np.random.default_rng(len(text))
        for _ in range(20):
            for i in rng.permutation(len(words))[: licenses.allowed(len(words))]:
                words[i] = "changed"
            assert len(s.runs.places(f"in front {' '.join(words)} behind".encode())), name
            words = text.split()
    far = b"word " * 300_000 + licenses.TEMPLATES["MIT"].replace(" ", "\n     # ").encode() + b" word" * 300_000
    assert [f[0] for f in s.scan(far)] == ["MIT"]
    around = [licenses.TEMPLATES["BSD"].encode().join([b"w " * (licenses.CHUNK // 2 - n), b" end"]) for n in (0, 5, 40, 140, 400)]
    assert all([f[0] for f in s.scan(t)] == ["BSD"] for t in around)
    equal = s.scan(b"All rights reserved. " + licenses.TEMPLATES["MIT"].encode() + b" All rights reserved.")
    assert [f[0] for f in equal] == ["All-rights-reserved", "MIT", "All-rights-reserved"]
    many = s.scan(b"All rights reserved.\n" * 3000)
    assert len(many) == 3000 and many[1][1] == 21
    rows = {r["doc_id"]: r["findings"] for r in licenses.scan_licenses(edges).collect()}
    assert len(rows) == 8 and not any(rows.values()) and licenses.scan_licenses(empty).count() == 0


def test_license_families_and_anchors():
    s = licenses.Scanner()
    names = lambda text: [f[0] for f in s.scan(text.encode())]
    gpl = licenses.TEMPLATES["GPL-3.0"]
    assert names(gpl.replace("GNU General", "GNU Affero General")) == ["AGPL-3.0"]
    assert names(gpl.replace("GNU General", "GNU Lesser General")) == ["LGPL-3.0"]
    assert names(gpl.replace("version 3", "version 2")) == ["GPL-2.0"]
    assert names(gpl.replace("version 3", "version 1")) == []
    assert names(gpl.replace("version 3", "version 1") + " And then. " + gpl) == ["GPL-3.0"]
    assert names("This work is licensed under the GNU Affero General Public License, version 3.") == ["AGPL-3.0-statement"]
    assert names("Licensed under the GNU General Public License, version 2.") == ["GPL-2.0-statement"]
    assert names("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.") == ["CC-BY-SA-4.0"]
    assert names("x " * 2000 + "All rights\n# reserved." + " y" * 2000) == names("All  rights reserved") == ["All-rights-reserved"]
