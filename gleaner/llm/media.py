"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .shared import map_rows

WIDTH = 24
UNIT = WIDTH * WIDTH
_GAP = rb"(?:\s|#[^\n]*\n)+"
_HEAD = re.compile(rb"P([1-6])" + _GAP + rb"(\d+)" + _GAP + rb"(\d+)")
_TOP = re.compile(_GAP + rb"(\d+)")
_REST = re.compile(rb"(?:#[^\n]*\n|\s)")
_NOTE = re.compile(rb"#[^\n]*")


def encode_pgm(samples: np.ndarray) -> bytes:
    """A binary 8-bit Netpbm file: grey for two dimensions, RGB for three."""
    kind = b"P5" if samples.ndim == 2 else b"P6"
    return kind + b"\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + np.ascontiguousarray(samples, np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An uncompressed BMP: 8-bit grey palette for two dimensions, 24-bit for three."""
    h, w = samples.shape[:2]
    deep = samples.ndim == 3
    row = (w * (3 if deep else 1) + 3) // 4 * 4
    body = np.zeros((h, row), np.uint8)
    body[:, : w * (3 if deep else 1)] = (samples[:, :, ::-1].reshape(h, -1) if deep else samples)[::-1]
    palette = b"" if deep else b"".join(bytes((i, i, i, 0)) for i in range(256))
    at = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", at + body.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24 if deep else 8, 0, body.size, 2835, 2835, 0 if deep else 256, 0) + palette + body.tobytes()


def decode_media(data: bytes) -> np.ndarray:
    """A Netpbm or BMP image as an array: rows x columns where it is grey, else with red, green and blue.

    Netpbm: P1 to P6, the first image of a file. Samples are uint8, or uint16 where the maximum is above 255; those of another
    maximum than 255 or 65,535 are scaled to it and rounded, bits are 0 and 255. BMP: 1, 4 and 8 bits with a palette (grey if
    the palette is), also run-length encoded, 16, 24 and 32 bits, also with masks; alpha is left out; pixels that runs skip have
    index 0. ValueError for all else: other data, no rows or columns, cut data, samples above the maximum, indices beyond the
    palette, and run-length images that claim more than 255 pixels for each byte of the file.
    """
    try:
        return _bmp(data) if data[:2] == b"BM" else _netpbm(data)
    except (struct.error, IndexError, OverflowError) as broken:
        raise ValueError(f"broken image: {broken}") from broken


def _netpbm(data: bytes) -> np.ndarray:
    head = _HEAD.match(data)
    if not head:
        raise ValueError("neither Netpbm nor BMP")
    kind, w, h = (int(x) for x in head.groups())
    at, top, shape = head.end(), 1, (h, w, 3) if kind in (3, 6) else (h, w)
    if kind not in (1, 4):
        stated = _TOP.match(data, at)
        if not stated or not 0 < (top := int(stated[1])) < 65536:
            raise ValueError("no maximum from 1 to 65535")
        at = stated.end()
    after = _REST.match(data, at)
    if not after or not w or not h:
        raise ValueError("no rows, columns or samples")
    at, n = after.end(), w * h * (3 if kind in (3, 6) else 1)
    if kind == 4:
        row = (w + 7) // 8
        return np.unpackbits(~np.frombuffer(data, np.uint8, row * h, at).reshape(h, row), axis=1)[:, :w] * np.uint8(255)
    if kind == 1:
        digits = np.frombuffer(re.sub(rb"\s+", b"", _NOTE.sub(b"", data[at:])), np.uint8, n)
        if not ((digits == 48) | (digits == 49)).all():
            raise ValueError("samples other than 0 and 1")
        return ((49 - digits) * np.uint8(255)).reshape(shape)
    if kind < 4:
        words = _NOTE.sub(b"", data[at:]).split(None, n)[:n]
        if len(words) < n or not all(x.isdigit() and len(x) < 10 for x in words):
            raise ValueError("cut samples, or none")
        out = np.array(words, np.int64)
    else:
        out = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at)
    return _scaled(out, top).reshape(shape)


def _scaled(samples: np.ndarray, top: int) -> np.ndarray:
    full, kind = (255, np.uint8) if top < 256 else (65535, np.uint16)
    if top != full or samples.dtype.itemsize > 2:
        if samples.max() > top:
            raise ValueError("samples above the maximum")
        samples = (samples.astype(np.int64) * (2 * full) + top) // (2 * top)
    return samples.astype(kind, copy=False)


def _bmp(data: bytes) -> np.ndarray:
    at, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    if head == 12:
        (w, h, _, bits), packed, used, entry = struct.unpack_from("<HHHH", data, 18), 0, 0, 3
    elif head >= 40:
        w, h, _, bits, packed, _, _, _, used = struct.unpack_from("<iiHHIIiiI", data, 18)
        entry = 4
    else:
        raise ValueError("an unknown BMP header")
    if w <= 0 or not h or (bits, packed) not in {(1, 0), (4, 0), (8, 0), (16, 0), (24, 0), (32, 0), (8, 1), (4, 2), (16, 3), (32, 3)}:
        raise ValueError("an unsupported BMP")
    rows, order = abs(h), slice(None, None, -1 if h > 0 else 1)
    if packed in (1, 2):
        if rows * w > 255 * len(data):
            raise ValueError("more pixels than runs can state")
        index = _runs(data, at, rows, w, bits)[order]
    else:
        row = (w * bits + 31) // 32 * 4
        body = np.frombuffer(data, np.uint8, row * rows, at).reshape(rows, row)[order]
        if bits == 24:
            return body[:, : w * 3].reshape(rows, w, 3)[:, :, ::-1].copy()
        if bits > 8:
            pixels = np.ascontiguousarray(body).view(f"<u{bits // 8}")[:, :w].astype(np.int64)
            masks = struct.unpack_from("<III", data, 54) if packed else (0x7C00, 0x3E0, 0x1F) if bits == 16 else (0xFF0000, 0xFF00, 0xFF)
            return np.stack([_masked(pixels, m) for m in masks], axis=2)
        index = body if bits == 8 else np.unpackbits(body, axis=1) if bits == 1 else np.stack([body >> 4, body & 15], axis=2).reshape(rows, -1)
        index = index[:, :w]
    count = min(used or 1 << bits, 1 << bits)
    table = np.frombuffer(data, np.uint8, count * entry, 14 + head).reshape(count, entry)
    if index.max() >= count:
        raise ValueError("an index beyond the palette")
    grey = (table[:, 0] == table[:, 1]).all() and (table[:, 1] == table[:, 2]).all()
    return table[index, 0] if grey else table[index][:, :, 2::-1].copy()


def _masked(pixels: np.ndarray, mask: int) -> np.ndarray:
    """What lies under a mask, scaled to 0 to 255; 0 without a mask."""
    if not mask:
        return np.zeros(pixels.shape, np.uint8)
    low = mask & -mask
    top = mask // low
    return ((((pixels & mask) // low) * 510 + top) // (2 * top)).astype(np.uint8)


def _runs(data: bytes, at: int, rows: int, w: int, bits: int) -> np.ndarray:
    """The indices of a run-length encoded bitmap, as its rows lie in the file."""
    out, x, y = np.zeros((rows, w), np.uint8), 0, 0

    def put(values: np.ndarray) -> None:
        nonlocal x
        if y >= rows or x + len(values) > w:
            raise ValueError("a run beyond its row")
        out[y, x : x + len(values)] = values
        x += len(values)

    def indices(part: bytes, n: int) -> np.ndarray:
        values = np.frombuffer(part, np.uint8)
        return (values if bits == 8 else np.stack([values >> 4, values & 15], axis=1).reshape(-1))[:n]

    while True:
        n, what = data[at], data[at + 1]
        at += 2
        if n:
            put(np.resize(indices(bytes((what,)), 2), n))
        elif what == 0:
            x, y = 0, y + 1
        elif what == 1:
            return out
        elif what == 2:
            x, y = x + data[at], y + data[at + 1]
            at += 2
        else:
            size = what if bits == 8 else (what + 1) // 2
            if at + size > len(data):
                raise ValueError("a cut run")
            put(indices(data[at : at + size], what))
            at += size + size % 2


def area_resize(image: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Mean of each output cell's exact area, from a summed-area table kept only at the rows that cell edges touch."""
    h, w = image.shape[:2]
    flat = image.reshape(h, w, -1)

    def edges(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        x = np.arange(parts + 1) * (n / parts)
        low = np.minimum(x.astype(np.int64), n)
        return low, x - low

    y, fy = edges(h, rows)
    x, fx = edges(w, cols)
    need = np.unique(np.concatenate([y, np.minimum(y + 1, h)]))
    cuts = need[need < h]
    sums = np.add.reduceat(flat, cuts, axis=0, dtype=np.int64)  # rows between the needed edges
    table = np.zeros((len(need), w + 1, flat.shape[2]), np.float64)
    span = np.concatenate([np.zeros((1, *sums.shape[1:]), np.int64), np.cumsum(sums, axis=0)])
    table[:, 1:] = np.cumsum(span[: len(need)], axis=1)
    at = {v: i for i, v in enumerate(need)}
    low, high = table[[at[v] for v in y]], table[[at[min(v + 1, h)] for v in y]]
    strip = low + (high - low) * fy[:, None, None]
    left, right = strip[:, x], strip[:, np.minimum(x + 1, w)]
    grid = left + (right - left) * fx[None, :, None]
    cell = (grid[1:, 1:] - grid[:-1, 1:] - grid[1:, :-1] + grid[:-1, :-1]) / ((h / rows) * (w / cols))
    return cell.reshape(rows, cols) if image.ndim == 2 else cell


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each cell of an 8 x 9 reduction is brighter than its right neighbour, as hex."""
    grey = image if image.ndim == 2 else image.mean(axis=2)
    small = area_resize(grey, 8, 9)
    return np.packbits(small[:, :-1] > small[:, 1:] + 1e-9).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = 16) -> bytes:
    """The image reduced to side x side as the bytes of an NPY file (uint8, rounded; samples of 16 bits by 257)."""
    out = io.BytesIO()
    np.save(out, np.floor(area_resize(image, side, side) / (257 if image.dtype == np.uint16 else 1) + 0.5).clip(0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def text_payload(text: bytes | None) -> tuple[int, bytes]:
    """Length of the text and its bytes, with 255 appended up to a positive multiple of 576."""
    text = text or b""
    return len(text), text + b"\xff" * (-len(text) % UNIT or (0 if text else UNIT))


def media_features(media: bytes) -> dict:
    """What is read back from a stored image: its samples' bytes, difference hash and NPY tile."""
    image = decode_media(media)
    return {"payload": image.tobytes(), "hash": difference_hash(image), "tile": npy_tile(image)}


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Store each whole text as an 8-bit PGM, read it back and describe it.

    Null and empty texts are one unit of 255. Rows map one to one; equal texts give equal values; a null id stays null.
    Other columns of the input are ignored, whatever their names. with_media adds the PGM and the NPY tile.
    """
    extra = ", media binary, tile binary" if with_media else ""

    def make():
        def each(key, text):
            n, payload = text_payload(text)
            media = encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH))
            back = media_features(media)
            row = (key, n, len(back["payload"]), hashlib.sha256(back["payload"]).hexdigest(), zlib.crc32(back["payload"][-32:]), len(media), hashlib.sha256(media).hexdigest(), "dhash:" + back["hash"], hashlib.sha256(back["tile"]).hexdigest())
            yield row + ((media, back["tile"]) if with_media else ())

        return each

    schema = f"{id_col} {dict(df.dtypes)[id_col]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string{extra}"
    return map_rows(df, schema, make, [id_col, text_col])


def describe_media(df: DataFrame, id_col: str, media_col: str, side: int = 16, with_samples: bool = False) -> DataFrame:
    """Decode a column of Netpbm and BMP images (binary) and describe each: shape, digest of the samples, hash, tile.

    Rows map one to one. A null, empty or broken image has null features and says why in `error`; a null id stays null;
    equal images give equal values, whatever format holds them. Other columns of the input are ignored, whatever their
    names. `tile` is an NPY file of side x side; with_samples adds the whole array as an NPY file.
    """
    extra = ", samples binary" if with_samples else ""

    def make():
        def each(key, media):
            try:
                image = decode_media(media or b"")
            except ValueError as broken:
                yield (key, None, None, None, None, "null" if media is None else str(broken), *((None,) if with_samples else ()))
                return
            whole = io.BytesIO()
            if with_samples:
                np.save(whole, image, allow_pickle=False)
            digest = hashlib.sha256(np.ascontiguousarray(image, image.dtype.newbyteorder("<")).tobytes()).hexdigest()
            yield (key, list(image.shape), digest, "dhash:" + difference_hash(image), npy_tile(image, side), None, *((whole.getvalue(),) if with_samples else ()))

        return each

    schema = f"{id_col} {dict(df.dtypes)[id_col]}, shape array<int>, samples_sha256 string, feature string, tile binary, error string{extra}"
    return map_rows(df, schema, make, [id_col, media_col])
