"""BPE encoding as a bounded-lookahead streaming transducer, and decoding as an incremental byte-to-text state machine.

Lookahead. Apply the merges in rank order to two texts that share a prefix. Let the front be the last boundary up to
which both have the same tokens; it starts where the texts part. A merge (a, b) moves it only by crossing it, that is
when a ends at the front and in one of the texts b begins there; then it moves left by len(a), and the token that begins
at the new front is ab in the one text and a in the other. Each merge crosses once. So one pass over the merge list,
which keeps for every token the farthest move that ends with this token at the front, bounds the whole move. A token
that ends at least that far before the end of what has been read is stable, whatever follows; what is held back, and the
window that is encoded, have constant size. No merge crosses a final boundary, so encoding goes on from there afresh.
This holds for lists in which each token is made by one merge that comes after its parts' merges; load() checks that.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from .shared import map_rows

SPACE = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
CHUNK = 1 << 16
SHORT = 48
CACHE = 60_000
NONE = 1 << 60
MADE = (1 << 20) - 1
#: Letters after an apostrophe by which longer contractions begin.
_BEGUN = ("r", "v", "l")
#: Where the standard library's classes and the properties of letters and numbers might differ.
UNUSUAL = re.compile("[^\\x00-\\x1b\\x20-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f]")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    out = [""] * 256
    for b in plain:
        out[b] = chr(b)
    for i, b in enumerate(rest):
        out[b] = chr(256 + i)
    return out


class Words(dict):
    """Ids of short words as little-endian bytes; two generations of bounded size."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.old = model, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.model.word_ids(word.encode())
        if len(word) <= SHORT:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Model:
    """A vocabulary and merge list in the JSON format of the tokenizers library (BPE with byte-level characters)."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        chars = byte_chars()
        self.first = [vocab[c] for c in chars]
        self.last = [vocab[c + self.suffix] for c in chars]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.text = [b""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.text[i] = t.encode()
        #: (left id, right id) -> rank * 2**20 + id; pairs of bytes that don't merge have NONE
        self.merges: dict[tuple[int, int], int] = {(a, b): NONE for a in self.first for b in [*self.first, *self.last]}
        length = {i: 1 for i in [*self.first, *self.last]}
        far = dict.fromkeys(length, 0)
        self.lookahead = 0
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            if made in length or left not in length or right not in length:
                raise ValueError("the merge list isn't proper")
            self.merges[left, right] = rank << 20 | made
            length[made] = length[left] + length[right]
            moved = length[left] + far[right]
            far[made] = max(moved, far[left])
            far[left] = max(far[left], moved)
            self.lookahead = max(self.lookahead, moved)
        self.length = length
        back = {c: b for b, c in enumerate(chars)}
        #: the bytes of each token; a word's end counts as one space
        self.bytes = [b""] * size
        for t, i in vocab.items():
            end = bool(self.suffix) and t.endswith(self.suffix) and len(t) > len(self.suffix)
            self.bytes[i] = bytes(back[c] for c in (t[: -len(self.suffix)] if end else t) if c in back) + b" " * end
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.usual = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
        self.words = Words(self)

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges by rank, and from the left within a rank."""
        get = self.merges.get
        if len(ids) <= SHORT:
            ranks = list(map(get, zip(ids, ids[1:])))
            while ranks and (best := min(ranks)) != NONE:
                i = ranks.index(best)
                ids[i : i + 2] = [best & MADE]
                del ranks[i]
                if i:
                    ranks[i - 1] = get((ids[i - 1], ids[i]), NONE)
                if i < len(ranks):
                    ranks[i] = get((ids[i], ids[i + 1]), NONE)
            return ids
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1]), NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = m & MADE, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (m := get((ids[p], ids[q]), NONE)) != NONE:
                    heapq.heappush(heap, (m, p, ids[p], ids[q]))
        return [x for x in ids if x >= 0]

    def word_ids(self, data: bytes) -> bytes:
        """Ids of one whole word."""
        if len(data) > 4 * self.lookahead + SHORT:
            word = OpenWord(self)
            return word.feed(data) + word.end()
        ids = [self.first[b] for b in data]
        ids[-1] = self.last[data[-1]]
        return np.array(self.merge(ids), "<u4").tobytes()


class OpenWord:
    """A word whose end isn't known yet: tokens come out once stable, and a bounded number of bytes is held back."""

    def __init__(self, model: Model):
        self.model, self.held = model, b""

    def feed(self, data: bytes) -> bytes:
        out, reach = [], self.model.lookahead + 1  # the last byte may yet become the word's end
        for at in range(0, len(data), 3 * reach):
            self.held += data[at : at + 3 * reach]
            if len(self.held) >= 2 * reach:
                ids = self.model.merge([self.model.first[b] for b in self.held])
                end = 0
                for i in ids:
                    step = self.model.length[i]
                    if end + step > len(self.held) - reach:
                        break
                    end += step
                    out.append(i)
                self.held = self.held[end:]
        return np.array(out, "<u4").tobytes()

    def end(self) -> bytes:
        if not self.held:
            return b""
        ids = [self.model.first[b] for b in self.held]
        ids[-1] = self.model.last[self.held[-1]]
        self.held = b""
        return np.array(self.model.merge(ids), "<u4").tobytes()


def _safe_end(text: str, low: int) -> int:
    """The last place, over low, before which normal form and pieces don't depend on what follows; 0 if there is none."""
    for i in range(len(text) - 1, low, -1):
        if text[i] in " \n\t":
            return i
    return 0


def _starts(c: str) -> bool:
    return c < "\x80" or not (unicodedata.combining(c) or unicodedata.category(c)[0] == "M" or "ᅠ" <= c <= "ᇿ")


class Encoder:
    """Text in chunks of any size; ids, as little-endian 32-bit numbers, once they are stable."""

    def __init__(self, model: Model):
        self.model, self.rest, self.open = model, "", None
        self.tail = max(map(len, model.special), default=1) + 4

    def feed(self, text: str) -> bytes:
        out = []
        for at in range(0, len(text), CHUNK):
            self.rest += text[at : at + CHUNK]
            end = _safe_end(self.rest, len(self.rest) // 2)
            if end:
                out.append(self._run(self.rest[:end], True))
                self.rest = self.rest[end:]
            elif len(self.rest) >= 2 * CHUNK:
                out.append(self._long())
        return b"".join(out)

    def end(self) -> bytes:
        out, self.rest = self._run(self.rest, True), ""
        return out

    def _long(self) -> bytes:
        """No white space for long: go on up to a boundary of characters that also cuts no special token, with the last piece open."""
        i = len(self.rest) - self.tail
        while i > 1 and not (_starts(self.rest[i]) and _starts(self.rest[i - 1])):
            i -= 1
        if self.model.cut:
            for m in self.model.cut.finditer(self.rest, max(0, i - self.tail)):
                if m.start() < i < m.end():
                    i = m.start()
        if i <= 1:  # one character with marks over the whole buffer: hold it
            return b""
        out, self.rest = self._run(self.rest[:i], False), self.rest[i:]
        return out

    def _run(self, text: str, whole: bool) -> bytes:
        """whole: the last piece ends here."""
        out, model = [], self.model
        parts = [(text, None)] if not model.cut or "<|" not in text else list(self._split(text))
        for n, (part, special) in enumerate(parts):
            if part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                part = part.lower()
                if self.open:
                    out.append(self._continue(part))
                    part = part[self.used :]
                words = (model.pieces if UNUSUAL.search(part) else model.usual).findall(part)
                keep = None
                if not whole and n == len(parts) - 1 and special is None and words:
                    keep = words.pop()
                    if words and words[-1] == "'" and keep in _BEGUN:
                        keep = words.pop() + keep  # may yet become a contraction
                out.append(b"".join(map(model.words.__getitem__, words)))
                if keep is not None:
                    self.open = (self._kind(keep[-1:]), OpenWord(model), keep)
                    if len(keep) > 3:  # no contraction any more: its class decides how it goes on
                        out.append(self.open[1].feed(keep.encode()))
                        self.open = (*self.open[:2], None)
            if (special is not None or (whole and n == len(parts) - 1)) and self.open:
                out.append(self._close())
            if special is not None:
                out.append(np.array([special], "<u4").tobytes())
        return b"".join(out)

    def _split(self, text: str) -> Iterator[tuple[str, int | None]]:
        at = 0
        for m in self.model.cut.finditer(text):
            yield text[at : m.start()], self.model.special[m[0]]
            at = m.end()
        yield text[at:], None

    def _kind(self, piece: str) -> regex.Pattern:
        return regex.compile(r"\p{L}*" if regex.match(r"\p{L}", piece) else "" if regex.match(r"\p{N}", piece) else rf"[^{SPACE}\p{{L}}\p{{N}}]*")

    def _continue(self, part: str) -> bytes:
        """Go on with the open piece; used: characters of part that belong to it."""
        kind, word, short = self.open
        if short is not None:  # still so short that what follows may change its pieces: cut the two together
            joined = short + part[:CHUNK]
            pieces = list(self.model.pieces.finditer(joined))
            self.used = 0
            ids = b""
            for m in pieces:
                if m.end() >= len(short):
                    if m.end() == len(joined) and m.end() - m.start() > 3:
                        self.open = (self._kind(m[0]), OpenWord(self.model), None)
                        self.used = len(joined) - len(short)
                        return ids + self.open[1].feed(m[0].encode())
                    self.open, self.used = None, m.end() - len(short)
                    return ids + self.model.words[m[0]]
                ids += self.model.words[m[0]]
            self.open = None
            return ids
        self.used = kind.match(part).end()
        ids = word.feed(part[: self.used].encode())
        if self.used < len(part):
            ids += word.end()
            self.open = None
        return ids

    def _close(self) -> bytes:
        _, word, short = self.open
        self.open = None
        return b"".join(map(self.model.words.__getitem__, self.model.pieces.findall(short))) if short is not None else word.end()


class Decoder:
    """Ids in any portions to text, by a UTF-8 state machine: complete characters come out, an unfinished one waits, and
    each maximal ill-formed part becomes one U+FFFD.

    pieces: the tokens' own strings with a space between, as a tokenizer without decoder gives; otherwise the bytes that
    the tokens stand for, with a space for each word's end.
    """

    def __init__(self, model: Model, pieces: bool):
        self.table = model.text if pieces else model.bytes
        self.pieces, self.begun, self.wait = pieces, False, b""

    def feed(self, ids: np.ndarray) -> str:
        data = (b" " if self.pieces else b"").join(map(self.table.__getitem__, ids.tolist()))
        if self.pieces and len(ids):
            data, self.begun = b" " * self.begun + data, True
        data = self.wait + data
        keep = self._unfinished(data)
        self.wait = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def end(self) -> str:
        out, self.wait = self.wait.decode("utf-8", "replace"), b""
        return out

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Bytes at the end that may begin a character."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC2:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4 if b < 0xF5 else 1
                if need <= back:
                    return 0
                if back > 1:
                    second = data[1 - back]
                    low = 0xA0 if b == 0xE0 else 0x90 if b == 0xF0 else 0x80
                    high = 0x9F if b == 0xED else 0x8F if b == 0xF4 else 0xBF
                    if not low <= second <= high:
                        return 0
                return back
            if not 0x80 <= b < 0xC0:
                return 0
        return 0


@lru_cache(2)
def load(data: bytes) -> Model:
    return Model(data)


def encode_documents(df: DataFrame, tokenizer: bytes, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each whole text and decode its ids again, in chunks.

    tokenizer: the tokenizer file's content, of fixed size, sent to each executor once. A null or empty text has no ids
    and an empty decoded text. Special tokens' strings in a text become those tokens. Rows map one to one, in any order
    of repetition; other columns are ignored, whatever their names. with_ids adds ids (binary: little-endian unsigned 32-bit numbers).
    """
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    def make():
        model = load(shared.value)

        def each(key, text):
            encoder, decoder = Encoder(model), Decoder(model, True)
            ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0
            kept = []
            text = (text or b"").decode("utf-8", "replace")
            for at in range(0, len(text) + 1, CHUNK):
                data = encoder.feed(text[at : at + CHUNK]) + (encoder.end() if at + CHUNK > len(text) else b"")
                ids = np.frombuffer(data, "<u4")
                part = decoder.feed(ids)
                n += len(ids)
                ids_hash.update(data)
                text_hash.update(part.encode())
                if with_ids:
                    kept.append(data)
            text_hash.update(decoder.end().encode())
            row = (key, n, ids_hash.hexdigest(), text_hash.hexdigest())
            yield row + ((b"".join(kept),) if with_ids else ())

        return each

    extra = ", ids binary" if with_ids else ""
    return map_rows(df, f"{id_col} {dict(df.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}", make, [id_col, text_col])
