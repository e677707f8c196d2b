"""Substring dedup: hash normalised lines or paragraphs, group digests globally, keep the earliest occurrence, cut the rest.

A unit is what lies between separators, its words compared in lower case (A-Z) whatever the white space between them.
Units of a few words repeat by chance or by form, so units below a least number of words stay. So that a longer passage is
found wherever in a unit it begins and ends, every run of a fixed number of words (over units' ends too) that occurs
earlier goes as well. Occurrences rank by (id, word). Only digests and places are shuffled to find repeats; a very common
digest is counted before the shuffle, and the join that marks its occurrences may be split.

Runs are found in two steps. Any run of RUN words holds RUN - GRAM + 1 sequences of GRAM words; the one with the least hash
stands for it. Equal runs have equal marks, at equal distances, and neighbouring runs mostly share theirs, so the marks
are few. Runs whose mark stands at one place alone can't repeat; of the others digests are compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import mix64, word_hashes
from .shared import discard, map_rows, materialize, small_batches

SEPARATORS = {"line": b"\n", "paragraph": b"\n\n"}
_PIECE = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
GRAM = 26
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def prefix_sums(words: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of words * base**place before each word, and base**-place; modulo 2**64."""
    n = len(words)
    up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))
    down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)]))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:-1])]), down


def sequence_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of the words from each start to its end."""
    sums, down = prefix_sums(words, _BASES[which])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def marks_of(words: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of so many words the hash of the sequence in it that stands for it, and its place."""
    gram = min(GRAM, run)
    width = run - gram + 1
    if len(words) < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.arange(len(words) - gram + 1)
    grams = sequence_hashes(words, starts, starts + gram)
    at = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(len(words) - run + 1)
    return grams[at].view(np.int64), at


def words_and_units(text: bytes, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's words, and the number of words in each unit."""
    words, starts = word_hashes(text)
    ends = [m.start() for m in re.finditer(SEPARATORS[unit], text)]
    return words, np.diff(np.concatenate([[0], np.searchsorted(starts, ends), [len(words)]])).astype(np.int64)


def cut_words(text: bytes, gone: np.ndarray, unit: str) -> tuple[bytes, list[tuple[int, int]]]:
    """The text without the words that are gone, each with the white space after it in its unit, and the (start, length)
    cut. A unit that loses all its words goes with its separator."""
    mark, keep, spans = SEPARATORS[unit], [], []
    start = i = 0
    for whole in text.split(mark):
        places = [m.span() for m in _PIECE.finditer(whole)]
        own = gone[i : i + len(places)]
        i += len(places)
        if not own.any():
            keep.append(whole)
        elif own.all():
            spans.append((start, len(whole)))
        else:
            left, to = [], 0
            change = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8))).tolist()
            for a, b in zip(change[::2], change[1::2], strict=True):
                left.append(whole[to : places[a][0]])
                to = places[b - 1][1]
                spans.append((start + places[a][0], to - places[a][0]))
            keep.append(b"".join(left) + whole[to:])
        start += len(whole) + len(mark)
    return mark.join(keep), spans


def _batches(rows: Iterator[tuple], names: list[str], kind: pa.DataType, limit: int = 200_000) -> Iterator[pa.RecordBatch]:
    """(id, hash, columns...) of equal length each to batches."""
    held: list[tuple] = []
    n = 0
    for row in rows:
        held.append(row)
        n += len(row[2])
        if n >= limit:
            yield _packed(held, names, kind)
            held, n = [], 0
    if held:
        yield _packed(held, names, kind)


def _packed(held: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    times = [len(r[2]) for r in held]
    again = np.repeat(np.arange(len(held)), times)
    first = [pa.array([r[0] for r in held], kind).take(pa.array(again)), pa.array(np.repeat(np.array([r[1] for r in held], np.int64), times))]
    return pa.RecordBatch.from_arrays(first + [pa.array(np.concatenate(c)) for c in zip(*(r[2:] for r in held), strict=True)], names)


def dedup_units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = 25, run: int = 50, keep: list[str] | None = None) -> DataFrame:
    """One row for each input row: id, n_units, n_removed, removed (array of start, length in the original's bytes), text.

    n_units counts units of at least min_words words. Of these every later occurrence goes, and so do the words of every
    run of `run` words that occurs earlier; a run that overlaps the first occurrence of its words is no repeat. n_removed
    counts stretches cut. A null or empty text has none and stays as it is. Rows with a null id stay as they are and don't
    count. Rows of one id with different texts are different documents, ranked by a hash of the text; equal rows of one
    id are one. Only the named columns are used, whatever others are called; those in keep are returned as they are.
    """
    kind, kinds, keep = dict(df.dtypes)[id_col], dict(df.dtypes), keep or []
    text = F.col(text_col).cast("binary").alias("text")
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), text, *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
    real = rows.filter(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", "h", "text")
    places = f"id {kind}, h long, at int, n int, d1 long, d2 long"

    def find(batches):
        def each(batch):
            for key, h, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words, counts = words_and_units(body.as_py(), unit)
                ends = np.cumsum(counts)
                starts = ends - counts
                long = counts >= min_words
                digests = [sequence_hashes(words, starts[long], ends[long], k).view(np.int64) for k in (0, 1)]
                m, at = marks_of(words, run)
                own, times = np.unique(m[np.unique(at, return_index=True)[1]], return_counts=True)
                none = np.full(len(own), -1, np.int32)
                yield key, h, *map(np.concatenate, zip((starts[long].astype(np.int32), counts[long].astype(np.int32), *digests), (none, times.astype(np.int32), own, own), strict=True))

        for batch in batches:
            yield from _batches(each(batch), ["id", "h", "at", "n", "d1", "d2"], batch.schema.field(0).type)

    found = materialize(small_batches(real).mapInArrow(find, places), "units")
    units, marks = found.filter("at >= 0"), found.filter("at < 0").select("id", "h", "n", F.col("d1").alias("m"))
    cut_units = materialize(_later(units, 0), "units-later")
    twice = materialize(marks.groupBy("m").agg(F.sum("n").alias("c")).filter("c > 1").select("m"), "run-marks")  # read back: the join has exchanges of its own, which can be split
    wanted = marks.join(twice, "m").groupBy("id", "h").agg(F.collect_set("m").alias("ms"))
    whole = cut_units.groupBy("id", "h").agg(F.collect_list(F.struct("at", "n")).alias("own"))
    wanted = materialize(wanted.join(whole, ["id", "h"], "left"), "run-wanted")
    discard(found, twice)

    def digest(batches):
        def each(batch):
            for key, h, body, ms, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), batch.column(4).to_pylist(), strict=True):
                words, _ = words_and_units(body.as_py(), unit)
                m, _ = marks_of(words, run)
                hit = np.isin(m, ms.values.to_numpy())
                for a in own or []:  # runs within a unit that goes: the first occurrence of the unit has them
                    hit[a["at"] : max(a["at"], a["at"] + a["n"] - run + 1)] = False
                at = np.flatnonzero(hit)
                if len(at):
                    yield key, h, at.astype(np.int32), np.full(len(at), run, np.int32), *[sequence_hashes(words, at, at + run, k).view(np.int64) for k in (0, 1)]

        for batch in batches:
            yield from _batches(each(batch), ["id", "h", "at", "n", "d1", "d2"], batch.schema.field(0).type)

    runs = materialize(real.join(wanted, ["id", "h"]).select("id", "h", "text", "ms", "own").mapInArrow(digest, places), "runs")
    discard(wanted)
    gone = _later(runs, run).union(cut_units).groupBy("id", "h").agg(F.collect_set(F.struct("at", "n")).alias("gone"))
    gone = materialize(gone.select("id", "h", F.col("gone.at").alias("at"), F.col("gone.n").alias("n")), "units-gone")
    discard(runs, cut_units)

    def cut():
        def each(key, body, at, lengths, *rest):
            if body is None:
                yield key, 0, 0, [], None, *rest
                return
            n = sum(len(u.split()) >= min_words for u in body.split(SEPARATORS[unit])) if key is not None else 0
            left, spans = body, []
            if at is not None:
                marked = np.zeros(len(_PIECE.findall(body)) + 1, np.int64)
                np.add.at(marked, at, 1)
                np.add.at(marked, at + lengths, -1)
                left, spans = cut_words(body, np.cumsum(marked)[:-1] > 0, unit)
            yield key, n, len(spans), [{"start": a, "length": b} for a, b in spans], left.decode("utf-8", "replace"), *rest

        return each

    more = "".join(f", {c} {kinds[c]}" for c in keep)
    schema = f"{id_col} {kind}, n_units long, n_removed long, removed array<struct<start:long,length:long>>, {text_col} string{more}"
    return map_rows(rows.join(gone, ["id", "h"], "left"), schema, cut, ["id", "text", "at", "n", *[f"keep_{i}" for i in range(len(keep))]])


def _later(places: DataFrame, apart: int) -> DataFrame:
    """(id, h, at, n) of all but the first of equal digests, at least so many words behind it in one text."""
    first = places.groupBy("d1", "d2").agg(F.min(F.struct("id", "h", "at")).alias("first"), F.count("*").alias("c")).filter("c > 1")
    first = materialize(first, "repeats")
    later = (F.col("id") != F.col("first.id")) | (F.col("h") != F.col("first.h")) | (F.col("at") >= F.col("first.at") + max(1, apart))
    return places.join(first, ["d1", "d2"]).filter(later).select("id", "h", "at", "n")


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(x))) AS p, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)
), placed AS (
  SELECT doc_id, p, line, sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY p) - strlen(line) - 1 AS ls FROM lines
), pieces AS (
  SELECT doc_id, p, ls, strlen(regexp_extract(line, '^[\x20\x09-\x0D]*')) AS lead, unnest(range(len(x))) AS k, unnest(x) AS piece
  FROM (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS x FROM placed)
), words AS (
  SELECT doc_id, p, k, piece, translate(regexp_extract(piece, '[^\x20\x09-\x0D]+'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w,
    ls + lead + sum(strlen(piece)) OVER (PARTITION BY doc_id, p ORDER BY k) - strlen(piece) AS start, row_number() OVER (PARTITION BY doc_id ORDER BY p, k) AS i
  FROM pieces
), units AS (
  SELECT doc_id, p, min(i) AS i, string_agg(w, ' ' ORDER BY k) AS txt FROM words GROUP BY doc_id, p HAVING count(*) >= 25
), gone_units AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY txt ORDER BY doc_id, i) AS nth FROM units) WHERE nth > 1
), runs AS (
  SELECT doc_id, i, string_agg(w, ' ') OVER ahead AS txt FROM words
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) QUALIFY count(*) OVER ahead = 50
), ranked AS (
  SELECT doc_id, i, first_value(doc_id) OVER same AS first_doc, first_value(i) OVER same AS first_i FROM runs WINDOW same AS (PARTITION BY txt ORDER BY doc_id, i)
), gone_runs AS (
  SELECT doc_id, i, true AS r FROM ranked WHERE doc_id <> first_doc OR i >= first_i + 50
), marked AS (
  SELECT w.*, u.p IS NOT NULL OR coalesce(bool_or(r.r) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone
  FROM words w LEFT JOIN gone_runs r ON w.doc_id = r.doc_id AND w.i = r.i LEFT JOIN gone_units u ON w.doc_id = u.doc_id AND w.p = u.p
), islands AS (
  SELECT *, sum(turn) OVER (PARTITION BY doc_id, p ORDER BY k) AS island FROM (SELECT *, CASE WHEN gone IS DISTINCT FROM lag(gone) OVER (PARTITION BY doc_id, p ORDER BY k) THEN 1 ELSE 0 END AS turn FROM marked)
), touched AS (
  SELECT doc_id, p, bool_and(gone) AS all_gone, string_agg(piece, '' ORDER BY k) FILTER (NOT gone) AS rest FROM marked GROUP BY doc_id, p HAVING bool_or(gone)
), cuts AS (
  SELECT doc_id, start, len FROM (SELECT doc_id, p, island, min(start) AS start, sum(strlen(piece)) AS len FROM islands WHERE gone GROUP BY doc_id, p, island) ANTI JOIN (SELECT doc_id, p FROM touched WHERE all_gone) USING (doc_id, p)
  UNION ALL SELECT doc_id, ls, strlen(line) FROM placed SEMI JOIN (SELECT doc_id, p FROM touched WHERE all_gone) USING (doc_id, p)
), spans AS (
  SELECT doc_id, count(*) AS n_removed, string_agg(start || ':' || len, ',' ORDER BY start) AS removed FROM cuts GROUP BY doc_id
), texts AS (
  SELECT doc_id, string_agg(CASE WHEN t.p IS NULL THEN line ELSE regexp_extract(line, '^[\x20\x09-\x0D]*') || rest END, chr(10) ORDER BY l.p) AS text
  FROM lines l LEFT JOIN touched t USING (doc_id, p) WHERE t.all_gone IS NOT TRUE GROUP BY doc_id
), counts AS (SELECT doc_id, count(*) AS n_units FROM units GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed,
  CASE WHEN d.text IS NOT NULL THEN coalesce(t.text, '') END AS text
FROM documents d LEFT JOIN counts USING (doc_id) LEFT JOIN spans USING (doc_id) LEFT JOIN texts t USING (doc_id)
"""
