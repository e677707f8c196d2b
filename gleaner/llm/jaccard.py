"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes; equal sets are one set from the start, whatever their
number. The join has two parts, which go on in rounds.

Which pairs to count. Two sets whose Jaccard index is at least num/den differ in at most (|x|+|y|)(den-num)/(den+num)
n-grams. Cut the order into more parts than that: at least one part is the same in both sets. So each set gives a key for
each of its parts (their number depends on its class of sizes; a set that may link with larger ones also gives the keys
of their classes), and sets without a key in common can't be linked. The sets of all keys that have the same least set, the
anchor, are a group. In the first round every set of a group is paired with its anchor.

Counting. The order is cut into a few long fragments, and a set's n-grams into a record for each. A record is sent to the
unit of its fragment and pair's first set; there the partial overlap of the pair in this fragment is counted, and left
out if the sizes before, in and after the fragment already differ by too much. The partial overlaps are summed per pair.
Before, sketches of a few bits for each n-gram, which never differ in more bits than the sets in n-grams, rule out pairs.

Further rounds. What is linked so far gives components. A group whose sets are all in one component is done. Of any other
group the sets outside its largest component are compared with all sets of other components, by their sketches alone and
in blocks; only pairs that may link are counted. So a group of copies is settled by one pass over it, without its pairs,
and no link between different components is missed.

What is counted by a key is written before it is joined: a join right above its own aggregation can't be split.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import discard, map_rows, materialize

GROWTH = 1.4
#: Pairs of one set that one unit of work counts, and sets of a block whose sketches are compared, at most about.
UNIT, BLOCK = 256, 512
#: Fragments beyond the necessary ones, in hundredths of these.
SPARE = 18
#: Bits of the map of wanted rows: for each of these rows, in one part of the map, and at most.
SPARSE, PLACES, MOST = 16, 1 << 15, 1 << 27
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd number and of its inverse, modulo 2**64; as many as have been asked for stay."""
    if len(_known[0]) < n:
        n = max(n, 1 << 16)
        _known[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _known[0][:n], _known[1][:n]


_BASE = 0x9E3779B97F4A7C15
_known: list[np.ndarray] = [np.zeros(0, np.uint64)] * 2
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
CHUNK = 1 << 20


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word in lower case (A-Z), and the words' first bytes. Computed for all words of a part of the
    text at once, as differences of sums over its bytes; parts end at white space."""
    hashes, places, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(text):
        to = min(len(text), at + CHUNK)
        while to < len(text) and not _SPACE[text[to]]:
            to += 1
        data = np.frombuffer(text[at:to].lower(), np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[data], [True]])))
        starts, ends = edges[::2], edges[1::2]
        up, down = _powers(len(data) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[: len(data)])])
        hashes.append(mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        places.append(starts + at)
        at = to
    return np.concatenate(hashes), np.concatenate(places)


def ngram_hashes(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a lower-cased text; of fewer words, the whole sequence is one."""
    w, _ = word_hashes(text or b"")
    if not len(w):
        return w
    n = min(words, len(w))
    x = np.full(len(w) - n + 1, n * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
    for i in range(n):
        x = mix64(x + w[i : len(w) - n + 1 + i] * np.uint64(2 * i + 3))
    return np.unique(x)


def size_classes(most: int) -> list[int]:
    """First sizes of the classes, until over most."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return out


_classes = lru_cache(4096)(size_classes)


def part_keys(hashes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of the parts of one set, by which any set that links with it can be found.

    Of p parts, p - d are the same in both sets where d n-grams differ at most. Small parts are alike by chance,
    so p is larger than d + 1 by a part, and a set whose parts of at most s n-grams are fewer than p - d gives no key
    for these (the largest s up to 1): among the p - d equal ones there is a larger one, which has a key in both sets.
    """
    n = len(hashes)
    bounds = _classes(n * den // num)  # the largest set that may link with it is in the last class but one
    first = next(s for s in range(len(bounds)) if bounds[s + 1] > n)
    marks, out = mix64(hashes + np.uint64(0x9E3779B97F4A7C15)), []
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(marks)])
    for s in range(first, len(bounds) - 1):
        differ = 2 * (bounds[s + 1] - 1) * (den - num) // (den + num)
        parts = differ + 1 + -(-differ * SPARE // 100)
        part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        size = np.diff(cuts)
        least = max([0, *(k + 1 for k in (0, 1) if (size <= k).sum() < parts - differ)])
        whole = sums[cuts[1:]] - sums[cuts[:-1]]
        keys = mix64(whole + mix64(np.arange(parts, dtype=np.uint64) + np.uint64(s << 32)))
        out.append(keys[size >= least])
    return np.concatenate(out)


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, num: int = 90, den: int = 100, fragments: int = 8, passes: int = 4) -> DataFrame:
    """One row for each input row: id, n_shingles (size of its set), component_id (least id reachable by links).

    Links: den * |intersection| >= num * |union| over sets of distinct word n-grams (64-bit hashes) of the lower-cased
    whole text. Null, empty and blank texts have size 0 and are linked with nothing: component_id is the id itself. Equal
    sets are linked. A null id gets the component of its class, and never names one. Rows of one id with different texts
    are each linked by their own text. Other columns are ignored, whatever their names. Ids are of one integer type.
    fragments: records that a set's n-grams are cut into. passes: portions of the sets, and then of the keys, that are
    looked at one after the other, so that their shuffles need as much less disk.
    """
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("r"), F.col(text_col).alias("t"))

    def describe():
        def each(key, r, text):
            hashes = ngram_hashes(text, words)
            digest = xxhash.xxh3_128_digest(hashes.tobytes())
            keys = part_keys(hashes, num, den) if len(hashes) else hashes
            yield key, r, len(hashes), int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), keys.tobytes()

        return each

    keyed = materialize(map_rows(rows, f"id {kind}, r long, n long, x long, x2 long, keys binary", describe, ["id", "r", "t"]), "jaccard-keyed")
    base = materialize(keyed.drop("keys"), "jaccard-sets")
    classes = materialize(base.filter("n > 0").groupBy("x", "x2").agg(F.min("id").alias("rep"), F.min("r").alias("r")), "jaccard-classes")
    portion = lambda df, turn: df.filter(F.pmod("r", F.lit(passes)) == turn)
    one_each = lambda turn: portion(keyed.filter("n > 0").select("r", "x", "keys"), turn).join(portion(classes.select("r", "x"), turn), ["r", "x"], "left_semi").dropDuplicates(["r", "x"])
    pieces = [materialize(one_each(turn).select("x", "keys"), "jaccard-chosen") for turn in range(passes)]
    chosen = reduce(DataFrame.union, pieces)
    discard(keyed)
    parts = []
    for turn in range(passes):
        entries = _explode_keys(chosen, turn, passes)
        alike = entries.groupBy("k").agg(F.min("x").alias("anchor"), F.count("*").alias("c"))
        common = materialize(alike.filter("c > 1").select("k", "anchor"), "jaccard-keys")
        parts.append(materialize(entries.join(common.hint("shuffle_hash"), "k").select("anchor", "x").distinct(), "jaccard-meets"))
        discard(common)
    meets = materialize(reduce(DataFrame.union, parts).distinct(), "jaccard-meets")
    discard(*pieces, *parts)
    members = materialize(meets.select("x").distinct().join(classes.select("r", "x"), "x"), "jaccard-members")

    def cut():
        def each(x, text):
            hashes = ngram_hashes(text, words)
            cuts = np.searchsorted(hashes, edges)
            yield x, len(hashes), 0, sketch(hashes), -1
            for f, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(hashes)], strict=True)):
                yield x, len(hashes), lo, hashes[lo:hi].tobytes(), f

        return each

    edges = np.array([f * ((1 << 64) // fragments) for f in range(1, fragments)], np.uint64)
    texts = _likely(rows, members).join(members, "r").dropDuplicates(["x"]).select("x", "t")
    segments = materialize(map_rows(texts, "x long, n long, before long, grams binary, f int", cut, ["x", "t"]), "jaccard-segments", by="f")
    others = meets.filter("x <> anchor")
    links = count_pairs(others.select(F.col("anchor").alias("a"), F.col("x").alias("b")), segments, num, den)
    reached = _settle(others, links, segments, num, den)
    discard(meets, members, segments)
    named = classes.join(reached, F.col("x") == F.col("node"), "left").select("x", "x2", "rep", F.coalesce("component", "x").alias("label"))
    names = materialize(named.groupBy("label").agg(F.min("rep").alias("least")), "jaccard-names")
    out = base.join(materialize(named.join(names, "label").select("x", "x2", "least"), "jaccard-named"), ["x", "x2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").cast("long").alias("component_id"))


def _likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose hash r is wanted, and few others, found without a shuffle: so of the texts only about those that a
    join with the wanted rows needs are shuffled. Every wanted r sets the bit of its last binary digits in a map that all
    tasks get, of MOST bits (16 MB) at most; were the wanted rows too many for it, more others would stay."""
    bits = min(MOST, max(PLACES, 1 << (SPARSE * wanted.count()).bit_length()))
    place = F.col("r").bitwiseAND(F.lit(bits - 1))
    part, bit = F.shiftright(place, PLACES.bit_length() - 1), place.bitwiseAND(F.lit(PLACES - 1))
    marks = wanted.groupBy(part.alias("part")).agg(F.bitmap_construct_agg(bit).alias("marks"))
    byte = F.conv(F.hex(F.col("marks").substr(F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(marks), part == F.col("part")).filter(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1).select(*rows.columns)


def _settle(groups: DataFrame, links: DataFrame, segments: DataFrame, num: int, den: int, width: int = 8) -> DataFrame:
    """Components (node, component) of all links, given the links found so far and groups (anchor, x) whose anchors have
    been paired with all others and are left out.

    Of a group in several components, the sets outside the largest one are compared by their sketches with all sets of
    other components, in units of two blocks. Of the pairs that may link, the first `width` of each set are counted; if
    there were more, the next round, with the components found meanwhile, looks at four times as many.
    """
    while True:
        reached = materialize(components(links), "jaccard-reached")
        labelled = groups.join(reached, F.col("x") == F.col("node"), "left").select("anchor", "x", F.coalesce("component", "x").alias("label"))
        counted = labelled.groupBy("anchor", "label").agg(F.count("*").alias("c"))
        largest = counted.groupBy("anchor").agg(F.max(F.struct("c", "label")).alias("most"), F.sum("c").alias("c"), F.count("*").alias("labels"))
        blocks = lambda c: F.ceil(c / BLOCK).cast("int")
        apart = largest.filter("labels > 1").select("anchor", F.col("most.label").alias("main"), blocks(F.col("c")).alias("chunks"), blocks(F.col("c") - F.col("most.c")).alias("blocks"))
        apart = materialize(apart, "jaccard-apart")
        if apart.isEmpty():
            discard(links, apart)
            return reached
        rows = labelled.join(apart, "anchor").join(segments.filter("f = -1").select("x", "n", "grams"), "x")
        spread = lambda n: F.pmod(F.xxhash64("x"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        right = rows.select("anchor", every("blocks").alias("i"), spread("chunks").alias("j"), "x", "label", "n", "grams", F.lit(False).alias("left"))
        left = rows.filter("label <> main").select("anchor", spread("blocks").alias("i"), every("chunks").alias("j"), "x", "label", "n", "grams", F.lit(True).alias("left"))
        compared = right.union(left).groupBy("anchor", "i", "j").applyInArrow(lambda t: _alike(t, num, den, width), "a long, b long, more boolean")
        found = materialize(compared.groupBy("a", "b").agg(F.max("more").alias("more")), "jaccard-alike")
        more = count_pairs(found.select("a", "b"), segments, num, den)
        whole = found.filter("more").isEmpty()
        new = materialize(more.union(links), "jaccard-links")
        none = more.isEmpty()
        discard(apart, found, more, links)
        links, width = new, width * 4
        if whole and none:
            discard(links)
            return reached
        discard(reached)
        if whole:
            reached = materialize(components(links), "jaccard-reached")
            discard(links)
            return reached


def _alike(table: pa.Table, num: int, den: int, width: int) -> pa.Table:
    """Pairs of sets of different components that may link by their sketches, the first few of each left set; more: there
    are others in this unit."""
    x, n, label, side = (table[c].to_numpy() for c in ("x", "n", "label", "left"))
    parts = [np.frombuffer(g.as_buffer(), np.uint8) for c in table["grams"].chunks for g in c]
    size = min(512, *map(len, parts)) if side.any() and not side.all() else 0
    out: list[list] = [[], [], []]
    if size:
        bits = np.unpackbits(np.stack([folded(p, size) for p in parts]), axis=1).astype(np.float32)
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        b = b[np.argsort(mix64(x[b].view(np.uint64)), kind="stable")]
        ones = bits.sum(axis=1)
        differ = ones[a][:, None] + ones[b][None, :] - 2 * (bits[a] @ bits[b].T)
        alive = (differ * (den + num) <= (n[a][:, None] + n[b][None, :]) * (den - num)) & (label[a][:, None] != label[b][None, :])
        nth = alive.cumsum(axis=1)
        p, q = np.nonzero(alive & (nth <= width))
        beyond = (nth[:, -1] > width)[p]
        out = [np.minimum(x[a[p]], x[b[q]]), np.maximum(x[a[p]], x[b[q]]), beyond]
    return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64()), "more": pa.array(out[2], pa.bool_())})


def sketch(hashes: np.ndarray) -> bytes:
    """A bit for each n-gram's place, flipped by each n-gram that falls on it; places are a power of two, above twice the
    number of n-grams. Bits that differ between two sets are at most the n-grams that do."""
    size = 1 << max(8, int(2 * len(hashes)).bit_length())
    odd = np.bincount((mix64(hashes) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A sketch in fewer places."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def count_pairs(pairs: DataFrame, segments: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) that link. Sketches rule out most of those that don't. Of the others, partial overlaps are
    counted fragment by fragment, each in units of its own of one set a and at most about UNIT others, and summed per pair."""
    pairs = materialize(pairs, "jaccard-pairs")
    alive = materialize(_units(pairs, segments.filter("f = -1"), num, den).select("a", "b"), "jaccard-alive")
    discard(pairs)
    if alive.isEmpty():
        return alive
    partial = _units(alive, segments.filter("f >= 0"), num, den)
    summed = partial.groupBy("a", "b").agg(F.sum("common").alias("common"), F.max("total").alias("total"))
    out = materialize(summed.filter(F.col("common") * den >= (F.col("total") - F.col("common")) * num).select("a", "b"), "jaccard-links")
    discard(alive)
    return out


def _units(pairs: DataFrame, segments: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, common, total) for each pair and fragment: n-grams in common, and the sum of both sets' sizes. Left out is
    what shows that a pair can't link: sizes before, in and after a fragment, or sketches, that differ by too much."""
    dealt = materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / UNIT).cast("int").alias("units")), "jaccard-units")
    others = pairs.join(dealt, "a").select("a", F.col("b").alias("x"), F.pmod(F.xxhash64("b"), F.col("units")).cast("int").alias("unit"))
    firsts = dealt.select("a", F.col("a").alias("x"), F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("unit"))
    records = others.union(firsts).join(segments, "x").select("f", "a", "unit", "x", "n", "before", "grams")
    records = records.repartition("f", "a", "unit").sortWithinPartitions("f", "a", "unit", F.col("x") != F.col("a"))

    def overlaps(batches):
        first, n0, before0 = None, 0, 0
        for batch in batches:
            f, a, x, n, before = (batch.column(k).to_numpy() for k in (0, 1, 3, 4, 5))
            out: list[tuple] = []
            for i, grams in enumerate(batch.column(6)):
                own = np.frombuffer(grams.as_buffer(), np.uint8 if f[i] < 0 else np.uint64)
                if a[i] == x[i]:  # the unit's first record
                    first, n0, before0 = own, int(n[i]), int(before[i])
                    continue
                total, common = n0 + int(n[i]), 0
                if f[i] < 0:
                    size = min(len(first), len(own))
                    differ = int(np.bitwise_count(folded(first, size) ^ folded(own, size)).sum())
                else:
                    common = int((first.take(np.searchsorted(first, own), mode="clip") == own).sum()) if len(first) else 0
                    ahead, behind = abs(before0 - int(before[i])), abs((n0 - before0 - len(first)) - int(n[i] - before[i] - len(own)))
                    differ = ahead + behind + len(first) + len(own) - 2 * common
                if differ * (den + num) <= total * (den - num):
                    out.append((a[i], x[i], common, total))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b", "common", "total"])

    return records.mapInArrow(overlaps, "a long, b long, common long, total long")


def _explode_keys(rows: DataFrame, turn: int, passes: int) -> DataFrame:
    """(k, x) of the keys whose turn it is."""

    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            k, x = np.frombuffer(b"".join(keys), np.uint64), np.repeat(ids, [len(b) // 8 for b in keys])
            own = k % np.uint64(passes) == turn
            yield pa.RecordBatch.from_arrays([pa.array(k[own].view(np.int64)), pa.array(x[own])], ["k", "x"])

    return rows.mapInArrow(run, "k long, x long")


#: DuckDB SQL for the rows of jaccard_components with three words and 0.9, by looking at all pairs that share a shingle.
SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN [z[1] || ' ' || z[2] || ' ' || z[3] for z in list_zip(w[:len(w) - 2], w[2:len(w) - 1], w[3:])] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
u AS (SELECT s, min(doc_id) AS id, row_number() OVER () AS n, len(s) AS size FROM d WHERE len(s) > 0 GROUP BY s),
e AS MATERIALIZED (SELECT n, size, unnest(s) AS g FROM u),
p AS (SELECT a.n AS a, b.n AS b, count(*) AS both_have, any_value(a.size) + any_value(b.size) AS total FROM e a JOIN e b ON a.g = b.g AND a.n < b.n AND 100 * least(a.size, b.size) >= 90 * greatest(a.size, b.size) GROUP BY a.n, b.n),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * both_have >= 90 * (total - both_have)),
x AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT n AS a, n AS b FROM u UNION SELECT c.a, x.b FROM c JOIN x ON c.b = x.a),
k AS (SELECT c.a AS n, min(u.id) AS component_id FROM c JOIN u ON u.n = c.b GROUP BY c.a)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(k.component_id, d.doc_id) AS component_id FROM d LEFT JOIN u ON u.s = d.s LEFT JOIN k ON k.n = u.n
"""
