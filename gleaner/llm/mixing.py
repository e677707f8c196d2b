"""Mixing sources to target weights: packed blocks, multinomial counts per output shard, permuted indexes, a join by index."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, map_rows, materialize

WEIGHTS = (3, 1, 2)
#: Sources beyond which their table isn't broadcast.
BROADCAST = 10_000


def fill_targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """share of all sizes by weight; a target above most times its size stops there and the excess goes to the others by weight."""
    left, targets = share * sum(sizes), [0.0] * len(sizes)
    free = [i for i, n in enumerate(sizes) if n > 0]
    while free:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * unit > most * sizes[i]]
        if not full:
            for i in free:
                targets[i] = weights[i] * unit
            break
        for i in full:
            targets[i] = float(most * sizes[i])
            left -= targets[i]
        free = [i for i in free if i not in set(full)]
    return targets


def permute(index: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1 for each row: a four-round Feistel network that walks until it is in range."""
    bits = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    x, n = index.astype(np.uint64), n.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right, m, s, b = x[todo] >> bits[todo], x[todo] & mask[todo], mask[todo], seed[todo].astype(np.uint64), bits[todo]
        for r in range(4):
            z = (right + s + np.uint64(0x9E3779B97F4A7C15 * (r + 1) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(29))) & m)
        x[todo] = (left << b) | right
        todo &= x >= n
    return x.astype(np.int64)


def shard_counts(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Multinomial draws of sources for each shard's slots, from what is left of each quota; the draws use the quotas up exactly."""
    rng, left = np.random.default_rng(seed), np.array(quotas, np.int64)
    out = np.zeros((shards, len(quotas)), np.int64)
    for k in range(shards):
        slots = int(left.sum()) // (shards - k)
        while slots > 0:
            draw = np.minimum(rng.multinomial(slots, left / left.sum()), left)
            out[k] += draw
            left -= draw
            slots -= int(draw.sum())
    return out


def row_hashes(df: DataFrame, columns: list[str]) -> list:
    """Two hashes by which a row is known; rows that agree in them agree in all these columns."""
    return [F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(1), *columns).alias("h2")]


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, block: int = 64, shards: int = 16, seed: int = 17, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Mix sources' words in blocks of a fixed length.

    Returns (documents, pieces). documents: id, size, source, source_size, target, taken (words, repeats counted), one row
    for each input row. pieces: h1, h2 (hashes of the row: id, text, source and the columns in keep), s, start (the row's
    place), first, last (words of the row, last exclusive), block, times (0, 1 or 2).
    Sources by code point, null last, weigh 3, 1, 2, repeating. Targets are met to within a block; a block is taken most
    times at most, so no row gives more than most times its size. A null or empty text has size 0 and takes nothing. Rows
    are told apart by their place, not by their id: repeated rows and rows with a null id count each. Other columns are
    ignored. An empty table gives empty results. Sizes by source come to the driver: as many numbers as there are sources.
    """
    base = materialize(df.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("src"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        *row_hashes(df, [id_col, text_col, source_col, *(keep or [])]),
    ), "mix-sizes")
    spark = df.sparkSession
    buckets = max(64, base.count() // 50_000)
    base = base.withColumn("bucket", F.pmod("h1", F.lit(buckets)))
    sums = base.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    sources = sums.groupBy("src").agg(F.sum("n").alias("n")).collect()
    sources.sort(key=lambda r: (r["src"] is None, r["src"] or ""))
    sizes = [r["n"] for r in sources]
    targets = fill_targets(sizes, [float(WEIGHTS[i % 3]) for i in range(len(sizes))], share, most)
    blocks = [-(-n // block) for n in sizes]
    quotas = [min(int(t / n * b + 0.5), int(most) * b) if n else 0 for t, n, b in zip(targets, sizes, blocks, strict=True)]
    table = spark.createDataFrame([(i, r["src"], n, t, b) for i, (r, n, t, b) in enumerate(zip(sources, sizes, targets, blocks, strict=True))], "s int, src string, source_size long, target double, blocks long")
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("src", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("src", "bucket").orderBy("h1", "h2").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        base.withColumn("within", F.coalesce(F.sum("size").over(own), F.lit(0))).alias("d")
        .join(starts.alias("b"), F.col("d.src").eqNullSafe(F.col("b.src")) & (F.col("d.bucket") == F.col("b.bucket")))
        .join((F.broadcast(table) if len(sources) <= BROADCAST else table).alias("t"), F.col("d.src").eqNullSafe(F.col("t.src")))
        .select("d.id", "d.h1", "d.h2", "d.size", "d.src", "t.s", "source_size", "target", "blocks", (F.col("base") + F.col("within")).alias("start"))
    )
    placed = materialize(placed, "mix-places")
    # slots: (shard, source, ordinal), mapped through the source's permutation to a block
    counts = shard_counts(quotas, shards, seed) if sources else np.zeros((shards, 0), np.int64)
    runs, at, done = [], 0, [0] * len(quotas)
    for k in range(shards):
        for s, n in enumerate(counts[k].tolist()):
            if n:
                runs.append((k, s, at, at + n, done[s], blocks[s]))
                at, done[s] = at + n, done[s] + n
    los = np.array([r[2] for r in runs] or [0], np.int64)
    kinds = np.array([[r[0], r[1], r[4], r[5]] for r in runs] or [[0, 0, 0, 1]], np.int64)

    def deal(batches):
        for batch in batches:
            j = batch.column(0).to_numpy()
            r = np.searchsorted(los, j, "right") - 1
            nth = kinds[r, 2] + j - los[r]
            n = kinds[r, 3]
            index = permute(nth % n, n, kinds[r, 1] * 1_000_003 + seed)
            yield pa.RecordBatch.from_arrays([pa.array(kinds[r, 0].astype(np.int32)), pa.array(kinds[r, 1].astype(np.int32)), pa.array(index)], ["shard", "s", "block"])

    slots = spark.range(0, at, 1, max(2, min(4096, at // 250_000 + 2))).mapInArrow(deal, "shard int, s int, block long")
    times = slots.groupBy("s", "block").agg(F.count("*").alias("times"))
    spans = placed.filter("size > 0").select("h1", "h2", "s", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    pieces = spans.join(times, ["s", "block"]).select(
        "h1", "h2", "s", "start", "block",
        F.greatest(F.lit(0).cast("long"), F.col("block") * block - F.col("start")).alias("first"),
        F.least(F.col("size"), (F.col("block") + 1) * block - F.col("start")).alias("last"),
        "times",
    )
    taken = pieces.groupBy("s", "start").agg(F.sum((F.col("last") - F.col("first")) * F.col("times")).alias("taken"))
    place = F.when(F.col("p.size") > 0, F.col("p.start"))  # rows without words share their place with the next row
    out = placed.alias("p").join(taken.alias("k"), (F.col("p.s") == F.col("k.s")) & (place == F.col("k.start")), "left").select(
        F.col("p.id").alias(id_col), "size", F.col("src").alias(source_col), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )
    return out, pieces


def mixed_texts(df: DataFrame, pieces: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """The words that a mix (with the same columns to keep) takes of each row as its text: id, text, source and the
    columns in keep. Rows of which nothing is taken go. Pieces that follow each other keep what is between them; other
    pieces begin a new line. A block that is taken twice comes again in a second pass over the row."""
    more, kinds = [source_col, *(keep or [])], dict(df.dtypes)
    taken = pieces.groupBy("h1", "h2", "s", "start").agg(F.array_sort(F.collect_list(F.struct("first", "last", "times"))).alias("taken"))
    rows = df.select(*row_hashes(df, [id_col, text_col, *more]), F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(more)])
    rows = rows.dropDuplicates(["h1", "h2"]).join(taken, ["h1", "h2"])

    def make():
        word = re.compile(WORD.encode())

        def each(key, text, taken, *rest):
            ends = np.array([m.span() for m in word.finditer(text)], np.int64).reshape(-1, 2)
            parts = []
            for again in range(max(t["times"] for t in taken)):
                runs: list[list[int]] = []
                for t in taken:
                    if t["times"] > again:
                        if runs and runs[-1][1] == t["first"]:
                            runs[-1][1] = t["last"]
                        else:
                            runs.append([t["first"], t["last"]])
                parts += [text[ends[a, 0] : ends[b - 1, 1]] for a, b in runs]
            yield key, b"\n".join(parts), *rest

        return each

    return map_rows(rows, f"{id_col} {kinds[id_col]}, {text_col} string" + "".join(f", {c} {kinds[c]}" for c in more), make, ["id", "text", "taken", *[f"keep_{i}" for i in range(len(more))]])
