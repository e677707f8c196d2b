"""Sharding by histogram sort: exact byte counts below candidate key boundaries, refined until splitters meet tolerance.

The sort key is (64-bit hash of the text, id), so equal texts are neighbours. A splitter lies between groups of equal
texts wherever such an edge is within tolerance of its target; only a group too large for that is cut, by id.
DataFrame functions alone run here; the driver sees a few hundred counts an iteration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _histogram(rows: DataFrame, key: str, probes: list[int]) -> list[tuple[int, int, int, int]]:
    """Of the rows between neighbouring probes, where there are any: exact bytes below, bytes, least and greatest key."""
    marks = F.array(*[F.lit(p) for p in probes])
    bins = rows.groupBy(F.size(F.filter(marks, lambda p: p <= F.col(key))).alias("b")).agg(F.sum("size").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
    out, below = [], 0
    for r in sorted(bins, key=lambda r: r["b"]):
        out.append((below, r["n"], r["lo"], r["hi"]))
        below += r["n"]
    return out


def _refine(rows: DataFrame, key: str, targets: list[float], slack: float, probes: int) -> list[tuple[int, int, int]]:
    """For each target (key, bytes below it, bytes of that key alone): those bytes are 0 where an edge within slack was found."""
    done: dict[int, tuple[int, int, int]] = {}
    spans = {i: (LOW, HIGH) for i in range(len(targets))}
    while spans:
        marks = sorted({p for lo, hi in spans.values() for p in range(lo, hi + 1, max(1, (hi - lo) // probes))})
        bins = _histogram(rows, key, marks)
        for i in list(spans):
            edges = [(below, lo) for below, _, lo, _ in bins]
            near = min(edges, key=lambda e: abs(e[0] - targets[i]))
            below, n, lo, hi = max((x for x in bins if x[0] <= targets[i]), key=lambda x: x[0])
            if abs(near[0] - targets[i]) <= slack:
                done[i] = (near[1], near[0], 0)
            elif lo == hi:
                done[i] = (lo, below, n)
            else:
                spans[i] = (lo, hi)
                continue
            del spans[i]
    return [done[i] for i in range(len(targets))]


def byte_shards(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.002, probes: int = 15, spread: int = 64) -> DataFrame:
    """Range shards of nearly equal bytes: id, size, text_crc32, shard, slot (gapless from 0 in each shard).

    size: UTF-8 bytes of the text plus 1 (null text: 1, crc 0). A null id sorts first. Rows equal in text and id stay
    together. An empty table gives an empty result. Other columns of the input are ignored, whatever their names.
    tolerance is a part of one shard's bytes; spread is the number of parts in which a shard's rows are numbered.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        df.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).cast("long").alias("crc"),
            F.xxhash64(text).alias("h"),
        ).withColumn("k", F.coalesce(F.col("id").cast("long"), F.lit(LOW)) if dict(df.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint") else F.xxhash64("id")),
        "shard-keys",
    )
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    targets = [total * j / shards for j in range(1, shards)]
    slack = tolerance * total / shards
    cuts: list[tuple[int, int]] = []
    hot: dict[tuple[int, int], list[int]] = {}
    if total:
        for i, (key, below, n) in enumerate(_refine(rows, "h", targets, slack, probes)):
            cuts.append((key, LOW))
            if n:  # a single hash value holds more bytes than the tolerance: cut its group by id
                hot.setdefault((key, below), []).append(i)
    for (key, below), members in hot.items():
        own = [targets[i] - below for i in members]
        for i, t, (k, x, n) in zip(members, own, _refine(rows.filter(F.col("h") == F.lit(key)), "k", own, slack, probes), strict=True):
            cuts[i] = (key, k if t - x <= x + n - t else k + 1)
    h, k = F.col("h"), F.col("k")
    shard = sum(((h > F.lit(p)) | ((h == F.lit(p)) & (k >= F.lit(q)))).cast("int") for p, q in cuts) if cuts else F.lit(0)
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("part", F.pmod(F.xxhash64("k", "size"), F.lit(spread)).cast("int"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("shard", "part").orderBy("h", "k")
    numbered = placed.withColumn("nth", F.row_number().over(own))
    return numbered.join(F.broadcast(starts), ["shard", "part"]).select(  # at most shards * spread rows
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot")
    )
