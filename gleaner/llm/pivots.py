"""Embedding near-dedup by a pivot-permutation index: each vector is described by its nearest reference points in order,
candidates come from inverted pivot lists by their count of shared pivots, and are verified by cosine in double precision.

Equal vectors are one vector from the start, with their number. Of k pivots of each vector a pair must share s, so one of
them is among the first k - s + 1 of both vectors in any fixed order of the pivots: a vector stands in the lists of these
alone, and the order puts pivots with short lists first. A list holds permutations, no vectors. It is dealt into blocks of
bounded length; pairs of blocks are tasks' units, so a list of any length is spread. A pair is looked at where its first
shared pivot is. Vectors go only to units in which they have candidates. Only counts and a spanning set of links leave a
unit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, local_labels
from .shared import discard, materialize


def choose_pivots(sample: np.ndarray, count: int, apart: tuple[float, ...] = (0.7, 0.75, 0.8, 0.85)) -> np.ndarray:
    """The first vectors of a sample (unit length) that are no nearer than `apart` to any chosen before; while there are too
    few, again with the next bound. Pivots nearer than the last bound would tell apart vectors that link, so there may be
    fewer than count; others fill up to eight alone. Looked at in blocks."""
    chosen, left = np.zeros((0, sample.shape[1])), np.arange(len(sample))
    for bound in apart:
        spare = []
        for at in range(0, len(left), 256):
            part = sample[left[at : at + 256]]
            far = (part @ chosen.T).max(axis=1, initial=-1) < bound
            own: list[int] = []
            alike = part @ part.T
            for i in range(len(part)):
                if far[i] and (not own or alike[i, own].max() < bound):
                    own.append(i)
                else:
                    spare.append(left[at + i])
            chosen = np.concatenate([chosen, part[own]])
            if len(chosen) >= count:
                return chosen[:count]
        left = np.array(spare, np.int64)
    return np.concatenate([chosen, sample[left[: max(0, min(count, 8) - len(chosen))]]])


def nearest_pivots(unit: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k nearest pivots of each vector, nearest first."""
    scores = unit @ pivots.T
    k = min(k, len(pivots))
    top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    own = np.take_along_axis(scores, top, axis=1)
    return np.take_along_axis(top, np.lexsort((top, -own), axis=1), axis=1).astype(np.int32)


def unit_vectors(rows: np.ndarray) -> np.ndarray:
    """Rows in double precision, of length 1."""
    x = rows.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sharing(perm: np.ndarray, left: np.ndarray, right: np.ndarray, pivot: int, shared: int) -> np.ndarray:
    """Which pairs of left and right share at least so many pivots, and none before this one. A vector isn't paired with
    itself, and a pair of one block comes in both directions."""
    numbers, at = np.unique(perm, return_inverse=True)
    marks = np.zeros((len(perm), len(numbers)), np.float32)
    marks[np.arange(len(perm))[:, None], at.reshape(perm.shape)] = 1
    before = int(np.searchsorted(numbers, pivot))
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    here = (marks[a] @ marks[b].T >= min(shared, perm.shape[1])) & (marks[a, :before] @ marks[b, :before].T < 0.5)
    return here & (a[:, None] != b[None, :])


def linked_pairs(unit: np.ndarray, left: np.ndarray, right: np.ndarray, here: np.ndarray, least: float) -> np.ndarray:
    """Those of the pairs that have at least this cosine."""
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    out = np.zeros_like(here)
    i, j = np.nonzero(here)
    step = max(1, 4_000_000 // unit.shape[1])
    for at in range(0, len(i), step):
        p, q = i[at : at + step], j[at : at + step]
        out[p, q] = np.einsum("ij,ij->i", unit[a[p]], unit[b[q]]) >= least
    return out


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95, nearest: int = 8, shared: int = 4, pivots: int | None = None, block: int = 512) -> DataFrame:
    """One row for each input row: id, n_links, component_id, kept (id = component_id).

    A vector that is null, empty, zero or holds null or non-finite components links with nothing: 0, its own id, true.
    Vectors of each length have pivots and lists of their own, and link with vectors of that length. Ids are of one
    integer type; rows of one id are each linked by their own vector; a null id gets its class's component and kept is
    null. Other columns are ignored, whatever their names.
    pivots: by default twice the square root of the number of vectors of a length (16 to 8,192), chosen from a hash sample
    of four times as many, which comes to the driver. Every row is indexed; candidates share at least `shared` of
    `nearest` pivots.
    """
    kind, element = dict(df.dtypes)[id_col], np.float32 if dict(df.dtypes)[vec_col] == "array<float>" else np.float64

    def read(batches):
        for batch in batches:
            out: list[tuple] = []
            for v in batch.column(1).to_pylist():
                x = np.array([np.nan if y is None else y for y in v], element) if v else np.zeros(0)
                if len(x) and np.isfinite(x).all() and x.any():
                    d = xxhash.xxh3_128_digest(x.tobytes())
                    out.append((len(x), x.tobytes(), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
                else:
                    out.append((0, None, None, None))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.binary(), pa.int64(), pa.int64()], strict=True)]], ["id", "dim", "vec", "x", "x2"])

    base = materialize(df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).mapInArrow(read, f"id {kind}, dim int, vec binary, x long, x2 long"), "vectors")
    classes = base.filter("dim > 0").groupBy("x", "x2").agg(F.min("id").alias("rep"), F.count("*").alias("times"), F.first("vec").alias("vec"), F.first("dim").alias("dim"))
    classes = materialize(classes, "vector-classes")
    dims = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    points = _points(classes, dims, pivots, element, nearest)
    held = df.sparkSession.sparkContext.broadcast(points)  # at most 8,192 vectors of a length

    def describe(batches):
        for batch in batches:
            dim = batch.column(2).to_numpy()
            for d in np.unique(dim).tolist():
                part = batch.take(pa.array(np.flatnonzero(dim == d)))
                unit = unit_vectors(np.frombuffer(b"".join(part.column(1).to_pylist()), element).reshape(-1, d))
                perm = nearest_pivots(unit, held.value[d], nearest)
                lists = np.sort(perm, axis=1)[:, : perm.shape[1] - min(shared, perm.shape[1]) + 1]
                again = pa.array(np.repeat(np.arange(len(unit)), lists.shape[1]))
                packed = pa.array([p.tobytes() for p in perm], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(2).take(again), pa.array(lists.reshape(-1)), part.column(0).take(again), packed.take(again)], ["dim", "pivot", "x", "perm"])

    lists = materialize(classes.select("x", "vec", "dim").mapInArrow(describe, "dim int, pivot int, x long, perm binary"), "pivot-lists")
    lengths = materialize(lists.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "pivot-lengths")
    dealt = lists.join(lengths, ["dim", "pivot"]).withColumn("own", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    units = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def permutations(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = table["own"].to_numpy()
        left, right = own == table["i"][0].as_py(), own == table["j"][0].as_py()
        return np.frombuffer(b"".join(table["perm"].to_pylist()), np.int32).reshape(len(own), -1), left, right

    def count(table: pa.Table) -> pa.Table:
        perm, left, right = permutations(table)
        here = sharing(perm, left, right, table["pivot"][0].as_py(), shared)
        some = np.zeros(len(perm), bool)
        some[np.flatnonzero(left)] |= here.any(axis=1)
        some[np.flatnonzero(right)] |= here.any(axis=0)
        return table.filter(pa.array(some))

    def verify(table: pa.Table) -> pa.Table:
        perm, left, right = permutations(table)
        x, times = table["x"].to_numpy(), table["times"].to_numpy()
        here = sharing(perm, left, right, table["pivot"][0].as_py(), shared)
        unit = unit_vectors(np.frombuffer(b"".join(table["vec"].to_pylist()), element).reshape(len(x), -1))
        linked = linked_pairs(unit, left, right, here, least)
        found, a, b = np.zeros(len(x), np.int64), np.flatnonzero(left), np.flatnonzero(right)
        found[a] += linked @ times[b]
        if table["i"][0].as_py() != table["j"][0].as_py():
            found[b] += times[a] @ linked
        at = np.flatnonzero(found)
        return pa.table({"a": x[at], "b": local_labels(x, a, b, linked)[at], "found": found[at]})

    unit_key = ["dim", "pivot", "i", "j"]
    candidates = units.select(*unit_key, "x", "own", "perm").groupBy(*unit_key).applyInArrow(count, "dim int, pivot int, i int, j int, x long, own int, perm binary")
    candidates = materialize(candidates, "pivot-candidates")
    links = candidates.join(classes.select("x", "vec", "times"), "x").groupBy(*unit_key).applyInArrow(verify, "a long, b long, found long")
    links = materialize(links, "vector-links")
    counts = links.groupBy("a").agg(F.sum("found").alias("found"))
    reached = materialize(components(links.select("a", "b")), "vector-reached")
    named = classes.join(counts, F.col("x") == F.col("a"), "left").join(reached, F.col("x") == F.col("node"), "left")
    named = materialize(named.select("x", "x2", "rep", (F.coalesce("found", F.lit(0)) + F.col("times") - 1).alias("found"), F.coalesce("component", "x").alias("label")), "vector-named")
    names = materialize(named.groupBy("label").agg(F.min("rep").alias("least")), "vector-names")
    named = materialize(named.join(names, "label").select("x", "x2", "found", "least"), "vector-named")
    out = materialize(base.select("id", "x", "x2"), "vector-ids")
    discard(base, classes, lists, lengths, candidates, links, reached, names)
    component = F.coalesce("least", F.col("id")).cast("long")
    return out.join(named, ["x", "x2"], "left").select(F.col("id").alias(id_col), F.coalesce("found", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def _points(classes: DataFrame, dims: dict[int, int], pivots: int | None, element: type, nearest: int) -> dict[int, np.ndarray]:
    """The reference points of each length, those that are near to the fewest vectors of the sample first."""
    counts = {d: pivots or int(min(8_192, max(16, 2 * n**0.5))) for d, n in dims.items()}
    cuts = classes.sparkSession.createDataFrame([(d, int((1 << 40) * min(1.0, 4 * counts[d] / n))) for d, n in dims.items()], "dim int, cut long")
    drawn: dict[int, list] = {}
    for r in classes.select("x", "vec", "dim").join(cuts, "dim").filter(F.pmod(F.xxhash64("x", F.lit(3)), F.lit(1 << 40)) < F.col("cut")).collect():
        drawn.setdefault(r["dim"], []).append((xxhash.xxh3_64_intdigest(str(r["x"]).encode()), r["vec"]))
    out = {}
    for d in dims:
        sample = unit_vectors(np.frombuffer(b"".join(v for _, v in sorted(drawn[d])), element).reshape(-1, d)) if d in drawn else np.eye(1, d)
        points = choose_pivots(sample, counts[d])
        near = np.bincount(np.concatenate([nearest_pivots(sample[at : at + 4096], points, nearest).reshape(-1) for at in range(0, len(sample), 4096)]), minlength=len(points))
        out[d] = points[np.argsort(near, kind="stable")]
    return out


#: DuckDB SQL for the rows of near_vectors with the defaults, by looking at all pairs.
SQL = r"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS n, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
o AS MATERIALIZED (SELECT n, vec_id, e, len(e) AS dim FROM v WHERE len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in e if x <> 0]) > 0),
l AS MATERIALIZED (SELECT a.n AS a, b.n AS b FROM o a JOIN o b ON a.dim = b.dim AND a.n < b.n WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
x AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT n AS a, n AS b FROM o UNION SELECT c.a, x.b FROM c JOIN x ON c.b = x.a),
k AS (SELECT c.a AS n, min(o.vec_id) AS component_id FROM c JOIN o ON o.n = c.b GROUP BY c.a),
h AS (SELECT a AS n, count(*) AS n_links FROM x GROUP BY a)
SELECT v.vec_id, coalesce(h.n_links, 0) AS n_links, coalesce(k.component_id, v.vec_id) AS component_id, v.vec_id = coalesce(k.component_id, v.vec_id) AS kept
FROM v LEFT JOIN h ON h.n = v.n LEFT JOIN k ON k.n = v.n
"""
