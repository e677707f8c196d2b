"""Language-model scoring: a gated recurrent network over words with a class-factored softmax, trained in numpy by
truncated backpropagation on all training documents, its state carried across windows so that a document is learned and
scored as a whole.

Word counts cover every training document: they are summed in tasks, then by a shuffle. The most common words (a bounded
number) go to all tasks; what a document holds beyond them is looked up in the counts by a join. The network's own
vocabulary is the commonest words in classes of equal length; all other words form one further class, within which a
word's probability is (c + 1) / (n + v + 1) with the class's n tokens and v words, so that the whole is a distribution.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize, small_batches

END = b" "  # no word has a space
LONG = 64
GROUP = 1 << 22  # tokens that are counted at a time, and that are scored side by side
PIECE = 1 << 23  # bytes of texts that are cut into words at a time
SHORT = 1 << 14  # bytes of a text that isn't long
MOST, LEAST = np.float32(75), np.float32(1e-37)  # bounds of scores, whose exponentials are summed in single precision


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of at most PIECE bytes, or of one text."""
    ends, lo = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64), 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, PIECE + (ends[lo - 1] if lo else 0), "right")))
        yield lo, hi
        lo = hi


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of all texts, one after another, and how many of them each text has; ends are not among them.
    A null text is empty; a very long word is stood for by its digest."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    plain = pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), 0, texts.offset)  # ASCII functions look at bytes alone
    lists = pc.ascii_split_whitespace(pc.ascii_lower(plain))
    flat, cuts = lists.flatten(), lists.offsets.to_numpy()
    words = pa.Array.from_buffers(pa.binary(), len(flat), flat.buffers(), 0, flat.offset)
    size, many = pc.binary_length(words).to_numpy(), np.diff(cuts).astype(np.int64)
    if not size.all():  # blanks at a text's ends give empty words
        real = size > 0
        many = np.diff(np.append(0, np.cumsum(real))[cuts - cuts[0]])
        words, size = words.filter(pa.array(real)), size[real]
    if size.max(initial=0) > LONG:
        long = pa.array(size > LONG)
        digests = [b" " + xxhash.xxh3_128_digest(w.as_py()) for w in words.filter(long)]
        words = pc.replace_with_mask(words, long, pa.array(digests, pa.binary()))
    return words, many


def numbered(words: pa.Array, known: pa.Array, other: int) -> np.ndarray:
    """Places in `known`, else other."""
    return pc.fill_null(pc.index_in(words, value_set=known), other).to_numpy()


def with_ends(numbers: np.ndarray, many: np.ndarray, end: int) -> np.ndarray:
    """Numbers of the words of all texts, each text's followed by its end."""
    return np.insert(numbers, np.cumsum(many), end)


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) over all rows. Tasks sum over GROUP words and pass on what they have."""

    def counted(held, ends):
        found = pc.value_counts(pa.chunked_array(held, pa.binary()))
        return pa.RecordBatch.from_arrays([pa.concat_arrays([found.field(0), pa.array([END], pa.binary())]), pa.concat_arrays([found.field(1), pa.array([ends], pa.int64())])], ["word", "c"])

    def run(batches):
        held, ends = [], 0
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                held.append(words_of(batch.column(0)[lo:hi])[0])
                ends += hi - lo
                if sum(map(len, held)) >= GROUP:
                    yield counted(held, ends)
                    held, ends = [], 0
        if ends:
            yield counted(held, ends)

    return small_batches(df.select(F.col(text_col).cast("binary").alias("t"))).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Network:
    """words: size of the network's own vocabulary, in classes of `each`; input words + 0 is any other word, + 1 the start."""

    def __init__(self, words: int, hidden: int = 16, each: int = 64, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.words, self.h, self.each, self.classes = words, hidden, each, -(-words // each)
        self.p = {
            "e": rng.normal(0, 0.1, (words + 2, 3 * hidden)), "u": rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)), "b": np.zeros(3 * hidden),
            "cw": rng.normal(0, 0.1, (hidden, self.classes + 1)), "cb": np.zeros(self.classes + 1), "w": rng.normal(0, 0.1, (self.classes, hidden, each)), "wb": np.zeros((self.classes, each)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        if words % each:
            self.p["wb"][-1, words % each :] = -1e4

    def start(self, counts: np.ndarray, rest: int) -> None:
        """Biases that give the unigram distribution."""
        mass = np.zeros(self.classes * self.each)
        mass[: self.words] = counts + 1.0
        by = mass.reshape(self.classes, self.each)
        self.p["cb"][:] = np.log(np.append(by.sum(axis=1), rest + 1.0) / (mass.sum() + rest + 1.0))
        self.p["wb"][:] = np.where(by > 0, np.log(np.maximum(by, 1e-9) / by.sum(axis=1, keepdims=True)), -1e4)

    def states(self, inputs: np.ndarray, state: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each of the inputs (steps, lanes). keep takes states before, gates, candidates and their products.

        Both gates and the candidate lie apart, so that each pass over one of them runs through memory in order.
        """
        h, (steps, lanes) = self.h, inputs.shape
        half = np.repeat(np.array([0.5, 0.5, 1], np.float32), h)  # halves of the sigmoids' arguments
        table, u = _thirds((self.p["e"] + self.p["b"]) * half, h), _thirds(self.p["u"] * half, h)
        x, ids = np.empty((3, steps, lanes, h), np.float32), inputs.astype(np.intp, copy=False)
        for k in range(3):
            table[k].take(ids, axis=0, out=x[k], mode="clip")
        every = np.empty((steps + 1, lanes, h), np.float32)
        every[0] = state
        y, c = np.empty((3, lanes, h), np.float32), np.empty((lanes, h), np.float32)
        products = np.empty((steps, lanes, h), np.float32) if keep is not None else None
        for t in range(steps):
            state, new, g, cand = every[t], every[t + 1], x[:2, t], x[2, t]
            np.matmul(state, u, out=y)
            g += y[:2]
            np.tanh(g, out=g)
            g += 1
            g *= 0.5
            np.multiply(g[1], y[2], out=c)
            cand += c
            np.tanh(cand, out=cand)
            if products is not None:
                products[t] = y[2]
            np.subtract(state, cand, out=new)
            new *= g[0]
            new += cand
        if keep is not None:
            keep += [every[:-1], x[:2], x[2], products]
        return every[1:]

    def log_probs(self, flat: np.ndarray, targets: np.ndarray, real: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probability of each target after each state; a target >= words counts as its class alone.

        Rows are sorted by class once. A softmax's rows stay unscaled: their gradients are scaled on the side of the states,
        which is narrower, and biases are the weights of a state's last component, which is 1.
        """
        p, n, h, each = self.p, len(flat), self.h, self.each
        cls = np.where(targets < self.words, targets // each, self.classes)
        order = np.argsort(_short(cls, self.classes), kind="stable")
        cls, slot = cls.take(order), targets.take(order) % each
        cuts = np.searchsorted(cls, np.arange(self.classes + 1))
        own, lines = np.empty((n, h + 1), np.float32), np.arange(n)
        own[:, :h], own[:, h] = flat.take(order, axis=0), 1
        weight = real.take(order) if grads is not None else None
        high = max(1.0, float(np.abs(flat).max(initial=0)))

        def softmax(x, full, targets, weight, bounded):
            """Scores of the targets, their totals, gradients of the weights and of the states."""
            e, at = x @ full, targets + lines[: len(x)] * full.shape[1]
            if not bounded:
                np.minimum(e, MOST, out=e)
            line = e.reshape(-1)
            picked = line.take(at)
            np.exp(e, out=e)
            total = np.maximum(e @ np.ones(full.shape[1], np.float32), LEAST)
            if weight is None:
                return picked, total, None, None
            line[at] -= total
            scale = (weight / total)[:, None]
            back = e @ np.ascontiguousarray(full[:h].T)
            back *= scale
            return picked, total, (x * scale).T @ e, back

        full = np.vstack([p["cw"], p["cb"]])
        out, total, g, back = softmax(own, full, cls, weight, _bound(full, high) <= MOST)
        out -= np.log(total)
        if grads is not None:
            grads["cw"], grads["cb"] = g[:h], g[h]
            grads["w"], grads["wb"] = np.zeros_like(p["w"]), np.zeros_like(p["wb"])
        words = np.concatenate([p["w"], p["wb"][:, None, :]], axis=1)
        bounds = _bound(words, high)
        totals = np.ones(n, np.float32)
        for k in range(self.classes):
            a, b = cuts[k], cuts[k + 1]
            if a == b:
                continue
            picked, totals[a:b], g, more = softmax(own[a:b], words[k], slot[a:b], None if weight is None else weight[a:b], bounds[k] <= MOST)
            out[a:b] += picked
            if grads is not None:
                grads["w"][k], grads["wb"][k] = g[:h], g[h]
                back[a:b] += more
        out -= np.log(totals)
        result = np.empty_like(out)
        result[order] = out
        if grads is None:
            return result, None
        unsorted = np.empty_like(back)
        unsorted[order] = back
        return result, unsorted

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, real: np.ndarray, state: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Loss a token, gradients cut off at the window's start, and the last state."""
        kept: list = []
        states, h = self.states(inputs, state, kept), self.h
        grads: dict = {}
        weight = real.reshape(-1).astype(np.float32)
        lp, back = self.log_probs(states.reshape(-1, h), targets.reshape(-1), weight, grads)
        count = max(1.0, float(weight.sum()))
        back = back.reshape(states.shape)
        before, (z, r), c, yc = kept
        # all that a step back multiplies the state's gradient by, for the gates, the candidate's product with the state, and the candidate
        factors, cand = np.empty((3, *inputs.shape, h), np.float32), 1 - z
        np.subtract(before, c, out=factors[0])
        factors[0] *= cand
        factors[0] *= z
        cand *= 1 - c * c
        np.multiply(cand, r, out=factors[2])
        np.multiply(factors[2], yc, out=factors[1])
        factors[1] *= 1 - r
        rec, ds_all, ut = np.empty_like(factors), np.empty_like(cand), np.ascontiguousarray(_thirds(self.p["u"], h).transpose(0, 2, 1))
        ds, parts = np.zeros_like(state), np.empty((3, *state.shape), np.float32)
        for t in range(len(inputs) - 1, -1, -1):
            own = ds_all[t]
            np.add(ds, back[t], out=own)
            np.multiply(own, factors[:, t], out=rec[:, t])
            np.matmul(rec[:, t], ut, out=parts)
            np.multiply(own, z[t], out=ds)
            for part in parts:
                ds += part
        flat = before.reshape(-1, h).T
        grads["u"] = np.concatenate([flat @ x.reshape(-1, h) for x in rec], axis=1)
        np.multiply(ds_all, cand, out=rec[2])
        ids = inputs.reshape(-1)
        order = np.argsort(_short(ids, self.words + 1), kind="stable")
        rows = np.concatenate([x.reshape(-1, h).take(order, axis=0) for x in rec], axis=1)
        grads["e"] = np.zeros_like(self.p["e"])
        cuts = np.searchsorted(ids.take(order), np.arange(self.words + 3))
        ones, few = np.ones((1, len(rows)), np.float32), min(32, self.words)
        for k in (*range(few), self.words, self.words + 1):  # the commonest words, any other word and the start have long sums
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                grads["e"][k] = (ones[:, : b - a] @ rows[a:b])[0]
        names = few + np.flatnonzero(cuts[few : self.words] < cuts[few + 1 : self.words + 1])
        if len(names):
            grads["e"][names] = np.add.reduceat(rows[: cuts[self.words]], cuts[names], axis=0)
        grads["b"] = grads["e"].sum(axis=0)
        for x in grads.values():
            x /= np.float32(count)
        return float(-(lp * weight).sum() / count), grads, states[-1]

    def start_training(self) -> np.ndarray:
        """What training carries on from: weights, both of Adam's moments and its number of steps, in one vector."""
        flat = np.concatenate([x.reshape(-1) for x in self.p.values()])
        return np.concatenate([flat, np.zeros(2 * len(flat) + 1, np.float32)])

    def _parts(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        cuts = np.cumsum([x.size for x in self.p.values()])[:-1]
        return {k: part.reshape(x.shape).copy() for (k, x), part in zip(self.p.items(), np.split(flat, cuts), strict=True)}

    def load(self, vector: np.ndarray) -> None:
        self.p = self._parts(vector[: len(vector) // 3])

    def fit(self, texts: list[np.ndarray], vector: np.ndarray, lanes: int = 512, window: int = 16, rate: float = 0.01, seed: int = 5) -> tuple[np.ndarray, int]:
        """Adam over windows of the whole texts, from where `vector` left off; each lane reads text after text, its state
        carried on within a text. Returns the vector afterwards and the number of tokens trained. A window of fewer tokens
        than full lanes hold takes a step shorter in proportion."""
        size = len(vector) // 3
        self.load(vector)
        m, v, step = self._parts(vector[size : 2 * size]), self._parts(vector[2 * size : -1]), int(vector[-1])
        state, seen = np.zeros((0, self.h), np.float32), 0
        queues = dealt([len(t) for t in texts], lanes, seed)
        for inputs, targets, real, fresh, _, still in windows(texts, len(queues), window, self.words, queues):
            state = state[still] if len(state) else np.zeros((len(fresh), self.h), np.float32)
            state = np.where(fresh[:, None], np.float32(0), state)
            _, g, state = self.gradients(inputs, targets, real, state)
            step += 1
            tokens = int(real.sum())
            seen += tokens
            norm = math.sqrt(sum(float(np.vdot(x, x)) for x in g.values()))
            share = tokens / (len(queues) * window)
            clip, pace = np.float32(min(1, 1 / max(norm, 1e-9))), np.float32(share * rate * math.sqrt(1 - 0.999**step) / (1 - 0.9**step))
            for k, x in g.items():  # in place: m += 0.1 (x - m), v += 0.001 (x x - v), p -= pace m / (sqrt(v) + 1e-8)
                x *= clip
                d = x - m[k]
                d *= np.float32(0.1)
                m[k] += d
                x *= x
                x -= v[k]
                x *= np.float32(0.001)
                v[k] += x
                np.sqrt(v[k], out=x)
                x += np.float32(1e-8)
                np.divide(m[k], x, out=x)
                x *= pace
                self.p[k] -= x
        flat = [x.reshape(-1) for part in (self.p, m, v) for x in part.values()]
        return np.concatenate([*flat, np.array([step], np.float32)]), seen

    def score(self, texts: list[np.ndarray], lanes: int = 512, window: int = 16) -> np.ndarray:
        """Natural log-probability of each whole text (its words outside the vocabulary as their class alone)."""
        out, state = np.zeros(len(texts)), np.zeros((0, self.h), np.float32)
        order = np.array(sorted(range(len(texts)), key=lambda i: -len(texts[i])), np.int64)
        for inputs, targets, real, fresh, owner, still in windows([texts[i] for i in order], lanes, window, self.words):
            state = state[still] if len(state) else np.zeros((len(fresh), self.h), np.float32)
            state = np.where(fresh[:, None], np.float32(0), state)
            states = self.states(inputs, state)
            lp, _ = self.log_probs(states.reshape(-1, self.h), targets.reshape(-1), real.reshape(-1))
            out[order[owner]] += np.where(real, lp.reshape(real.shape), 0).sum(axis=0, dtype=np.float64)  # each lane has a text of its own
            state = states[-1]
        return out


def _thirds(matrix: np.ndarray, h: int) -> np.ndarray:
    """(rows, 3 h) as (3, rows, h)."""
    return np.ascontiguousarray(matrix.reshape(len(matrix), 3, h).transpose(1, 0, 2))


def _short(values: np.ndarray, most: int) -> np.ndarray:
    """The values, none above `most`, in 16 bits where they fit, which are sorted by radix."""
    return values.astype(np.uint16) if most < 1 << 16 else values


def _bound(weights: np.ndarray, high: float) -> np.ndarray:
    """What scores can't exceed: of weights (..., components, scores), the last component 1 and the others `high` at most."""
    return (np.abs(weights[..., :-1, :]).sum(axis=-2) * high + weights[..., -1, :]).max(axis=-1)


def dealt(lengths: list[int], lanes: int, seed: int) -> list[list[int]]:
    """Texts of each lane: lanes of nearly equal length, no more of them than keep each as long as the longest text; the
    texts of a lane in random order."""
    lanes = max(1, min(lanes, len(lengths), sum(lengths) // max(lengths, default=1)))
    out: list[list[int]] = [[] for _ in range(lanes)]
    heap = [(0, k) for k in range(lanes)]
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        load, k = heap[0]
        out[k].append(i)
        heapq.heapreplace(heap, (load + lengths[i], k))
    rng = np.random.default_rng(seed)
    return [[x[i] for i in rng.permutation(len(x))] for x in out if x]


def windows(texts: list[np.ndarray], lanes: int, window: int, words: int, queues: list[list[int]] | None = None):
    """Windows (steps, lanes) of inputs, targets, which are real, which lanes begin a text, the text of each lane, and the
    lanes of the window before that are still there; lanes without text go.

    queues: the texts of each lane; by default a lane takes the next text that no other has taken.
    """
    own = [iter(q) for q in queues] if queues is not None else [iter(range(len(texts)))] * min(lanes, len(texts))
    size = np.array([len(t) for t in texts], np.int64)
    starts, flat = np.cumsum(size) - size, np.concatenate([*texts, np.zeros(0, np.int32)]).astype(np.int32)
    text = np.array([next(q) for q in own], np.int64)
    at, steps, still = np.zeros(len(text), np.int64), np.arange(window)[:, None], np.arange(len(text))
    while len(text):
        place = starts[text] + at + steps
        real = at + steps < size[text]
        targets = np.where(real, flat.take(place, mode="clip"), words)
        inputs = np.where(real & (at + steps > 0), flat.take(place - 1, mode="clip"), words + 1)
        yield inputs, targets, real, at == 0, text, still
        at = at + window
        for k in np.flatnonzero(at >= size[text]).tolist():
            text[k], at[k] = next(own[k], -1), 0
        still = np.flatnonzero(text >= 0)
        if len(still) < len(text):
            own = [own[k] for k in still.tolist()]
        text, at = text[still], at[still]


class Scorer:
    """What all tasks get: the common words with their counts, totals, and the network. Its size is bounded."""

    def __init__(self, words: list[bytes], counts: np.ndarray, n: int, v: int, network: Network):
        self.words, self.counts, self.n, self.v, self.network = words, counts, n, v, network
        self.trained = 0  # tokens that the network was trained on, over all passes
        self.rest = max(0, n - int(counts[: network.words].sum())) + max(0, v - network.words) + 1


def build(df: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", common: int = 200_000, vocabulary: int = 1024, shard: int = 1 << 20) -> tuple[Scorer, DataFrame]:
    """Counts over all training rows, and a network trained on all tokens of all of them, in whole texts (see train).
    Returns the scorer and the counts table."""
    rows = df.filter(train)
    counts = materialize(word_counts(rows, text_col), "word-counts")
    total = counts.agg(F.sum("c"), F.count("*")).first()
    n, v = int(total[0] or 0), int(total[1])
    steps = sorted(((r[0], r[1]) for r in counts.groupBy(F.floor(F.log2("c") * 8).alias("s")).agg(F.count("*")).collect()), reverse=True)
    floor, have = None, 0
    for s, k in steps:
        if have + k > common:
            break
        floor, have = s, have + k
    head = counts.filter(F.floor(F.log2("c") * 8) >= floor).collect() if floor is not None else []
    head = sorted(((bytes(r["word"]), r["c"]) for r in head), key=lambda x: (x[0] != END, -x[1], x[0]))
    words, c = [w for w, _ in head], np.array([k for _, k in head], np.int64)
    network = Network(max(1, min(vocabulary, len(words))))
    scorer = Scorer(words, c, n, v, network)
    if len(words):
        network.start(c[: network.words], max(0, n - int(c[: network.words].sum())))
        scorer.trained = train_network(rows, network, words[: network.words], n, id_col, text_col, shard)
    return scorer, counts


def train_network(rows: DataFrame, network: Network, words: list[bytes], n: int, id_col: str, text_col: str, shard: int, enough: int = 1_700_000, pieces: int = 16) -> int:
    """Train on every token of the rows, n in all; returns the number of tokens trained.

    Texts are dealt by a hash of id and text into shards of about `shard` tokens, long texts into shards of their own by
    class of length, so that a shard's texts can be read side by side; shards are dealt into rounds. Each shard is trained
    in a task of its own, from the weights that the round before ended with; a round ends with the average of its shards'
    weights and moments, weighted by tokens, which is summed in pieces and in two steps. The number of shards grows with
    n, what a task holds doesn't. Of few tokens, under `enough`, up to three passes are made, and else one.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0))
    kind = F.when(size <= SHORT, 0).otherwise(F.floor(F.log2(size.cast("double") / SHORT)) + 1).cast("int")
    weights = {r["c"]: r["n"] for r in rows.groupBy(kind.alias("c")).agg(F.sum(size + 1).alias("n")).collect()}
    first, many, shards = [F.lit(0)] * (max(weights) + 1), [F.lit(1)] * (max(weights) + 1), 0
    for c, w in weights.items():
        own = max(1, -(-n * w // (shard * sum(weights.values()))))
        first[c], many[c], shards = F.lit(shards), F.lit(own), shards + own
    rounds = max(1, min(32, shards // 6))
    per = -(-shards // rounds)
    shared = rows.sparkSession.sparkContext.broadcast(words)
    stored = np.uint16 if len(words) < 1 << 16 else np.int32

    def encode(batches):
        own, other = pa.array(shared.value, pa.binary()), len(shared.value)
        end = shared.value.index(END) if END in shared.value else other
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                found, many = words_of(batch.column(1)[lo:hi])
                data = with_ends(numbered(found, own, other), many, end).astype(stored)
                cuts = np.append(0, np.cumsum(many + 1)) * data.itemsize
                out = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], out, batch.column(2)[lo:hi]], ["k", "t", "shard"])

    key = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(9))
    place = F.element_at(F.array(*first), kind + 1) + F.pmod(key, F.element_at(F.array(*many), kind + 1))
    texts = rows.select(key.alias("k"), F.col(text_col).cast("binary").alias("t"), place.cast("int").alias("shard")).mapInArrow(encode, "k long, t binary, shard int")
    texts = materialize(texts.select("k", "t", "shard", F.pmod("shard", F.lit(rounds)).alias("round")), "lm-tokens", by="round")
    vector, trained = network.start_training(), 0
    schema = "shard int, piece int, tokens long, part binary"

    for turn in range(max(1, min(3, -(-enough // n)))):
        for r in range(rounds):
            held = rows.sparkSession.sparkContext.broadcast((network, vector))

            def learn(table: pa.Table) -> pa.Table:
                net, start = held.value
                order = table.sort_by([("k", "ascending"), ("t", "ascending")])
                after, seen = net.fit([np.frombuffer(t.as_py(), stored) for t in order["t"]], start, seed=5 + turn)
                parts = [p.tobytes() for p in np.array_split(after, pieces)]
                return pa.table({"shard": pa.array([order["shard"][0].as_py()] * pieces, pa.int32()), "piece": pa.array(range(pieces), pa.int32()), "tokens": pa.array([seen] * pieces, pa.int64()), "part": pa.array(parts, pa.binary())})

            learnt = texts.filter(F.col("round") == r).select("k", "t", "shard").groupBy("shard").applyInArrow(learn, schema)
            if per > 32:
                learnt = learnt.withColumn("shard", F.col("shard") % 32).groupBy("piece", "shard").applyInArrow(averaged, schema)
            ends = sorted(learnt.groupBy("piece").applyInArrow(averaged, schema).collect(), key=lambda x: x["piece"])
            held.destroy()
            if ends:  # a round of few texts may have none
                vector = np.concatenate([np.frombuffer(x["part"], np.float32) for x in ends])
                trained += ends[0]["tokens"]
    discard(texts)
    network.load(vector)
    return trained


def averaged(table: pa.Table) -> pa.Table:
    """One row of rows of (shard, piece, tokens, part): the parts' average, weighted by tokens."""
    total, weight = 0.0, 0
    for tokens, _, part in sorted(zip(table["tokens"].to_pylist(), table["shard"].to_pylist(), table["part"].to_pylist(), strict=True), key=lambda x: x[1]):
        total, weight = total + np.frombuffer(part, np.float32).astype(np.float64) * tokens, weight + tokens
    return pa.table({"shard": table["shard"][:1], "piece": table["piece"][:1], "tokens": pa.array([weight], pa.int64()), "part": pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())})


def score_documents(df: DataFrame, scorer: Scorer, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score, score of each whole text.

    A null or empty text is its end alone. Rows map one to one, repeated ids included. Other columns are ignored,
    whatever their names. With no training rows at all every token is unknown and has probability 1.
    """
    shared = df.sparkSession.sparkContext.broadcast(scorer)
    kind = dict(df.dtypes)[id_col]
    fields = ["key", "id", "word", "times", "tokens", "known", "base", "score"]

    def run(batches):
        s = shared.value
        top, logs, net = pa.array(s.words, pa.binary()), np.append(np.log10(s.counts + 1.0), 0.0), s.network
        end = s.words.index(END) if END in s.words else -1
        norm, rest = math.log10(s.n + s.v + 1), math.log10(s.rest)

        def rows(*cols):
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], fields)

        def beyond(key, kind, words, parent):
            """Words to be looked up by the join, each once for a text."""
            own = words.dictionary_encode()
            pairs, times = np.unique(parent * len(own.dictionary) + own.indices.to_numpy(), return_counts=True)
            parent, word = np.divmod(pairs, len(own.dictionary))
            none = np.zeros(len(pairs), np.int64)
            return rows(key.take(pa.array(parent)), pa.nulls(len(pairs), kind), own.dictionary.take(pa.array(word)), times, none, none, none.astype(float), none.astype(float))

        def packed(texts, held):
            key, ident = (pa.concat_arrays([x[i] for x in held]) for i in (0, 1))
            tokens, known, base, extra = (np.concatenate([x[i] for x in held]) for i in range(2, 6))
            apart = pa.array([b" d%d" % k for k in key.to_pylist()], pa.binary())  # no word is like that
            return rows(key, ident, apart, np.zeros(len(key), np.int64), tokens, known, base, extra + net.score(texts) / math.log(10))

        texts, held, size = [], [], 0
        for batch in batches:
            kind = batch.schema.field(1).type
            for lo, hi in slices(batch.column(2)):
                key, ident = batch.column(0)[lo:hi], batch.column(1)[lo:hi]
                words, many = words_of(batch.column(2)[lo:hi])
                at = numbered(words, top, -1)
                lost = at < 0
                if lost.any():
                    yield beyond(key, kind, words.filter(pa.array(lost)), np.repeat(np.arange(len(many)), many)[lost])
                if end < 0:
                    yield beyond(key, kind, pa.array([END] * len(many), pa.binary()), np.arange(len(many)))
                at, tokens = with_ends(at, many, end), many + 1
                starts = np.cumsum(tokens) - tokens
                inside, log = (at >= 0) & (at < net.words), logs.take(at, mode="wrap")  # 0 for what is lost
                known, near = (np.add.reduceat(x, starts, dtype=np.int64) for x in (at >= 0, inside))
                base, extra = (np.add.reduceat(x, starts) for x in (log, np.where(inside, 0.0, log)))
                texts += np.split(np.where(inside, at, np.int32(net.words)), starts[1:])
                held.append((key, ident, tokens, known, base - norm * tokens, extra - rest * (tokens - near)))
                size += len(at)
                if size >= GROUP:
                    yield packed(texts, held)
                    texts, held, size = [], [], 0
        if texts:
            yield packed(texts, held)

    rows = df.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    parts = rows.mapInArrow(run, f"key long, id {kind}, word binary, times long, tokens long, known long, base double, score double")
    joined = parts.join(counts, "word", "left").select("*", (F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))).alias("more"))
    return joined.groupBy("key").agg(
        F.max("id").alias(id_col),
        F.sum("tokens").alias("n_tokens"),
        (F.sum("known") + F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0))).alias("n_known"),
        (F.sum("base") + F.sum("more")).alias("base_score"),
        (F.sum("score") + F.sum("more")).alias("score"),
    ).drop("key")
