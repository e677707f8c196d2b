"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation
through time; it labels every byte, and a document's probabilities are the mean over all its bytes.

A text is cut into windows of a fixed number of bytes, each read in both directions from a zero state, so windows of
many texts form one batch and a text of any length needs constant memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

WINDOW = 64
LANES = 1024
_LETTER = re.compile(r"[^\W\d_]")


class ByteTagger:
    """Gates in the order update, reset, candidate; both directions side by side: 2 * hidden columns a gate."""

    def __init__(self, langs: list[str], hidden: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        h, self.h, self.langs = 2 * hidden, hidden, langs
        same = np.kron(np.eye(2), np.ones((hidden, hidden)))
        self.mask = np.tile(same, (1, 3)).astype(np.float32)  # no weights between the directions
        self.p = {
            "fwd": rng.normal(0, 0.3, (256, 3 * hidden)), "bwd": rng.normal(0, 0.3, (256, 3 * hidden)), "u": rng.normal(0, hidden**-0.5, (h, 3 * h)) * self.mask,
            "b": np.zeros(3 * h), "o": rng.normal(0, 0.1, (h, len(langs))), "c": np.zeros(len(langs)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _inputs(self, codes: np.ndarray, t: int) -> np.ndarray:
        out = np.empty((len(codes), 3, 2, self.h), np.float32)
        out[:, :, 0] = self.p["fwd"][codes[:, t]].reshape(-1, 3, self.h)
        out[:, :, 1] = self.p["bwd"][codes[:, -1 - t]].reshape(-1, 3, self.h)
        return out.reshape(len(codes), -1)

    def run(self, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Probabilities of each language at each byte: (rows, steps, languages). keep takes what backpropagation needs."""
        n, steps = codes.shape
        h2, u, b = 2 * self.h, self.p["u"], self.p["b"]
        state, states = np.zeros((n, h2), np.float32), np.empty((steps, n, h2), np.float32)
        for t in range(steps):
            x = self._inputs(codes, t)
            x += b
            y = state @ u
            g = x[:, : 2 * h2]
            g += y[:, : 2 * h2]
            g *= 0.5
            np.tanh(g, out=g)
            g += 1
            g *= 0.5
            z, r = g[:, :h2], g[:, h2:]
            c = np.tanh(x[:, 2 * h2 :] + r * y[:, 2 * h2 :])
            if keep is not None:
                keep.append((state, z, r, c, y[:, 2 * h2 :]))
            state = c + z * (state - c)
            states[t] = state
        both = np.concatenate([states[:, :, : self.h], states[::-1, :, self.h :]], axis=2)
        if keep is not None:
            keep.append(both)
        scores = both.reshape(-1, h2) @ self.p["o"] + self.p["c"]
        scores -= scores.max(axis=1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=1, keepdims=True)
        return scores.reshape(steps, n, -1).transpose(1, 0, 2)

    def label(self, codes: np.ndarray) -> np.ndarray:
        """run() without what training needs: halves of the sigmoids' arguments are folded into the weights."""
        n, steps = codes.shape
        h, h2, p = self.h, 2 * self.h, self.p
        half = np.repeat(np.array([0.5, 0.5, 1], np.float32), h2)
        tables = np.zeros((2, 256, 3, 2, h), np.float32)
        tables[0, :, :, 0], tables[1, :, :, 1] = p["fwd"].reshape(256, 3, h), p["bwd"].reshape(256, 3, h)
        fwd, bwd = tables.reshape(2, 256, 3 * h2) * half
        fwd = fwd + p["b"] * half
        u = p["u"] * np.float32(0.5)
        forth, back = np.ascontiguousarray(codes.T), np.ascontiguousarray(codes.T[::-1])
        x, more, y = (np.empty((n, 3 * h2), np.float32) for _ in range(3))
        a, d, state = np.empty((n, h2), np.float32), np.empty((n, h2), np.float32), np.zeros((n, h2), np.float32)
        both = np.empty((steps, n, h2), np.float32)
        for t in range(steps):
            fwd.take(forth[t], axis=0, out=x, mode="clip")
            bwd.take(back[t], axis=0, out=more, mode="clip")
            x += more
            np.dot(state, u, out=y)
            g, yc = x[:, : 2 * h2], y[:, 2 * h2 :]
            g += y[:, : 2 * h2]
            np.tanh(g, out=g)
            np.multiply(g[:, h2:], yc, out=a)
            a += yc
            a += x[:, 2 * h2 :]
            np.tanh(a, out=a)
            np.subtract(state, a, out=d)
            d *= 0.5
            a += d
            d *= g[:, :h2]
            np.add(a, d, out=state)
            both[t, :, :h] = state[:, :h]
            both[steps - 1 - t, :, h:] = state[:, h:]
        scores = both.reshape(-1, h2) @ p["o"] + p["c"]
        np.exp(np.minimum(scores, 60), out=scores)
        scores /= scores @ np.ones((len(self.langs), 1), np.float32)
        return scores.reshape(steps, n, -1).transpose(1, 0, 2)

    def gradients(self, codes: np.ndarray, labels: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the real bytes, and its gradients through all steps of the window."""
        kept: list = []
        prob = self.run(codes, kept)
        both, (n, steps), h, h2 = kept.pop(), codes.shape, self.h, 2 * self.h
        count = max(1, real.sum())
        loss = -np.log(np.maximum(prob[np.arange(n)[:, None], np.arange(steps), labels[:, None]], 1e-9))[real].sum() / count
        d = prob.copy()
        d[np.arange(n)[:, None], np.arange(steps), labels[:, None]] -= 1
        d = (d * real[:, :, None] / count).transpose(1, 0, 2).reshape(steps * n, -1).astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["o"], grad["c"] = both.reshape(-1, h2).T @ d, d.sum(axis=0)
        back = (d @ self.p["o"].T).reshape(steps, n, h2)
        own = np.concatenate([back[:, :, :h], back[::-1, :, h:]], axis=2)
        ds = np.zeros((n, h2), np.float32)
        for t in range(steps - 1, -1, -1):
            state, z, r, c, yc = kept[t]
            ds = ds + own[t]
            dz, dc = ds * (state - c) * z * (1 - z), ds * (1 - z) * (1 - c * c)
            dr, dy = dc * yc * r * (1 - r), dc * r
            gates = np.concatenate([dz, dr, dc], axis=1)
            grad["b"] += gates.sum(axis=0)
            rec = np.concatenate([dz, dr, dy], axis=1)
            grad["u"] += state.T @ rec
            ds = ds * z + rec @ self.p["u"].T
            split = gates.reshape(n, 3, 2, h)
            np.add.at(grad["fwd"], codes[:, t], split[:, :, 0].reshape(n, -1))
            np.add.at(grad["bwd"], codes[:, -1 - t], split[:, :, 1].reshape(n, -1))
        grad["u"] *= self.mask
        return float(loss), grad

    def fit(self, codes: np.ndarray, labels: np.ndarray, real: np.ndarray, steps: int = 350, batch: int = 128, rate: float = 0.01, seed: int = 3) -> None:
        """Adam over random batches of windows."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for t in range(1, steps + 1):
            pick = rng.integers(0, len(codes), batch)
            _, g = self.gradients(codes[pick], labels[pick], real[pick])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            pace = rate * (1 if t < steps * 0.7 else 0.3) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for k, x in g.items():
                x = x * np.float32(min(1, 1 / max(norm, 1e-9)))
                m[k] += np.float32(0.1) * (x - m[k])
                v[k] += np.float32(0.001) * (x * x - v[k])
                self.p[k] -= np.float32(pace) * m[k] / (np.sqrt(v[k]) + np.float32(1e-8))


def has_letter(text: bytes) -> bool:
    return any(_LETTER.search(text[at : at + 4096].decode("utf-8", "ignore")) for at in range(0, len(text), 4090))


def windows_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of at most LANES windows: codes, bytes in each, index of its text."""
    codes, used, owner, n = np.zeros((LANES, WINDOW), np.uint8), np.zeros(LANES, np.int64), np.zeros(LANES, np.int64), 0
    for i, text in enumerate(texts):
        data = np.frombuffer(text, np.uint8)
        at = 0
        while at < len(data):
            take = min(LANES - n, -(-(len(data) - at) // WINDOW))
            part = data[at : at + take * WINDOW]
            flat = codes[n : n + take].reshape(-1)
            flat[: len(part)] = part
            flat[len(part) :] = 32
            used[n : n + take] = WINDOW
            used[n + take - 1] = len(part) - (take - 1) * WINDOW
            owner[n : n + take] = i
            n, at = n + take, at + take * WINDOW
            if n == LANES:
                yield codes, used, owner
                codes, used, owner, n = np.zeros_like(codes), np.zeros_like(used), np.zeros_like(owner), 0
    if n:
        yield codes, used, owner


def pooled(model: ByteTagger, texts: list[bytes]) -> np.ndarray:
    """Mean over all bytes of each text's probabilities; every batch has the same shape, whatever it holds."""
    total = np.zeros((len(texts), len(model.langs)))
    for codes, used, owner in windows_of(texts):
        prob = model.label(codes)
        for i in np.flatnonzero(used < WINDOW):
            prob[i, used[i] :] = 0
        np.add.at(total, owner, prob.transpose(1, 0, 2).sum(axis=0, dtype=np.float32).astype(np.float64))
    return total / np.maximum(1, np.array([len(t) for t in texts], np.int64))[:, None]


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 3200, held: int = 2, folds: int = 4) -> ByteTagger:
    """Fit on labelled windows of the rows outside the held-out fold.

    Every byte of these rows' texts is in one window; about per_lang windows of each language are drawn by a hash of row
    and window, each as likely as any other, all of them where a language has fewer. That bounds what comes to the driver.
    Languages are collected with their number of windows; the network has an output for each. Without labelled rows all
    predictions are `und`.
    """
    fold = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % folds
    rows = df.filter((F.octet_length(text_col) > 0) & F.col(lang_col).isNotNull() & (fold != held))
    rows = rows.select(F.col(lang_col).alias("l"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("k"), F.col(text_col).cast("binary").alias("t"))
    rows = rows.withColumn("n", F.ceil(F.octet_length("t") / WINDOW).cast("int"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return ByteTagger(["und"])
    cuts = F.create_map(*[F.lit(y) for x in langs for y in (x, int((1 << 40) * min(1.0, per_lang / counts[x])))])
    rows = rows.withColumn("cut", cuts[F.col("l")])
    drawn = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.pmod(F.xxhash64("k", i), F.lit(1 << 40)) < F.col("cut"))
    picked = rows.select("l", "k", "t", F.explode(drawn).alias("i"))
    picked = picked.select("l", "k", "i", F.substring("t", F.col("i") * WINDOW + 1, F.lit(WINDOW)).alias("w")).collect()
    picked.sort(key=lambda r: (r["k"], r["i"], r["l"]))
    codes, real = np.full((len(picked), WINDOW), 32, np.uint8), np.zeros((len(picked), WINDOW), bool)
    for i, r in enumerate(picked):
        codes[i, : len(r["w"])] = np.frombuffer(bytes(r["w"]), np.uint8)
        real[i, : len(r["w"])] = True
    model = ByteTagger(langs)
    if len(langs) > 1 and len(picked):
        model.fit(codes, np.array([langs.index(r["l"]) for r in picked]), real)
    return model


def predict(model: ByteTagger, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
    """Language and mean probability of each text, in groups of a bounded number of texts."""
    preds: list[str] = []
    scores: list[float] = []
    for at in range(0, len(texts), 1024):
        part = [t or b"" for t in texts[at : at + 1024]]
        known = [has_letter(t) for t in part]
        prob = pooled(model, [t if k else b"" for t, k in zip(part, known, strict=True)])
        preds += [model.langs[i] if k else "und" for i, k in zip(prob.argmax(axis=1), known, strict=True)]
        scores += [min(1.0, round(float(x), 6)) if k else 0.0 for x, k in zip(prob.max(axis=1), known, strict=True)]
    return preds, scores


def keep_identified(df: DataFrame, model: ByteTagger, least: float = 0.35, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows, all columns as they are, whose text has a language with at least this mean probability; a null language
    is filled in. Null texts and texts without a letter go."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = df.columns
    text_at, lang_at = names.index(text_col), names.index(lang_col)

    def run(batches):
        for batch in batches:
            preds, scores = predict(shared.value, batch.column(text_at).cast(pa.binary()).to_pylist())
            cols = list(batch.columns)
            cols[lang_at] = pc.coalesce(cols[lang_at], pa.array(preds, cols[lang_at].type))
            mask = pa.array([p != "und" and s >= least for p, s in zip(preds, scores, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(cols, names).filter(mask)

    return small_batches(df).mapInArrow(run, df.schema)


def identify(df: DataFrame, model: ByteTagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """lang_pred and score (mean probability, rounded to six places) of every whole text.

    `und` with score 0 where the text is null or has no letter. Rows map one to one; equal texts give equal predictions.
    Only the text is read; other columns are ignored, whatever their names. The model has a fixed size.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        tagger = shared.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            preds, scores = predict(tagger, texts.to_pylist())
            yield pa.RecordBatch.from_arrays([ids, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    rows = df.select(F.col(id_col), F.col(text_col).cast("binary").alias(text_col))
    return small_batches(rows).mapInArrow(run, f"{id_col} {dict(df.dtypes)[id_col]}, lang_pred string, score double")
