"""Language identification by a bidirectional gated recurrent network over the bytes of a text.

Method.  A text is read in windows of ``window`` bytes.  One recurrent layer runs over a window forwards and one
backwards, each with gates

    z = s(E_z[b] + U_z h),  r = s(E_r[b] + U_r h),  c = tanh(E_c[b] + r * (U_c h)),  h' = (1 - z) c + z h

and at every position a softmax over both states labels the language.  A document's probabilities are the means over all
its positions; the largest is its label, its probability the score.

Fit.  Weights are learnt in numpy by backpropagation through time with Adam, on the driver, from a bounded sample: per
language at most ``per_lang`` training documents (those with the smallest hash of doc_id) and of each at most ``parts`` windows
spread evenly over its whole text, cut out in the tasks.  This is the documented bound; labels cover whole texts of all rows.

Defined cases.  A text that is null or has no letter is ``und`` with score 0, and so is every text where nothing could
be learnt.  A null ``doc_id`` counts as the empty text in the fold; rows repeat as they came; ties of probability go to the
language that sorts first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import raw_bytes, slices

FOLD = 4
HELD = 2
BLOCK = 8192


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(np.minimum(x, 60, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Network:
    """Weights with features in rows: ``E`` (2, 3 hidden, 256), ``U`` (2, 3 hidden, hidden), ``W`` (classes, 2 hidden), ``b``."""

    def __init__(self, langs: list[str], hidden: int = 8, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        n = max(1, len(langs))
        self.weights = {"E": rng.normal(0, .3, (2, 3 * hidden, 256)), "U": rng.normal(0, hidden ** -.5, (2, 3 * hidden, hidden)),
                        "W": rng.normal(0, .3, (n, 2 * hidden)), "b": np.zeros((n, 1))}
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def step(self, way: int, byte: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """Gates, candidate, the recurrent part of the candidate, and the new state."""
        k = self.hidden
        x = np.take(self.weights["E"][way], byte, axis=1)
        u = self.weights["U"][way] @ h
        x[:2 * k] += u[:2 * k]
        zr = sigmoid(x[:2 * k])
        z, r = zr[:k], zr[k:]
        c = x[2 * k:]
        c += r * u[2 * k:]
        c *= 2
        c = sigmoid(c)
        c *= 2
        c -= 1
        return z, r, c, u[2 * k:], c + z * (h - c)

    def positions(self, data: np.ndarray, mask: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """``data`` and ``mask`` (steps, windows) -> per step, from the last to the first, class probabilities (classes, windows)."""
        steps, n = data.shape
        k, w = self.hidden, self.weights
        h = np.zeros((k, n), w["E"].dtype)
        ahead = np.empty((steps, len(w["b"]), n), h.dtype)
        for t in range(steps):
            h = self.step(0, data[t], h)[-1]
            np.matmul(w["W"][:, :k], h, out=ahead[t])
        h = np.zeros_like(h)
        for t in range(steps - 1, -1, -1):
            h = self.step(1, data[t], h)[-1]
            h *= mask[t]  # the state stays zero before the last byte of a short window
            p = ahead[t]
            p += w["W"][:, k:] @ h
            p += w["b"]
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            yield t, p

    def gradients(self, data: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all real positions, and its gradients by backpropagation through time."""
        steps, n = data.shape
        k, w = self.hidden, self.weights
        grad = {name: np.zeros_like(v) for name, v in w.items()}
        kept: list[list] = [[None] * steps, [None] * steps]
        state = np.zeros((2, steps, k, n), w["E"].dtype)
        for way, order in ((0, range(steps)), (1, range(steps - 1, -1, -1))):
            h = np.zeros((k, n), w["E"].dtype)
            for t in order:
                z, r, c, uc, new = self.step(way, data[t], h)
                kept[way][t] = (h, z, r, c, uc)
                h = new * mask[t]
                state[way, t] = h
        total, loss = max(1, int(mask.sum())), 0.0
        back = np.empty((2, steps, k, n), state.dtype)
        for t in range(steps):
            both = np.concatenate([state[0, t], state[1, t]])
            p = w["W"] @ both + w["b"]
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            loss -= float((np.log(p[label, np.arange(n)] + 1e-30) * mask[t]).sum())
            p[label, np.arange(n)] -= 1
            p *= mask[t] / total
            grad["W"] += p @ both.T
            grad["b"] += p.sum(axis=1, keepdims=True)
            d = w["W"].T @ p
            back[0, t], back[1, t] = d[:k], d[k:]
        one_hot = np.arange(256)[:, None]
        for way, order in ((0, range(steps - 1, -1, -1)), (1, range(steps))):
            u = w["U"][way]
            later = np.zeros((k, n), state.dtype)
            for t in order:
                h, z, r, c, uc = kept[way][t]
                d = (back[way, t] + later) * mask[t]
                dz = d * (h - c) * z * (1 - z)
                dc = d * (1 - z) * (1 - c * c)
                dr = dc * uc * r * (1 - r)
                into = np.concatenate([dz, dr, dc])
                through = np.concatenate([dz, dr, dc * r])
                grad["U"][way] += through @ h.T
                grad["E"][way] += into @ (one_hot == data[t]).astype(into.dtype).T
                later = u.T @ through + d * z
        return loss / total, grad

    def train(self, data: np.ndarray, size: np.ndarray, label: np.ndarray, epochs: int, batch: int = 256, rate: float = .02) -> "Network":
        """Windows ``data`` (windows, steps) of ``size`` real bytes; every language weighs the same in each pass."""
        rng = np.random.default_rng(5)
        own = [np.flatnonzero(label == i) for i in range(len(self.langs))]
        most = max(map(len, own))
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        at, rounds = 0, epochs * -(-most * len(own) // batch)
        for _ in range(epochs):
            order = rng.permutation(np.concatenate([np.resize(rng.permutation(x), most) for x in own]))
            for a in range(0, len(order), batch):
                some = order[a:a + batch]
                mask = (np.arange(data.shape[1])[:, None] < size[some]).astype(np.float32)
                _, grad = self.gradients(np.ascontiguousarray(data[some].T), mask, label[some])
                at += 1
                pace = rate * (1 - at / (rounds + 1))
                for name, g in grad.items():
                    m, v = moments[name]
                    m += .1 * (g - m)
                    v += .01 * (g * g - v)
                    self.weights[name] -= pace * (m / (1 - .9 ** at)) / (np.sqrt(v / (1 - .99 ** at)) + 1e-8)
        return self

    def pooled(self, arr: pa.Array, window: int) -> np.ndarray:
        """Mean class probabilities over all bytes of each text, (texts, classes); zeros for empty texts."""
        raw, off = raw_bytes(arr)
        size = np.diff(off)
        count = -(-size // window)
        doc = np.repeat(np.arange(len(size)), count)
        begin = off[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * window
        left = np.minimum(off[doc + 1] - begin, window)
        out = np.zeros((len(size), len(self.langs)))
        for a in range(0, len(doc), BLOCK):
            at, n = begin[a:a + BLOCK], left[a:a + BLOCK]
            place = np.arange(int(n.max()))[:, None]
            mask = place < n
            data = raw[np.where(mask, at + place, 0)]
            total = np.zeros((len(self.langs), len(at)))
            real = mask.astype(np.float32)
            for t, p in self.positions(data, real):
                p *= real[t]
                total += p
            for c in range(len(self.langs)):
                out[:, c] += np.bincount(doc[a:a + BLOCK], total[c], len(size))
        return np.round(out / np.maximum(size, 1)[:, None], 6)  # the last bits depend on which texts share a block


def fold(doc_id) -> "F.Column":
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLD == HELD


def windows(text: bytes, window: int, parts: int) -> list[bytes]:
    """At most ``parts`` windows, spread evenly over the text."""
    n = min(parts, -(-len(text) // window))
    last = max(0, len(text) - window)
    return [text[at:at + window] for at in (last * i // max(1, n - 1) for i in range(n))]


def fit(docs: DataFrame, window: int = 64, hidden: int = 8, per_lang: int = 300, parts: int = 4, epochs: int = 12) -> Network:
    """Learn from the training fold of ``docs(doc_id, text, lang)``."""
    real = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~fold(F.col("doc_id")))
    key = (F.xxhash64(F.col("doc_id")), F.col("doc_id"), F.xxhash64("text"))
    some = (real.select("lang", F.struct(*(c.alias(f"k{i}") for i, c in enumerate(key))).alias("key"), "text")
            .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("n") <= per_lang))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                rows = [(lang, n, i, part) for lang, n, text in zip(*(b.column(c).to_pylist() for c in range(3)))
                        for i, part in enumerate(windows(text.encode(), window, parts))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.binary()))],
                                                     ["lang", "n", "i", "part"])

    # at most per_lang * parts windows a language
    got = some.select("lang", "n", "text").mapInArrow(cut, "lang string, n int, i int, part binary").orderBy("lang", "n", "i").collect()
    langs = sorted({r.lang for r in got})
    net = Network(langs, hidden)
    if len(langs) < 2:
        return net
    data = np.zeros((len(got), window), np.uint8)
    for row, r in zip(data, got):
        row[:len(r.part)] = np.frombuffer(bytes(r.part), np.uint8)
    at = {lang: i for i, lang in enumerate(langs)}
    return net.train(data, np.array([len(r.part) for r in got]), np.array([at[r.lang] for r in got]), epochs)


def label(docs: DataFrame, net: Network, window: int = 64) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                letters = b.column(3).to_numpy(zero_copy_only=False).astype(bool) & bool(own.langs)
                p = own.pooled(b.column(2), window) if own.langs else np.zeros((b.num_rows, 1))
                best = p.argmax(axis=1)
                lang = [own.langs[i] if ok else "und" for i, ok in zip(best.tolist(), letters.tolist())]
                score = np.where(letters, np.clip(p[np.arange(len(best)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score)],
                                                 ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold(F.col("doc_id")).alias("held_out"), "text",
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def languages(docs: DataFrame, window: int = 64, **how) -> DataFrame:
    """Fit on the training fold of ``docs(doc_id, text, lang)`` and label every row; see ``fit`` for the bounds."""
    return label(docs, fit(docs.select("doc_id", "text", "lang"), window, **how), window)
