"""Substring dedup: repeated windows of words found through recompression of the token sequences.

Method.  Rounds of recompression shorten each document's word sequence: equal neighbours (runs)
join, and of the rest a neighbour pair joins where the left name falls in the round's left class
and the right name in its right class.  A name is a 64-bit fingerprint of the words it stands
for, and a class is one bit of a hash of name and round, so a run or pair gets the same name in
every document of the corpus without a central table, and each round is one pass over the data.
A joined symbol's borders depend only on its neighbours, so every symbol carries the span of
words that determines it.  Inside a window of ``window`` words, the symbols whose span lies
inside are the same wherever the window occurs; the highest of them (ties: smallest hash) stands
for the window.  Consecutive windows with one such symbol form a segment.

Spark then groups segments by symbol: symbols seen in one document only are done.  Segments with
equal text (128-bit hash of the whole word range) are settled at once: all but the smallest
document's are covered.  Only the smallest document's segment of each distinct text is
unrolled to windows, which are compared with each other by a 128-bit hash of their text.

Scale.  Group sizes do not matter: every grouping is a partial aggregate (smallest document id),
equal segments of any number collapse to one representative, and joins that hand minima back are
plain equi-joins against written tables, which may be split.  Texts are shuffled only for
documents with something to unroll or remove; a bitmap of fixed size (2^25 bits) tells most
others apart in the map pass, and a false positive there only shuffles one text more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .edit import bitmap, edit_texts, marked, with_bit
from .store import save
from .text import Words, mix, slices, split_words, word_hashes

U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15)
_BACK = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Spans:
    """Fingerprints of arbitrary ranges of a sequence of word hashes, from one prefix sum."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        up = np.cumprod(np.full(n, _STEP, U64)) if n else np.zeros(0, U64)
        self.down = np.concatenate([[U64(1)], np.cumprod(np.full(n, _BACK, U64))]) if n else np.ones(1, U64)
        self.total = np.concatenate([[U64(0)], np.cumsum(h * up)])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.total[b] - self.total[a]) * self.down[a] + (b - a).astype(U64) * U64(0xD6E8FEB86659FD93))


def recompress(h: np.ndarray, first: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rounds over the documents ``h[first[d]:first[d+1]]``: yields ``(name, left, right)`` per level,
    the symbols in order and the span of words that determines each of them."""
    spans = Spans(h)
    n = len(h)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start, name = np.arange(n), h
    left, right = start, start + 1
    level = 0
    while True:
        yield name, left, right
        own = doc[start]
        if not ((right - left <= window) & (left >= first[own]) & (right <= first[own + 1])).any():
            return  # every symbol's span has outgrown the window or passes a document's edge, for good
        level += 1
        side = mix(name + U64(level) * _STEP) >> U64(63) == 1
        same = doc[start[1:]] == doc[start[:-1]]
        joined = same & ((name[1:] == name[:-1]) | (~side[:-1] & side[1:]))
        at = np.flatnonzero(np.concatenate([[True], ~joined]))
        to = np.append(at[1:], len(start))
        own = doc[start[at]]
        # a symbol at a document's edge could go on in another document: its span passes the edge
        l_in = (at > 0) & (doc[start[at - 1]] == own)
        r_in = (to < len(start)) & (doc[start[np.minimum(to, len(start) - 1)]] == own)
        new_left = np.where(l_in, left[at - 1], first[own] - 1)
        new_right = np.where(r_in, right[np.minimum(to, len(start) - 1)], first[own + 1] + 1)
        ends = np.append(start[at][1:], n)
        start, left, right = start[at], new_left, new_right
        name = spans.of(start, ends)


def _paint(best: np.ndarray, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> None:
    """``best[i] = max(best[i], value[k])`` for every ``lo[k] <= i <= hi[k]`` (short ranges)."""
    size = hi - lo + 1
    power = np.frexp(size.astype(np.float64))[1] - 1
    table = None
    for p in range(int(power.max()) if len(power) else -1, -1, -1):
        cur = np.zeros(len(best), U64)
        own = np.flatnonzero(power == p)
        np.maximum.at(cur, lo[own], value[own])
        np.maximum.at(cur, hi[own] - (1 << p) + 1, value[own])
        if table is not None:
            half = 1 << p
            np.maximum(cur, table, out=cur)
            np.maximum(cur[half:], table[:-half], out=cur[half:])
        table = cur
    if table is not None:
        np.maximum(best, table, out=best)


def anchors(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Segments ``(doc, lo, hi, key)``: the windows starting at words ``lo..hi`` (counted from the
    chunk's start) are those whose highest interior symbol is the one with this key."""
    spans = Spans(h)
    n = len(h)
    counts = np.diff(first)
    last = np.repeat(first[1:] - window, counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    valid = np.arange(n) <= last
    lefts, rights, tops, prios = [], [], [], []
    for level, (_, left, right) in enumerate(recompress(h, first, window)):
        ok = right - left <= window
        ok &= (left >= 0) & (right <= n)
        l, r = left[ok], right[ok]
        d = doc[np.minimum(l, n - 1)]
        ok = (l >= first[d]) & (r <= first[d + 1]) & (first[d + 1] - first[d] >= window)
        l, r = l[ok], r[ok]
        lefts.append(l), rights.append(r), tops.append(np.full(len(l), level)), prios.append(spans.of(l, r))
    left, right = np.concatenate(lefts), np.concatenate(rights)
    top, prio = np.concatenate(tops), np.concatenate(prios)
    d = doc[left]
    lo, hi = np.maximum(right - window, first[d]), np.minimum(left, first[d + 1] - window)
    value = (np.minimum(top, 15).astype(U64) << U64(60)) | ((prio >> U64(36)) << U64(32)) | (np.arange(len(left), dtype=U64) + U64(1))
    best = np.zeros(n, U64)
    high = top >= 3
    _paint(best, lo[high], hi[high], value[high])
    bare = valid & (best == 0)
    if bare.any():
        rest = np.zeros(n, U64)
        _paint(rest, lo[~high], hi[~high], value[~high])
        best[bare] = rest[bare]
    at = np.flatnonzero(valid)
    pick = (best[at] & U64(0xFFFFFFFF)).astype(np.int64) - 1
    cut = np.ones(len(at), bool)
    cut[1:] = (pick[1:] != pick[:-1]) | (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(at)) - 1
    pick = pick[begin]
    key = mix(prio[pick] + top[pick].astype(U64) * _STEP)
    return doc[at[begin]], at[begin], at[end], key


def _text_hashes(w: Words, lo: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of the words ``lo`` up to ``to``, joined by one space."""
    data, digest = w.data.tobytes(), xxhash.xxh3_128_digest
    out = b"".join([digest(data[s:e]) for s, e in zip(w.starts[lo].tolist(), w.ends[to - 1].tolist())])
    both = np.frombuffer(out, "<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def segments(docs: DataFrame, window: int) -> DataFrame:
    """``(doc_id, tid, lo, hi, key, c1, c2)``: segments of windows and the hash of their whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                w = split_words(b.column(2))
                if not (w.counts() >= window).any():
                    continue
                d, lo, hi, key = anchors(word_hashes(w), w.first, window)
                c1, c2 = _text_hashes(w, lo, hi + window)
                idx = pa.array(d)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(idx), b.column(1).take(idx), pa.array((lo - w.first[d]).astype(np.int32)),
                     pa.array((hi - w.first[d]).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(c1), pa.array(c2)],
                    ["doc_id", "tid", "lo", "hi", "key", "c1", "c2"])
    return docs.where("doc_id is not null").mapInArrow(
        run, "doc_id long, tid long, lo int, hi int, key long, c1 long, c2 long")


def _unroll(docs: DataFrame, reps: DataFrame, window: int) -> DataFrame:
    """``(doc_id, tid, pos, w1, w2)`` for every window in the segments ``reps(doc_id, tid, lo, hi)``."""
    marks = docs.sparkSession.sparkContext.broadcast(bitmap(reps, "doc_id", "tid"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(["doc_id", "tid", "text"]).filter(pa.array(marked(marks.value, b.column(3))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                w = split_words(b.column(2))
                at = [np.unique(np.concatenate([np.arange(s["lo"], s["hi"] + 1) for s in own])) + w.first[i]
                      for i, own in enumerate(b.column(3).to_pylist())]
                d = np.repeat(np.arange(len(at)), [len(a) for a in at])
                pos = np.concatenate(at)
                w1, w2 = _text_hashes(w, pos, pos + window)
                idx = pa.array(d)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(idx), b.column(1).take(idx), pa.array((pos - w.first[d]).astype(np.int32)),
                     pa.array(w1), pa.array(w2)], ["doc_id", "tid", "pos", "w1", "w2"])

    own = reps.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("lo", "hi")).alias("own"))
    texts = with_bit(docs.where("doc_id is not null"), "doc_id", "tid").mapInArrow(pick, "doc_id long, tid long, text string")
    return (texts.dropDuplicates(["doc_id", "tid"]).join(own, ["doc_id", "tid"]).select("doc_id", "tid", "text", "own")
            .mapInArrow(run, "doc_id long, tid long, pos int, w1 long, w2 long"))


def repeated_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """``(doc_id, tid, lo, hi)``: word ranges (hi exclusive) covered by windows that also start in a
    document with a smaller id.  ``docs`` has ``doc_id, tid, text``."""
    seg = save(segments(docs, window), "substring-segments")
    keys = save(seg.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
                .where("a < b").select("key"), "substring-keys")
    shared = save(seg.join(keys, "key", "left_semi"), "substring-shared")
    texts = save(shared.groupBy("key", "c1", "c2").agg(F.min("doc_id").alias("home")), "substring-texts")
    many = save(texts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "substring-many")
    homed = save(shared.join(texts, ["key", "c1", "c2"]), "substring-homed")
    whole = homed.where("doc_id > home").select("doc_id", "tid", "lo", (F.col("hi") + window).alias("hi"))
    reps = homed.where("doc_id = home").join(many, "key", "left_semi").select("doc_id", "tid", "lo", "hi")
    wins = save(_unroll(docs, save(reps, "substring-reps"), window), "substring-windows")
    low = save(wins.groupBy("w1", "w2").agg(F.min("doc_id").alias("home"), F.max("doc_id").alias("b"))
               .where("home < b").select("w1", "w2", "home"), "substring-low")
    single = (wins.join(low, ["w1", "w2"]).where("doc_id > home")
              .select("doc_id", "tid", F.col("pos").alias("lo"), (F.col("pos") + window).alias("hi")))
    return whole.unionByName(single)


def _kept(w: Words, i: int, gone: list | None) -> tuple[int, int, str]:
    """Words, removed words and the text that is left of document ``i``."""
    a, b = int(w.first[i]), int(w.first[i + 1])
    if a == b:
        return 0, 0, ""
    if not gone:
        return b - a, 0, w.data[w.starts[a]:w.ends[b - 1]].tobytes().decode()
    edge = np.zeros(b - a + 1, np.int64)
    np.add.at(edge, [g["lo"] for g in gone], 1)
    np.add.at(edge, [g["hi"] for g in gone], -1)
    stay = np.flatnonzero(np.cumsum(edge)[:-1] == 0) + a
    data = w.data.tobytes()
    return b - a, b - a - len(stay), " ".join([data[s:e].decode() for s, e in zip(w.starts[stay].tolist(), w.ends[stay].tolist())])


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text",
                   texts: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_sha256`` and, with ``texts``, ``kept``.

    Windows are judged on the input.  A null text has no words; a text of fewer than ``window`` words
    loses nothing; repeats within one document do not count; rows that share a doc_id are one
    document to the others and never cover each other; a row with a null id keeps all its words and
    covers nothing; an empty table gives an empty result.  Other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tid"), F.col(text_col).alias("text"))
    spans = save(repeated_spans(base, window), "substring-spans")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + (["kept"] if texts else [])
    kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if texts else "")

    def result(b: pa.RecordBatch, gone: list) -> pa.RecordBatch:
        w = split_words(b.column(b.schema.get_field_index("text")))
        rows = [_kept(w, i, g) for i, g in enumerate(gone)]
        cols = [b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([hashlib.sha256(r[2].encode()).hexdigest() for r in rows], pa.string())]
        return pa.RecordBatch.from_arrays(cols + ([pa.array([r[2] for r in rows], pa.string())] if texts else []), names)

    own = spans.select("doc_id", "tid", F.struct("lo", "hi").alias("span"))
    return edit_texts(base, own, "span", result, kinds)
