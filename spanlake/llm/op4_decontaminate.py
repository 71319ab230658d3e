"""Benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment.

Method.  Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased, so punctuation and case do not
matter.  A passage is aligned with an item word by word (match 2, mismatch and gap -1); the score is the best local
alignment over that of a verbatim copy (2 L), and a document is contaminated at ``threshold`` or more.

Seeds follow from the threshold.  An alignment with ``m`` matches and ``x`` mismatches and gaps has ``2 m - x >=
2 threshold L``; its matches form at most ``x + 1`` runs, so at least ``m - x - 1 >= (2 threshold - 1) L - 1`` of the item's
2-grams stand in the text as they are: that many are shared by every copy, wherever its words were changed, dropped or
filled up.  Of these ``need`` (three, or a quarter if that is more) are asked for, so the commonest 2-grams beyond the
rest go and the others are the item's seeds, rare by their count over all documents.  Items too short for a sure
2-gram use their words instead (``threshold L`` of them match).  ``x`` also bounds how far a copy's seeds drift from one
diagonal, hence the stretches in which hits are counted and the words around them that are aligned: both go by the
item's own length.

Scale.  Documents are read three times: for the counts, for places of seeds, and for blocks of words around the
stretches found; bitmaps of fixed size (2^25 bits) keep all else in the tasks.  The joins with seeds and items are by
key, their size is left to the planner.  An item that occurs in a third of all documents costs a few alignments each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .edit import MARK_BITS, bitmap_of
from .store import save
from .text import mix, slices, split_words, word_hashes

U64 = np.uint64
MIN_WORDS = 3  # items of fewer words are in too many texts by chance
BLOCK = 256  # words of a text that travel together
SHIFT = 64 - (MARK_BITS.bit_length() - 1)
MARKS = np.ones(256, bool)  # bytes between words: ASCII but letters and digits
MARKS[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    MARKS[_a:_b] = False


def _grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the n words from each word on, and whether they lie in one text."""
    g = h.copy()
    for k in range(1, n):
        g[:-k] = mix(g[:-k] * U64(0x9E3779B97F4A7C15) + h[k:])
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(h))
    return mix(g), left >= n


def _bits(df: DataFrame, column: str) -> np.ndarray:
    bit = F.shiftrightunsigned(column, SHIFT) + 1
    rows = (df.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect())
    out = np.zeros(MARK_BITS // 8, np.uint8)
    for r in rows:  # MARK_BITS / 32768 rows at most
        out[(r.bucket - 1) * 4096:r.bucket * 4096] |= np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _hits(bits: np.ndarray, g: np.ndarray, ok: np.ndarray) -> np.ndarray:
    at = (g >> U64(SHIFT)).astype(np.int64)
    return np.flatnonzero(((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1) & ok)


def shared_grams(size: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """How many of an item's n-grams (n 1 or 2) every text aligned at ``threshold`` holds."""
    least = (2 * threshold - 1) * size - 1 if n == 2 else threshold * size
    return np.maximum(np.ceil(least - 1e-9).astype(np.int64), 0)


def items_of(benchmark: DataFrame) -> DataFrame:
    """``(iid, item_id, words, size)`` per item with an id and words; rows that repeat an id stay apart by ``iid``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                w = split_words(b.column(1), lower=True, breaks=MARKS)
                h = word_hashes(w).astype("<u8")
                f = w.first.tolist()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([h[x:y].tobytes() for x, y in zip(f[:-1], f[1:])], pa.binary()), pa.array(w.counts())],
                    ["item_id", "words", "size"])
    return (benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
            .mapInArrow(run, "item_id long, words binary, size long").where(F.col("size") >= MIN_WORDS).distinct()
            .select(F.xxhash64("item_id", "words").alias("iid"), "item_id", "words", "size"))


def item_grams(items: DataFrame, threshold: float) -> DataFrame:
    """``(iid, size, n, need, spare, gram, ipos)``: of the n-grams of an item, the ``spare`` commonest are no seeds, and
    ``need`` of the others are in every copy."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, words in enumerate(b.column(1).to_pylist()):
                h = np.frombuffer(words, U64)
                n = 2 if shared_grams(np.array([len(h)]), 2, threshold)[0] else 1
                shared = max(int(shared_grams(np.array([len(h)]), n, threshold)[0]), 1)
                need = min(shared, max(3, shared // 4))
                g, ok = _grams(h, np.array([0, len(h)]), n)
                at = np.flatnonzero(ok)
                rows.append((np.full(len(at), i), g[at], at, *(np.full(len(at), v) for v in (n, need, shared - need))))
            if rows:
                idx, g, at, n, need, spare = (np.concatenate(x) for x in zip(*rows))
                own = pa.array(idx)
                yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(2).take(own), *(pa.array(v.astype(np.int64)) for v in (n, need, spare)),
                                                  pa.array(g.view(np.int64)), pa.array(at.astype(np.int64))],
                                                 ["iid", "size", "n", "need", "spare", "gram", "ipos"])
    return items.select("iid", "words", "size").mapInArrow(run, "iid long, size long, n long, need long, spare long, gram long, ipos long")


def gram_counts(docs: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """``(gram, times)`` over all documents, for the benchmark's n-grams (and few others that share a bit)."""
    bits = docs.sparkSession.sparkContext.broadcast(_bits(grams, "gram"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                w = split_words(b.column(0), lower=True, breaks=MARKS)
                h = word_hashes(w)
                for n in lengths:
                    g, ok = _grams(h, w.first, n)
                    u, c = np.unique(g[_hits(bits.value, g, ok)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], ["gram", "times"])
    return docs.select("text").mapInArrow(run, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times"))


def seed_places(docs: DataFrame, seeds: DataFrame, lengths: list[int]) -> DataFrame:
    """``(doc_id, tid, gram, place)`` for the words of the texts at which a seed (or few others) starts."""
    bits = docs.sparkSession.sparkContext.broadcast(_bits(seeds, "gram"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                w = split_words(b.column(2), lower=True, breaks=MARKS)
                h = word_hashes(w)
                for n in lengths:
                    g, ok = _grams(h, w.first, n)
                    at = _hits(bits.value, g, ok)
                    doc = np.searchsorted(w.first, at, side="right") - 1
                    own = pa.array(doc)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), pa.array(g[at].view(np.int64)),
                                                      pa.array((at - w.first[doc]).astype(np.int64))], ["doc_id", "tid", "gram", "place"])
    return docs.select("doc_id", "tid", "text").mapInArrow(run, "doc_id long, tid long, gram long, place long")


def _mark(doc: pa.Array, tid: pa.Array, block: np.ndarray) -> np.ndarray:
    """The bit of a block of a text; block -1 is the text itself."""
    d, t = (x.to_numpy(zero_copy_only=False).astype(np.int64).view(U64) for x in (doc, tid))
    return (mix(mix(mix(d) + t) + block.astype(np.int64).view(U64)) >> U64(SHIFT)).astype(np.int64)


def word_blocks(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(doc_id, tid, block, words)``: word hashes of the ``wanted`` blocks (and few others that share a bit)."""
    def bit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = b.column(2).to_numpy(zero_copy_only=False)
            both = np.concatenate([_mark(b.column(0), b.column(1), block), _mark(b.column(0), b.column(1), np.full(len(block), -1))])
            yield pa.RecordBatch.from_arrays([pa.array(both)], ["bit"])
    bits = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted.select("doc_id", "tid", "block").mapInArrow(bit, "bit long"), F.col("bit")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marked(at: np.ndarray) -> np.ndarray:
            return np.flatnonzero((bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
        for batch in batches:
            batch = batch.take(pa.array(marked(_mark(batch.column(0), batch.column(1), np.full(batch.num_rows, -1)))))
            for b in slices(batch, "text"):
                w = split_words(b.column(2), lower=True, breaks=MARKS)
                h = word_hashes(w).astype("<u8")
                blocks = -(-np.asarray(w.counts()) // BLOCK)
                doc = np.repeat(np.arange(len(blocks)), blocks)
                block = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                own = pa.array(doc)
                keep = marked(_mark(b.column(0).take(own), b.column(1).take(own), block))
                doc, block, own = doc[keep], block[keep], pa.array(doc[keep])
                low = w.first[doc] + block * BLOCK
                high = np.minimum(low + BLOCK, w.first[doc + 1])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(own), b.column(1).take(own), pa.array(block.astype(np.int64)),
                     pa.array([h[x:y].tobytes() for x, y in zip(low.tolist(), high.tolist())], pa.binary())], ["doc_id", "tid", "block", "words"])
    return (docs.select("doc_id", "tid", "text").mapInArrow(run, "doc_id long, tid long, block long, words binary")
            .dropDuplicates(["doc_id", "tid", "block"]))


def align(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Best local alignment scores of rows of items against rows of texts; 0 pads items, 1 pads texts."""
    n, width = text.shape
    place = np.arange(width, dtype=np.int32)
    above = np.zeros((n, width), np.int32)
    best = np.zeros(n, np.int32)
    for i in range(item.shape[1]):
        diagonal = np.zeros_like(above)
        diagonal[:, 1:] = above[:, :-1]
        diagonal += np.where(text == item[:, i:i + 1], 2, -1).astype(np.int32)
        row = np.maximum(np.maximum(diagonal, above - 1), 0)
        # a gap along the row: the running maximum of what each cell would be worth here
        above = np.maximum.accumulate(row + place, axis=1) - place
        np.maximum(best, above.max(axis=1), out=best)
    return best


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.65) -> DataFrame:
    """``(doc_id, tid, item_id, begin, score)``: alignments at ``threshold`` or more, per stretch of a text and item;
    ``begin`` is the first word aligned."""
    items = save(items_of(benchmark), "leak-items")
    grams = save(item_grams(items, threshold), "leak-grams")
    lengths = sorted(r.n for r in grams.select("n").distinct().collect())  # 1, 2 or both
    times = save(gram_counts(docs, grams, lengths), "leak-counts")
    item = ["iid", "size", "need", "spare"]
    # one item's n-grams: bounded by its own length
    ranked = grams.join(times, "gram", "left").groupBy(*item).agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "gram", "ipos"))).alias("all"))
    seeds = save(ranked.select(*item, F.explode(F.slice("all", F.lit(1), (F.size("all") - F.col("spare")).cast("int"))).alias("s"))
                 .select("iid", "size", "need", "s.gram", "s.ipos"), "leak-seeds")
    # a copy's seeds lie on diagonals less than ``w`` apart, so one of the stretches of 2 w that begin every w holds them all
    w = F.floor(F.lit(2 * (1 - threshold)) * F.col("size") + F.lit(1e-9)).cast("long") + 1
    hit = (seed_places(docs, seeds, lengths).join(seeds, "gram").withColumn("d", F.col("place") - F.col("ipos")).withColumn("w", w)
           .withColumn("stretch", F.explode(F.array(F.floor(F.col("d") / F.col("w")), F.floor(F.col("d") / F.col("w")) - 1))))
    near = (hit.groupBy("doc_id", "tid", "iid", "size", "need", "w", "stretch")
            .agg(F.size(F.collect_set("ipos")).alias("found"), F.min("d").alias("low"), F.max("d").alias("high"))
            .where("found >= need")
            .select("doc_id", "tid", "iid", F.greatest(F.lit(0), F.col("low") - F.col("w")).alias("begin"),
                    (F.col("high") + F.col("w") + F.col("size")).alias("stop")).distinct())
    near = save(near, "leak-stretches")
    wanted = near.withColumn("block", F.explode(F.sequence(F.expr(f"begin div {BLOCK}"), F.expr(f"(stop - 1) div {BLOCK}"))))
    blocks = word_blocks(docs, wanted)
    # the blocks of one stretch: bounded by its item's length
    pairs = (wanted.join(blocks, ["doc_id", "tid", "block"]).groupBy("doc_id", "tid", "iid", "begin", "stop")
             .agg(F.array_sort(F.collect_list(F.struct("block", "words"))).alias("blocks"))
             .select("doc_id", "tid", "iid", "begin", "stop", F.col("blocks.words").alias("words"))
             .join(items.select("iid", "item_id", "size", F.col("words").alias("item")), "iid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {k: b.column(i).to_pylist() for i, k in enumerate(b.schema.names) if k in ("begin", "stop", "size", "words", "item")}
            size, jobs = np.array(c["size"], np.int64), []
            for words, item, begin, stop in zip(c["words"], c["item"], c["begin"], c["stop"]):
                first = begin // BLOCK * BLOCK
                jobs.append((np.frombuffer(item, U64), np.frombuffer(b"".join(words), U64)[begin - first:stop - first]))
            score = np.zeros(len(jobs))
            order = np.argsort([len(i) * 100000 + len(t) for i, t in jobs], kind="stable")
            at = 0
            while at < len(order):
                own = [order[at]]
                while at + len(own) < len(order) and len(own) * len(jobs[order[at + len(own)]][1]) < 200000:
                    own.append(order[at + len(own)])
                item = np.zeros((len(own), max(len(jobs[k][0]) for k in own)), U64)
                text = np.ones((len(own), max(len(jobs[k][1]) for k in own)), U64)
                for r, k in enumerate(own):
                    item[r, :len(jobs[k][0])], text[r, :len(jobs[k][1])] = jobs[k]
                score[own] = align(item, text)
                at += len(own)
            score /= 2 * np.maximum(size, 1)
            out = pa.RecordBatch.from_arrays([b.column(i) for i in range(4)] + [pa.array(score)], ["doc_id", "tid", "item_id", "begin", "score"])
            yield out.filter(pa.array(score >= threshold))

    return pairs.select("doc_id", "tid", "item_id", "begin", "size", "stop", "words", "item").mapInArrow(
        run, "doc_id long, tid long, item_id long, begin long, score double")


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.65) -> DataFrame:
    """``(doc_id, contaminated, item_id, score)`` per input row: the best-aligned item (ties: smallest item_id).

    Null and empty texts, items of fewer than three words, items without id and rows without doc_id are never
    contaminated; items that repeat an id count each; an empty table gives no matches; other columns are not read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), "text")
    m = matches(base.where("doc_id is not null and text is not null"), benchmark, threshold)
    best = m.groupBy("doc_id", "tid").agg(F.min(F.struct((-F.col("score")).alias("s"), "item_id")).alias("best"))
    return (base.select("doc_id", "tid").join(best, ["doc_id", "tid"], "left")
            .select("doc_id", F.col("best").isNotNull().alias("contaminated"), F.col("best.item_id").alias("item_id"),
                    (-F.col("best.s")).alias("score")))
