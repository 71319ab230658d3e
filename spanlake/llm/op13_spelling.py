"""Spelling variants: words one edit apart, found through Bloom filters that a broadcast carries.

Method.  Words are counted over all documents.  The vocabulary fills blocked Bloom filters, one per word length
(lengths of ``LONGEST`` and more share one): eight bits in one block of 256 for each word.  Every word then probes the
edits that may lead to another word: each letter left out against the filter of the next smaller length, each letter
replaced by a smaller one against the filter of its own length; the other directions are the same pairs seen from the other word.
Only edits that a filter lets through leave the task, and an exact join with the vocabulary removes the false ones.

A word's form is its near word of largest count, if that is at least ``ratio`` times its own.  Counts at least double along
forms, so chains are short; roots come by pointer doubling over written tables.

Scale.  Words are counted per block of text in the task, then by partial aggregates.  The filters together hold at most
``filter_bytes`` whatever the vocabulary's size: beyond that they let more edits through, which costs rows in the exact join and
nothing in the result.  A word meets at most its own edits, so no group grows with the corpus.

Defined cases.  A null text has no words; a null ``doc_id`` counts as the empty text before the colon.  Repeated rows count
every time.  Empty tables give no rows.  Words of any length take part.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import forget, save, save_as
from .text import LOWER, mix, raw_bytes, slices

U64 = np.uint64
LEAD = 0xC3  # first byte of U+00C0 to U+00FF in UTF-8; each is this byte and its code point less 0x40
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), LEAD]] = True
ALPHABET = np.array([*range(97, 123), *range(0xC0, 0x100)], np.uint8)
LONGEST = 48
BLOCK, PROBES = 256, 8
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):  # crc32, one byte at a time
    TABLE = np.where(TABLE & 1, (TABLE >> 1) ^ np.uint32(0xEDB88320), TABLE >> 1)


def crc_after(state: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray, stop: int = 256) -> np.ndarray:
    """crc32 of what gave ``state`` followed by each run of bytes; runs above ``stop`` bytes one by one."""
    crc = state.copy()
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -stop, side="left"))
    for i in order[:long]:
        crc[i] = zlib.crc32(data[starts[i]:starts[i] + size[i]].tobytes(), int(crc[i]))
    rest = order[long:]
    at, left = starts[rest], size[rest]
    reg = crc[rest] ^ np.uint32(0xFFFFFFFF)
    for j in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -j, side="left"))  # runs that have a byte j
        reg[:n] = TABLE[(reg[:n] ^ data[at[:n] + j]) & np.uint32(255)] ^ (reg[:n] >> np.uint32(8))
    crc[rest] = reg ^ np.uint32(0xFFFFFFFF)
    return crc


def strings(data: np.ndarray, size: np.ndarray) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def runs(ids: list, text: pa.Array, every: int, least: int) -> pa.Array:
    """The words of some documents: lower-cased runs of letters, one letter less where the checksum says so."""
    raw, off = raw_bytes(text)
    letter = LETTER[raw]
    letter[1:] |= raw[:-1] == LEAD
    start = letter.copy()
    begins = np.zeros(len(raw) + 1, bool)
    begins[off] = True
    start[1:] &= ~letter[:-1] | begins[1:len(raw)]
    starts = np.flatnonzero(start)
    if not len(starts):
        return pa.array([], pa.large_string())
    data = LOWER[raw[letter]]
    place = np.cumsum(letter) - letter
    at = place[starts]
    size = np.diff(np.append(at, len(data)))
    chars = np.add.reduceat((data & 0xC0) != 0x80, at, dtype=np.int64)
    doc = np.searchsorted(off, starts, side="right") - 1
    state = np.fromiter((zlib.crc32(b":" if i is None else b"%d:" % i) for i in ids), np.uint32, len(ids))
    crc = crc_after(state[doc], data, at, size)
    hit = crc % np.uint32(every) == 0
    edited = []
    for i in np.flatnonzero(hit & (chars > least)):
        word = data[at[i]:at[i] + size[i]].tobytes().decode()
        k = int(crc[i]) % len(word)
        edited.append(word[:k] + word[k + 1:])
    keep = ~hit & (chars >= least)
    return pa.concat_arrays([strings(data[np.repeat(keep, size)], size[keep]), pa.array(edited, pa.large_string())])


def vocabulary(docs: DataFrame, every: int = 97, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """``word, n`` over whole texts."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 4 << 20):
                got = pc.value_counts(runs(b.column(0).to_pylist(), b.column(1), every, min_length))
                yield pa.RecordBatch.from_arrays([got.field(0).cast(pa.string()), got.field(1)], schema=schema)

    return (docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


class Letters:
    """Code points of an array of words, and their hashes: polynomials, so that an edit's hash follows from its word's."""

    def __init__(self, words: pa.Array):
        raw, off = raw_bytes(words)
        first = (raw & 0xC0) != 0x80
        then = np.append(raw[1:], np.uint8(0))
        self.data = np.where(raw == LEAD, (then + np.uint8(0x40)).astype(np.uint8), raw)[first]
        ends = np.append(0, np.cumsum(first))[off]
        self.starts, self.size = ends[:-1], np.diff(ends)

    def groups(self, cells: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of equal length, some at a time, with their letters as a matrix."""
        order = np.argsort(self.size, kind="stable")
        cut = np.flatnonzero(np.diff(self.size[order])) + 1
        for same in np.split(order, cut):
            long = int(self.size[same[0]]) if len(same) else 0
            step = max(1, cells // max(1, long * len(ALPHABET)))
            for k in range(0, len(same), step):
                rows = same[k:k + step]
                yield rows, self.data[self.starts[rows][:, None] + np.arange(long)]


def powers(n: int) -> np.ndarray:
    """BASE to the power n - 1, ..., 1, 0."""
    out = np.full(n, BASE, U64)
    out[:1] = 1
    return np.cumprod(out, dtype=U64)[::-1]


def bit_of(key: np.ndarray, k: int, base: int, blocks: int) -> np.ndarray:
    """The place of a hash's bit ``k``: all are in one block of the filter at ``base``, one in each of its 32-bit words."""
    block = base + ((key >> U64(40)) & U64(blocks - 1)).astype(np.int64)
    return block * BLOCK + 32 * k + ((key >> U64(5 * k)) & U64(31)).astype(np.int64)


def layout(counts: dict[int, int], filter_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks (a power of two) of the filter of each length: 16 bits a word, ``filter_bytes`` in all at most."""
    blocks = np.zeros(LONGEST + 1, np.int64)
    for length, n in counts.items():
        blocks[length] = 1 << max(0, (n * 16 // BLOCK - 1)).bit_length()
    while int(blocks.sum()) * (BLOCK // 8) > filter_bytes and blocks.max() > 1:
        blocks = np.where(blocks > 1, blocks // 2, blocks)
    return np.cumsum(blocks) - blocks, blocks


def filters(words: DataFrame, filter_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The filters as one array of bytes, with their layout."""
    length = F.least(F.char_length("word"), F.lit(LONGEST)).alias("length")
    base, blocks = layout({r.length: r.n for r in words.groupBy(length).agg(F.count("*").alias("n")).collect()}, filter_bytes)
    schema = pa.schema([("bit", pa.int64())])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = Letters(batch.column(0))
            for rows, m in letters.groups():
                key = mix(((m.astype(U64) + U64(1)) * powers(m.shape[1])).sum(axis=1, dtype=U64))
                at = min(m.shape[1], LONGEST)
                for k in range(PROBES):
                    yield pa.RecordBatch.from_arrays([pa.array(bit_of(key, k, int(base[at]), int(blocks[at])) + 1)], schema=schema)

    rows = (words.select("word").mapInArrow(places, "bit long").groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect())
    out = np.zeros(int(blocks.sum()) * (BLOCK // 8) + 4096, np.uint8)
    for r in rows:  # filter_bytes / 4096 rows at most
        at = (r.bucket - 1) * 4096
        part = np.frombuffer(bytes(r.bits), np.uint8)
        out[at:at + len(part)] |= part[:len(out) - at]
    return out, base, blocks


def edits(letters: np.ndarray, told: tuple[np.ndarray, np.ndarray, np.ndarray], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Edits of words of one length that the filters let through: row, letters, length of each."""
    n = letters.shape[1]
    power = powers(n)
    value = letters.astype(U64) + U64(1)
    terms = value * power
    sums = np.cumsum(terms, axis=1, dtype=U64)
    key = sums[:, -1]
    if n > least:
        # equal letters in a row give one word, whichever is left out: take the last
        left = np.append(letters[:, 1:] != letters[:, :-1], np.ones((len(letters), 1), bool), axis=1)
        row, at = np.nonzero(left)
        h = (sums[row, at] - terms[row, at]) * U64(BASE_INVERSE) + key[row] - sums[row, at]
        some = let_through(h, n - 1, told)
        row, at = row[some], at[some]
        keep = np.arange(n) != at[:, None]
        yield row, letters[row][keep], np.full(len(row), n - 1)
    row, at, new = np.nonzero(ALPHABET < letters[:, :, None])
    h = key[row] + (ALPHABET[new].astype(U64) - letters[row, at].astype(U64)) * power[at]
    some = let_through(h, n, told)
    row, at, new = row[some], at[some], new[some]
    out = letters[row]
    out[np.arange(len(row)), at] = ALPHABET[new]
    yield row, out.ravel(), np.full(len(row), n)


def let_through(key: np.ndarray, length: int, told: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    bits, base, blocks = told
    at = min(length, LONGEST)
    if not blocks[at]:
        return np.zeros(0, np.int64)
    key, some = mix(key), np.arange(len(key))
    for k in range(PROBES):
        place = bit_of(key, k, int(base[at]), int(blocks[at]))
        hit = np.flatnonzero((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
        key, some = key[hit], some[hit]
    return some


def spelled(letters: np.ndarray, size: np.ndarray) -> pa.Array:
    """Words of code points as strings."""
    wide = letters >= 0x80
    at = np.cumsum(1 + wide) - 1  # last byte of each
    out = np.empty(int(at[-1]) + 1 if len(at) else 0, np.uint8)
    out[at] = np.where(wide, letters - np.uint8(0x40), letters)
    out[at[wide] - 1] = LEAD
    ends = np.append(0, at + 1)[np.append(0, np.cumsum(size))]
    return strings(out, np.diff(ends))


def near_words(words: DataFrame, min_length: int = 5, filter_bytes: int = 64 << 20) -> DataFrame:
    """``word, near, near_n`` for all pairs of ``words(word, n)`` one edit apart, both ways."""
    told = words.sparkSession.sparkContext.broadcast(filters(words, filter_bytes))
    schema = pa.schema([("near", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, m in Letters(batch.column(0)).groups():
                for row, new, size in edits(m, told.value, min_length):
                    if len(row):
                        own = pa.array(rows[row])
                        yield pa.RecordBatch.from_arrays([spelled(new, size).cast(pa.string()), batch.column(0).take(own), batch.column(1).take(own)],
                                                         schema=schema)

    met = (words.select("word", "n").mapInArrow(probe, "near string, word string, n long")
           .join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near"))
    return met.select(F.inline(F.array(F.struct(F.col("word"), F.col("near"), F.col("near_n")),
                                       F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))))


def roots(links: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: the end of each chain, by doubling; chains must not close."""
    spark = links.sparkSession
    cur, path = save_as(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while cur.where("moved").limit(1).count():
        step = cur.select(F.col("word").alias("root"), F.col("root").alias("to"))
        nxt, to = save_as(cur.join(step, "root", "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "roots")
        forget(spark, path)
        cur, path = nxt, to
    return cur.select("word", "root")


def spelling_groups(docs: DataFrame, every: int = 97, min_length: int = 5, min_count: int = 3, ratio: int = 2,
                    filter_bytes: int = 64 << 20) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``docs(doc_id, text)``."""
    words = save(vocabulary(docs, every, min_length, min_count), "spelling-words")
    best = near_words(words, min_length, filter_bytes).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    has = -F.col("best.less") >= F.col("n") * ratio
    told = save(words.join(best, "word", "left").select(
        "word", F.when(has, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(has, -F.col("best.less")).alias("form_n")), "spelling-forms")
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
