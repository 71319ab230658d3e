"""Phrase collocations per language from bidirectional FM-indexes over word ids, one per shard.

Method.  Each task cuts its texts into shards of about ``shard_bytes`` and indexes each: words become ids (one per
language and word, so phrases of two languages never mix), every piece ends in the id 0, and the cyclic order of all
rotations by their first ``max_words`` ids gives a Burrows-Wheeler transform of the sequence and one of its reverse.
A phrase is a pair of synchronised intervals of these two orders; one step of ``extensions`` widens every interval by
every word on its left (or, with the roles of the two transforms swapped, on its right).

Lengths are mined one after another.  A shard extends the phrases of ``k - 1`` words that are frequent over all shards,
to the right and to the left; a phrase of ``k`` words that both ways reach has two frequent parts, which every
frequent phrase has.  The names of its two parts name it, the shards' interval sizes are summed, and those with
``min_count`` or more are the start of the next length.  Nothing is dropped before its global count is known.  A shard
learns what is frequent from a bitmap of fixed size; a false positive costs an extension that its sum then drops.

Scale.  Most phrases are rare, and rare ones are not sent.  First every task tells, packed in about three bytes a phrase, which
of 2^34 buckets of names its phrases fall in and how often; buckets whose sum over all tasks is below ``min_count`` hold no
frequent phrase.  Then a shard sends one row per distinct phrase of the other buckets, and these are summed exactly.  The indexes are a written table that each length scans with only the
columns it needs; no index is shuffled, and a task holds one at a time.  Words are counted by their text; longer phrases
are named by the pair of 64-bit names of their two parts, and a frequent phrase by a 64-bit hash of that pair.  Joins on names
run against written tables of frequent phrases only.  What reaches the driver are bitmaps of ``MARK_BITS`` bits.

Defined cases.  A null text has no words, a null language is ``und``.  Repeated rows and repeated ``doc_id`` count every
time.  An empty table gives no rows.  A text above ``shard_bytes`` is cut between pieces, so one piece is the least a
shard can hold.  Equal scores rank by count, then by phrase.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .edit import MARK_BITS, bitmap_of
from .store import save
from .text import LOWER, Words, mix, raw_bytes, word_hashes

BLANK = np.zeros(256, bool)
BLANK[[0x20, 9]] = True
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True

INDEX = "shard long, langs array<string>, words array<string>, lang_of array<int>, names array<long>, size array<int>, bwt binary, rbwt binary"
FOUND = "prefix long, suffix long, size long"
NAMED = "prefix long, suffix long, f long, name long"
BELOW = np.uint64(30)  # bits of a name below its bucket
PARTS = 1 << 10  # the highest bits of a bucket tell its part
LOCAL = 24  # bits of a bucket below its part
HELD = 1 << 20  # phrases of a task that are packed together


def order_of(key: np.ndarray) -> np.ndarray:
    """The order that sorts ``key``, ties in place; one plain sort where key and place fit in 63 bits."""
    if not len(key):
        return np.zeros(0, np.int64)
    bits = max(1, (len(key) - 1).bit_length())
    if int(key.max()).bit_length() + bits > 63:
        return np.argsort(key, kind="stable")
    both = key.astype(np.int64) << bits
    both |= np.arange(len(key))
    both.sort()
    return both & ((1 << bits) - 1)


def pair_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit name for each pair of names."""
    return mix(mix(a.view(np.uint64)) + np.uint64(0x9E3779B97F4A7C15) * b.view(np.uint64)).view(np.int64)


def shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Runs of ``(text, lang)`` with about ``limit`` bytes of text; longer texts are cut after a piece break."""
    texts, langs, held = [], [], 0
    for batch in batches:
        text, lang = (batch.column(batch.schema.get_field_index(n)).cast(pa.large_string()) for n in ("text", "lang"))
        size = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, at, done = np.cumsum(size), 0, 0
        while at < len(size):
            if size[at] > limit:
                for part in _cut(text[at].as_py().encode(), limit):
                    yield pa.array([part.decode()], pa.large_string()), lang.slice(at, 1)
                at, done = at + 1, int(total[at])
                continue
            to = max(at + 1, int(np.searchsorted(total, done + limit - held, side="right")))
            big = np.flatnonzero(size[at:to] > limit)
            to = at + int(big[0]) if len(big) else to
            texts.append(text.slice(at, to - at))
            langs.append(lang.slice(at, to - at))
            held, done, at = held + int(total[to - 1]) - done, int(total[to - 1]), to
            if held >= limit or at < len(size):
                yield pa.concat_arrays(texts), pa.concat_arrays(langs)
                texts, langs, held = [], [], 0
    if texts:
        yield pa.concat_arrays(texts), pa.concat_arrays(langs)


def _cut(raw: bytes, limit: int) -> Iterator[bytes]:
    ends = np.flatnonzero(BREAK[np.frombuffer(raw, np.uint8)]) + 1
    at = 0
    while at < len(raw):
        k = int(np.searchsorted(ends, at + limit))
        to = int(ends[k]) if k < len(ends) else len(raw)
        yield raw[at:to]
        at = to


def sequence(text: pa.Array, lang: pa.Array) -> tuple[np.ndarray, list, pa.Array, np.ndarray]:
    """Ids of all words with a 0 after each piece, the languages, and word and language number of ids 1, 2, ..."""
    raw, off = raw_bytes(text)
    code = pc.fill_null(lang, "und").dictionary_encode()
    if isinstance(code, pa.ChunkedArray):
        code = code.combine_chunks()
    langs = code.dictionary.to_pylist()
    word = ~(BLANK | BREAK)[raw]
    begins = np.zeros(len(raw) + 1, bool)
    begins[off] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | begins[1:len(raw)]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.int64), langs, pa.array([], pa.string()), np.zeros(0, np.int64)
    first = np.cumsum(word) - word  # place of a byte among the bytes of words
    ends = np.append(first[starts[1:]], int(word.sum())).astype(np.int64)
    data = LOWER[raw[word]]
    offsets = np.concatenate([[0], ends])
    told = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    v = len(told.dictionary)
    of = code.indices.to_numpy(zero_copy_only=False).astype(np.int64)[np.searchsorted(off, starts, side="right") - 1]
    both = of * v + told.indices.to_numpy(zero_copy_only=False)
    seen = np.zeros(v * len(langs), np.int64)
    seen[both] = 1
    names = np.flatnonzero(seen)
    ids = np.cumsum(seen)[both]
    marks = BREAK[raw] | begins[:len(raw)]
    place = np.cumsum(marks)[starts]
    piece = np.cumsum(np.append(0, np.diff(place) != 0))
    out = np.zeros(len(starts) + int(piece[-1]) + 1, np.int64)
    out[np.arange(len(starts)) + piece] = ids
    return out, langs, told.dictionary.take(pa.array(names % v)), names // v


def transform(ids: np.ndarray, depth: int) -> np.ndarray:
    """The id before each rotation, in the order of rotations by their first ``depth`` ids."""
    rank, width, order = ids, 1, None
    while width < depth:
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -width)
        order = order_of(key)
        key = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.append(0, key[1:] != key[:-1]))
        width *= 2
    return ids[(order_of(ids) if order is None else order) - 1].astype(np.int32)


def names_of(words: pa.Array, langs: list, of: np.ndarray) -> np.ndarray:
    data, off = raw_bytes(words)
    own = word_hashes(Words(data, off[:-1], off[1:], np.array([0, len(words)])))
    lang = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)
    return pair_names(own.view(np.int64), lang[of].view(np.int64))


def index(batches: Iterator[pa.RecordBatch], depth: int, limit: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for k, (text, lang) in enumerate(shards(batches, limit)):
        ids, langs, words, of = sequence(text, lang)
        if not len(ids):
            continue
        one = pa.array([0, len(words)], pa.int32())
        row = [pa.array([(part << 32) + k]), pa.array([langs], pa.list_(pa.string())), pa.ListArray.from_arrays(one, words.cast(pa.string())),
               pa.ListArray.from_arrays(one, pa.array(of.astype(np.int32))), pa.ListArray.from_arrays(one, pa.array(names_of(words, langs, of))),
               pa.ListArray.from_arrays(one, pa.array(np.bincount(ids)[1:].astype(np.int32))),
               pa.array([transform(ids, depth).tobytes()]), pa.array([transform(ids[::-1], depth).tobytes()])]
        yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(row, schema)], schema=schema)
        del ids, words, of, row
        pa.default_memory_pool().release_unused()


def extensions(bwt: np.ndarray, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """All extensions by one word of disjoint intervals in the order that ``bwt`` belongs to: the interval extended,
    the rows of it before this word's (what the other order's interval moves by), the number of rows, the new start."""
    here = np.empty(len(bwt), np.int32)
    here[order_of(bwt)] = np.arange(len(bwt), dtype=np.int32)  # where a row's rotation by one word back stands
    begin = np.cumsum(size) - size
    rows = (np.arange(int(size.sum())) + np.repeat(lo - begin, size)).astype(np.int32)
    key = np.repeat(np.arange(len(lo)) * (int(bwt.max()) + 1), size)
    key += bwt[rows]
    order = order_of(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    own, word = np.divmod(key[first], int(bwt.max()) + 1)
    count = np.diff(np.append(first, len(key)))
    real = word > 0
    return own[real], (first - begin[own])[real], count[real], here[rows[order[first]]][real].astype(np.int64)


def mine(size: np.ndarray, names: np.ndarray, bwt: np.ndarray, rbwt: np.ndarray, often: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """The shard's phrases one word longer than ``often`` has bitmaps: names of their two parts and their counts."""
    n, gid = size.astype(np.int64), names
    lo = int(len(bwt) - n.sum()) + np.cumsum(n) - n  # the ends of pieces come first
    rlo, prefix, suffix = lo, names, names
    for bits in often:
        at = gid & (MARK_BITS - 1)
        keep = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
        keep = keep[np.argsort(lo[keep])]
        lo, rlo, n, gid = lo[keep], rlo[keep], n[keep], gid[keep]
        right, ahead, count, back = extensions(rbwt, rlo, n)
        left, _, _, to = extensions(bwt, lo, n)
        _, x, y = np.intersect1d(lo[right] + ahead, to, assume_unique=True, return_indices=True)
        prefix, suffix = gid[right[x]], gid[left[y]]
        lo, rlo, n, gid = to[y], back[x], count[x], pair_names(prefix, suffix)
    return prefix, suffix, n


def packed_buckets(names: np.ndarray, n: np.ndarray, least: int) -> Iterator[tuple[int, bytes]]:
    """``(part, counts)`` per part: the buckets of phrases and their counts (none above ``least``, which settles a sum)."""
    from zstandard import ZstdCompressor
    small = ZstdCompressor(level=1)
    bucket = (names.view(np.uint64) >> BELOW).astype(np.int64)
    order = order_of(bucket)
    bucket = bucket[order]
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[:len(bucket)])
    count = np.minimum(np.add.reduceat(n[order], first), least).astype("<u4")
    bucket = bucket[first]
    edge = np.searchsorted(bucket >> LOCAL, np.arange(PARTS + 1))
    for part in np.flatnonzero(np.diff(edge)).tolist():
        own, own_n = bucket[edge[part]:edge[part + 1]] & ((1 << LOCAL) - 1), count[edge[part]:edge[part + 1]]
        head = np.bincount(own >> 16, minlength=1 << (LOCAL - 16)).astype("<u4")
        yield part, small.compress(head.tobytes() + (own & 0xFFFF).astype("<u2").tobytes() + own_n.tobytes())


def frequent_buckets(part: int, rows: list[bytes], least: int) -> np.ndarray:
    """The buckets of a part whose counts over all ``packed_buckets`` rows add up to ``least`` or more."""
    from zstandard import ZstdDecompressor
    big, high, locals_, counts = ZstdDecompressor(), 1 << (LOCAL - 16), [], []
    for row in rows:
        raw = big.decompress(row)
        head = np.frombuffer(raw, "<u4", high)
        m = int(head.sum())
        locals_.append((np.repeat(np.arange(high), head) << 16) | np.frombuffer(raw, "<u2", m, 4 * high))
        counts.append(np.frombuffer(raw[4 * high + 2 * m:], "<u4", m).astype(np.int64))
    bucket, count = np.concatenate(locals_), np.concatenate(counts)
    order = order_of(bucket)
    bucket = bucket[order]
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[:len(bucket)])
    return (part << LOCAL) + bucket[first][np.add.reduceat(count[order], first) >= least]


def arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def phrases(docs: DataFrame, min_count: int = 30, max_words: int = 4, shard_bytes: int = 2 << 20) -> tuple[list[DataFrame], DataFrame]:
    """Tables of phrases of 1 to ``max_words`` words that occur ``min_count`` times or more, and ``(lang, n)``.

    A phrase has ``name``, ``prefix`` and ``suffix`` (names of all but its last and first word), ``lang``, ``phrase``, ``f``,
    ``heads`` (counts of its first 1, 2, ... words) and ``tails`` (counts of all but its first 1, 2, ... words)."""
    shape, found_shape, named_shape = arrow(INDEX), arrow(FOUND), arrow(NAMED)
    context = docs.sparkSession.sparkContext
    built = save(docs.select("text", "lang").mapInArrow(lambda b: index(b, max_words, shard_bytes, shape), INDEX), "fm-index",
                 {"parquet.block.row.count.limit": "1"})  # a row is a whole shard
    words = (built.select("langs", F.explode(F.arrays_zip("words", "lang_of", "names", "size")).alias("w"))
             .select(F.element_at("langs", F.col("w.lang_of") + 1).alias("lang"), F.col("w.words").alias("phrase"), "w.names", "w.size"))
    counts = save(words.groupBy("lang", "phrase").agg(F.min("names").alias("name"), F.sum("size").alias("f")), "fm-words")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    none = F.array().cast("array<long>")
    level = save(counts.where(F.col("f") >= min_count).withColumns({"prefix": F.lit(None).cast("long"), "suffix": F.lit(None).cast("long"),
                                                                    "heads": none, "tails": none}), "fm-phrases")
    out, often = [level], []
    for _ in range(2, max_words + 1):
        often = [*often, context.broadcast(bitmap_of(level, F.pmod("name", F.lit(MARK_BITS))))]

        def mined(batches: Iterator[pa.RecordBatch], often=often) -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                for i in range(batch.num_rows):
                    size, names = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (0, 1))
                    bwt, rbwt = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int32) for c in (2, 3))
                    yield mine(size, names, bwt, rbwt, [b.value for b in often])

        def hint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for prefix, suffix, n in chain(mined(batches), [(None, None, None)]):
                if n is not None:
                    held.append((pair_names(prefix, suffix), n))
                    size += len(n)
                if size and (n is None or size > HELD):
                    parts, counts = zip(*packed_buckets(*(np.concatenate(x) for x in zip(*held)), min_count))
                    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(counts, pa.binary())], ["part", "counts"])
                    held, size = [], 0

        def settle(key: tuple, rows: pa.Table) -> pa.Table:
            bucket = frequent_buckets(key[0].as_py(), rows["counts"].to_pylist(), min_count)
            return pa.table({"bit": pa.array(bucket & (MARK_BITS - 1), pa.int64())})

        built_columns = built.select("size", "names", "bwt", "rbwt")
        hints = built_columns.mapInArrow(hint, "part int, counts binary").groupBy("part").applyInArrow(settle, "bit long")
        useful = context.broadcast(bitmap_of(hints, F.col("bit")))

        def longer(batches: Iterator[pa.RecordBatch], mined=mined, useful=useful) -> Iterator[pa.RecordBatch]:
            for cols in mined(batches):
                bit = (pair_names(cols[0], cols[1]).view(np.uint64) >> BELOW).astype(np.int64) & (MARK_BITS - 1)
                keep = (useful.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                cols = [c[keep] for c in cols]
                for at in range(0, len(cols[0]), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at:at + (1 << 18)]) for c in cols], schema=found_shape)

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                name = pair_names(*(b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(name)], schema=named_shape)

        summed = (built_columns.mapInArrow(longer, FOUND)
                  .groupBy("prefix", "suffix").agg(F.sum("size").alias("f")).where(F.col("f") >= min_count).mapInArrow(named, NAMED))
        p = level.select(F.col("name").alias("prefix"), "lang", F.col("phrase").alias("head"), F.col("f").alias("pf"), "heads")
        s = level.select(F.col("name").alias("suffix"), F.substring_index("phrase", " ", -1).alias("last"), F.col("f").alias("sf"), "tails")
        level = save(summed.join(p, "prefix").join(s, "suffix").select(
            "name", "prefix", "suffix", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "f",
            F.concat("heads", F.array("pf")).alias("heads"), F.concat(F.array("sf"), "tails").alias("tails")), "fm-phrases")
        out.append(level)
    return out, totals


def collocations(docs: DataFrame, min_count: int = 30, max_words: int = 4, cover: int = 80, top: int = 2000,
                 shard_bytes: int = 2 << 20) -> DataFrame:
    """The ``top`` phrases of each language of ``docs(text, lang)``: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` is the phrase's count, ``l`` and ``r`` those of the two parts at the cut with the lowest
    ``floor(2000000 a / (l + r))``; ties take the first cut.  A phrase goes if a longer one around it has ``cover`` percent of
    its count or more."""
    levels, totals = phrases(docs, min_count, max_words, shard_bytes)
    exact = "decimal(38,0)"
    scored = []
    for k, level in enumerate(levels[1:], 2):
        cuts = []
        for j in range(1, k):
            lf, rf = F.col("heads")[j - 1], F.col("tails")[j - 1]
            score = F.call_function("div", F.col("f").cast(exact) * F.lit(2000000).cast("decimal(7,0)"), lf.cast("decimal(20,0)") + rf.cast("decimal(20,0)"))
            cuts.append(F.struct(score.alias("score"), F.lit(j).alias("cut"), lf.alias("l"), rf.alias("r")))
        rows = level.withColumn("best", cuts[0] if k == 2 else F.least(*cuts))
        if k < max_words:  # a longer phrase around this one is, or holds, one that is a word longer and no rarer
            around = (levels[k].select(F.col("prefix").alias("name"), F.col("f").alias("wide"))
                      .unionByName(levels[k].select(F.col("suffix").alias("name"), F.col("f").alias("wide"))).groupBy("name").agg(F.max("wide").alias("wide")))
            rows = rows.join(around, "name", "left").where(
                F.col("wide").isNull() | (F.col("wide").cast("decimal(20,0)") * 100 < F.col("f").cast("decimal(20,0)") * cover))
        scored.append(rows.select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "best.score"))
    both = scored[0]
    for s in scored[1:]:
        both = both.unionByName(s)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = both.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
