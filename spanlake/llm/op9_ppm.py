"""Language-model scores by prediction by partial matching (PPM) over bytes.

Method.  The strings of up to ``order + 1`` bytes of the training documents are counted: a context and the byte after it.
The probability of a byte is taken in the longest context seen in training; a byte that is new to
a context escapes to the context one byte shorter (escape estimate D: half an occurrence
of every distinct follower), and there the bytes already seen in the longer context are
excluded.  Order -1 gives every byte the same share.  A text ends with byte 0xFF, which UTF-8 never
uses, and starts after ``order`` such bytes.  What a shorter context leaves to the bytes that are new to a longer one is a
ratio of whole numbers: with N(c) occurrences of the shorter context c, S of them before bytes seen in the longer
one, and d such bytes, it is (2 (N(c) - S) + d) / 2 N(c).  So a string's probability takes only the counts of its own
ends and of their contexts.

The base is a unigram model over words with 0.5 added to every count.

Scale.  Documents are read once in blocks of some MB.  A block counts its distinct words and byte
strings and hands them out by hash in packed arrays, one row per block and hash part, so skewed words
cost one number per block.  Strings go by the hash of the last ``order - 1`` bytes of their context: then a part has all
that two neighbouring context lengths need, and a key has at most 2^16 strings.  Each part sums its own words and strings
over all blocks and hands the sums of the strings without their first byte to the parts of the next level, with the
strings still without an answer; so down to contexts of one byte, of which there are at most 2^16 strings: these are
broadcast.  The answers go back only to the blocks that asked.  A block keeps its documents
as compressed bytes; all of this lies in tables in the shared folder.  No string is dropped, and vocabularies and models
of any size never meet in one place.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import save, slots
from .text import LOWER, crc_mod, mix, raw_bytes, slices, split_words, word_hashes

U64 = np.uint64
END = 0xFF
BLOCK_BYTES = 12 << 20
SLICE = 2 << 20
ROW_STRINGS = 1 << 20


def _padded(arr: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, each after ``order`` end bytes and with one behind it; and where each text starts."""
    raw, off = raw_bytes(arr)
    size = np.diff(off)
    begin = np.cumsum(np.concatenate([[0], size[:-1] + order + 1])) + order if len(size) else np.zeros(0, np.int64)
    out = np.full(len(raw) + (order + 1) * len(size), END, np.uint8)
    out[np.arange(len(raw)) + np.repeat(begin - off[:-1], size)] = LOWER[raw]
    return out, begin


def _grams(data: np.ndarray, begin: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All strings of ``order + 1`` bytes, as numbers, and which of them end inside a text or at its end."""
    code = np.zeros(max(0, len(data) - order), U64)
    for k in range(order + 1):
        code = (code << U64(8)) | data[k:len(data) - order + k].astype(U64)
    ok = np.ones(len(code), bool)  # a string that reaches from one text into the next's padding does not count
    for b in begin[1:].tolist():
        ok[b - order - order:b - order] = False
    return code, ok


def _pack(a: np.ndarray) -> bytes:
    """An array as compressed byte planes: sorted strings differ in few of them."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def _unpack(x: bytes | None, kind) -> np.ndarray:
    size = int.from_bytes(x[:8], "little") if x else 0
    if not size:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(x[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _joined(xs, kind) -> np.ndarray:
    return np.concatenate([_unpack(x, kind) for x in xs] or [np.zeros(0, kind)])


def _last(code: np.ndarray, size: int) -> np.ndarray:
    """The last ``size`` bytes of each string."""
    return code & U64((1 << (8 * size)) - 1)


def _parts_of(code: np.ndarray, k: int, parts: int) -> np.ndarray:
    """The part of strings of ``k + 1`` bytes or their ends: by hash of the ``k - 1`` bytes before the last."""
    return ((mix(_last(code >> U64(8), max(0, k - 1))) >> U64(40)) % U64(parts)).astype(np.int64)


def _dealt(part: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """``(part, rows of each array)`` for every part that has rows, in their order, at most ROW_STRINGS at once."""
    at = np.argsort(part, kind="stable")
    part = part[at]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist() + [len(part)] if len(part) else [0]
    for lo, hi in zip(cuts, cuts[1:]):
        for x in range(lo, hi, ROW_STRINGS):
            y = min(hi, x + ROW_STRINGS)
            yield (int(part[lo]), *(a[at[x:y]] for a in arrays))


def _blocks(docs: DataFrame, order: int, parts: int, fold: int) -> DataFrame:
    """``(block, part, payload)``: part -1 the documents and their bytes, parts 0.. the words and strings by hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            block = uuid.uuid4().hex
            hashes, trains, ids, sizes, grams, times, texts = [], [], [], [], [], [], []
            for b in held:
                own = b.column(0).to_pylist()
                out = crc_mod(own) == fold
                w = split_words(b.column(1), lower=True)
                hashes.append(word_hashes(w)), trains.append(np.repeat(~out, w.counts()))
                ids += own
                for some, weight in ((~out, 1), (out, 0)):
                    if some.any():
                        code, ok = _grams(*_padded(b.column(1).filter(pa.array(some)), order), order)
                        g, t = np.unique(code[ok], return_counts=True)
                        grams.append(g), times.append(t * weight)
                raw, off = raw_bytes(b.column(1))
                texts.append(raw), sizes.append(np.diff(off))
            words, which = np.unique(np.concatenate(hashes), return_inverse=True)
            seen = np.bincount(which[np.concatenate(trains)], minlength=len(words)).astype(np.int64)
            grams, times = _merge(grams, times)
            wp, gp = _word_parts(words, parts), _parts_of(grams, order, parts)
            rows: dict[int, list[bytes]] = {}
            for at, kinds in ((0, (wp, words, seen)), (2, (gp, grams, times))):
                p, x, n = kinds
                by = np.argsort(p, kind="stable")
                cut = np.searchsorted(p[by], np.arange(parts + 1))
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    own = by[cut[k]:cut[k + 1]]
                    rows.setdefault(k, [b""] * 4)[at:at + 2] = [_pack(x[own]), _pack(n[own].astype(np.uint32))]
            sink = pa.BufferOutputStream()
            own = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(sizes))], ["doc_id", "bytes"])
            with pa.ipc.new_stream(sink, own.schema) as s:
                s.write_batch(own)
            rows[-1] = [sink.getvalue().to_pybytes(), _pack(np.concatenate(texts)), b"", b""]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * len(rows)), pa.array(list(rows), pa.int32()), *(pa.array(list(c), pa.binary()) for c in zip(*rows.values()))],
                ["block", "part", "a", "b", "c", "d"])
        for batch in batches:
            for b in slices(batch, "text", SLICE):
                held.append(b)
                size += b.nbytes
                if size >= BLOCK_BYTES:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()
    return docs.mapInArrow(run, "block string, part int, a binary, b binary, c binary, d binary")


def _merge(codes: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code = np.concatenate(codes) if codes else np.zeros(0, U64)
    n = np.concatenate(times).astype(np.int64) if times else np.zeros(0, np.int64)
    at = np.argsort(code, kind="stable")
    code, n = code[at], n[at]
    begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[begin], np.add.reduceat(n, begin) if len(begin) else n


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _find(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted ``where``, and which of them hold ``what``."""
    if not len(where):
        return np.zeros(len(what), np.int64), np.zeros(len(what), bool)
    at = np.minimum(np.searchsorted(where, what), len(where) - 1)
    return at, where[at] == what


class Level:
    """Strings of ``k + 1`` bytes seen in training (sorted, with counts): all those that share ends of ``k`` - 1 context bytes."""

    def __init__(self, code: np.ndarray, n: np.ndarray, k: int):
        self.k, self.code, self.n = k, code, n
        begin = _starts(code >> U64(8))
        self.ctx = code[begin] >> U64(8)
        kinds = np.diff(np.append(begin, len(code)))
        total = np.add.reduceat(n, begin) if len(n) else n
        self.total = total
        if k == 0:  # below, every byte has the same share
            self.low, self.low_n = np.zeros(0, U64), np.zeros(0, np.int64)
            rest = np.log10(256.0 - kinds) - np.log10(256.0)
        else:
            # the strings without their first byte, with their counts and those of their contexts
            self.low, back = np.unique(_last(code, k), return_inverse=True)
            self.low_n = np.zeros(len(self.low), np.int64)
            np.add.at(self.low_n, back, n)
            low_begin = _starts(self.low >> U64(8))
            low_total = np.add.reduceat(self.low_n, low_begin) if len(n) else n
            low_total = np.repeat(low_total, np.diff(np.append(low_begin, len(self.low))))
            both = np.add.reduceat(self.low_n[back], begin) if len(n) else n
            of = low_total[back[begin]]
            rest = np.log10(2.0 * (of - both) + kinds) - np.log10(2.0 * of)
        # log10 of what is added where a byte is new to the context
        self.leave = np.log10(kinds) - np.log10(2.0 * total) - rest

    def ask(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For strings that end with the given ones: log10 of the share that is known here, and whether that is all of it."""
        code = _last(code, self.k + 1)
        value = np.zeros(len(code))
        c, known = _find(self.ctx, code >> U64(8))
        value[known] = self.leave[c[known]]
        at, seen = _find(self.code, code)
        value[seen] = np.log10(2.0 * self.n[at[seen]] - 1) - np.log10(2.0 * self.total[c[seen]])
        return value, seen


_ROWS = "block string, part int, a binary, b binary, tokens long, distinct long"
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]
# what a row of ``_ROWS`` holds, unless ``block`` is a block's name
_TOTALS, _ANSWERS, _SEEN, _OPEN = "*", "answers", "seen", "open"


def _hand_down(level: Level, origin: np.ndarray, value: np.ndarray, parts: int) -> Iterator[tuple]:
    """Rows for the parts of the level below: its strings with counts, and the strings without an answer so far."""
    for p, x, n in _dealt(_parts_of(level.low, level.k - 1, parts), level.low, level.low_n):
        yield (_SEEN, p, _pack(x), _pack(n), 0, 0)
    for p, x, v in _dealt(_parts_of(origin, level.k - 1, parts), origin, value):
        yield (_OPEN, p, _pack(x), _pack(v), 0, 0)


def _answers(origin: np.ndarray, value: np.ndarray, order: int, parts: int) -> Iterator[tuple]:
    for p, x, v in _dealt(_parts_of(origin, order, parts), origin, value):
        yield (_ANSWERS, p, _pack(x), _pack(v), 0, 0)


def _sum_part(order: int, parts: int):
    """One hash part: its words' counts over all blocks, sent back to each block; its strings summed, answered where
    they were seen and handed down otherwise."""
    def run(df: pd.DataFrame) -> pd.DataFrame:
        part = int(df["part"].iloc[0])
        words = [_unpack(x, U64) for x in df["a"]]
        code, n = _merge(words, [_unpack(x, np.uint32) for x in df["b"]])
        rows = [(b, part, _pack(n[np.searchsorted(code, w)]), b"", 0, 0) for b, w in zip(df["block"], words)]
        rows.append((_TOTALS, part, b"", b"", int(n.sum()), int((n > 0).sum())))
        code, n = _merge([_unpack(x, U64) for x in df["c"]], [_unpack(x, np.uint32) for x in df["d"]])
        level = Level(code[n > 0], n[n > 0], order)
        value, done = level.ask(code)
        rows += _answers(code[done], value[done], order, parts)
        rows += _hand_down(level, code[~done], value[~done], parts)
        return pd.DataFrame(rows, columns=_NAMES)
    return run


def _next_part(k: int, order: int, parts: int):
    """One hash part of the strings of ``k + 1`` bytes, for those that no longer context has answered."""
    def run(df: pd.DataFrame) -> pd.DataFrame:
        seen, left = df[df["block"] == _SEEN], df[df["block"] == _OPEN]
        level = Level(*_merge([_joined(seen["a"], U64)], [_joined(seen["b"], np.int64)]), k)
        origin, value = _joined(left["a"], U64), _joined(left["b"], np.float64)
        more, done = level.ask(origin)
        value = value + more
        rows = [*_answers(origin[done], value[done], order, parts), *_hand_down(level, origin[~done], value[~done], parts)]
        return pd.DataFrame(rows, columns=_NAMES)
    return run


def _last_levels(spark, rows: DataFrame, k: int, order: int, parts: int) -> DataFrame:
    """Answers to all that is left at contexts of ``k`` <= 1 bytes; at most 2^16 strings are broadcast."""
    got = rows.where(F.col("block") == _SEEN).select("a", "b").collect()
    code, n = _merge([_joined([bytes(r.a) for r in got], U64)], [_joined([bytes(r.b) for r in got], np.int64)])
    levels = []
    while k >= 0:
        levels.append(Level(code, n, k))
        code, n, k = levels[-1].low, levels[-1].low_n, k - 1
    held = spark.sparkContext.broadcast(levels)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            origin, value = _joined(df["a"], U64), _joined(df["b"], np.float64)
            left = np.arange(len(origin))
            for level in held.value:
                more, done = level.ask(origin[left])
                value[left] += more
                left = left[~done]
            value[left] -= np.log10(256.0)  # what ``leave`` of the empty context is a share of
            yield pd.DataFrame(list(_answers(origin, value, order, parts)), columns=_NAMES)
    return rows.where(F.col("block") == _OPEN).mapInPandas(run, _ROWS)


def _answer_part(df: pd.DataFrame) -> pd.DataFrame:
    """One hash part: the log probability of each string of each block, in the block's order."""
    part = int(df["part"].iloc[0])
    own = df["block"] == _ANSWERS
    code, value = _joined(df["c"][own], U64), _joined(df["d"][own], np.float64)
    at = np.argsort(code)
    code, value = code[at], value[at]
    return pd.DataFrame([(b, part, b"", _pack(value[np.searchsorted(code, _unpack(x, U64))])) for b, x in zip(df["block"][~own], df["c"][~own])],
                        columns=["block", "part", "a", "b"])


def scores(docs: DataFrame, order: int = 5, fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per input row.

    Documents whose crc32(doc_id as text) mod 5 is ``fold`` are held out.  Null and empty texts have the end
    token only; a null id counts as the empty text in the fold; repeated rows count as often as they
    occur; without any training document every byte has the same share; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = max(16, slots(spark))
    blocks = save(_blocks(base, order, parts, fold), "ppm-blocks")
    sums = save(blocks.where("part >= 0").groupBy("part").applyInPandas(_sum_part(order, parts), _ROWS), "ppm-sums")
    words, distinct = sums.where(F.col("block") == _TOTALS).agg(F.sum("tokens"), F.sum("distinct")).first()
    own = _train_docs(base, fold)
    total = (words or 0) + own  # each training document has one end
    kinds = (distinct or 0) + (1 if own else 0)
    width = np.log10(total + 0.5 * (kinds + 1))
    end = float(np.log10(own + 0.5) - width)

    level, answers = sums, sums.where(F.col("block") == _ANSWERS)
    for k in range(order - 1, 1, -1):
        level = save(level.where(F.col("block").isin(_SEEN, _OPEN)).groupBy("part").applyInPandas(_next_part(k, order, parts), _ROWS), "ppm-level")
        answers = answers.unionByName(level.where(F.col("block") == _ANSWERS))
    answers = answers.unionByName(_last_levels(spark, level, min(order - 1, 1), order, parts))
    asked = (blocks.where("part >= 0").select("block", "part", "c", F.lit(None).cast("binary").alias("d"))
             .unionByName(answers.select("block", "part", F.col("a").alias("c"), F.col("b").alias("d"))))
    values = asked.groupBy("part").applyInPandas(_answer_part, "block string, part int, a binary, b binary")

    def by_block(df: pd.DataFrame) -> pd.DataFrame:
        docs_row = df[df["part"] == -1].iloc[0]
        back = df[df["part"] >= 0].sort_values("part", kind="stable")
        with pa.ipc.open_stream(docs_row["a"]) as s:
            meta = s.read_all()
        size = meta["bytes"].to_numpy()
        texts = _texts(_unpack(docs_row["b"], np.uint8), size)
        known, words_score, n_words = _by_word(texts, _joined(back["a"], np.int64), width, parts)
        return pd.DataFrame({"doc_id": pd.array(meta["doc_id"].to_pylist(), "Int64"), "n_words": n_words, "known": known,
                             "words_score": words_score, "score": _by_byte(texts, _joined(back["b"], np.float64), order, parts)})

    counts = sums.where(~F.col("block").isin(_TOTALS, _ANSWERS, _SEEN, _OPEN)).select("block", "part", "a", F.lit(None).cast("binary").alias("b"))
    lists = blocks.where("part = -1").select("block", "part", "a", "b").unionByName(counts).unionByName(values)
    both = lists.groupBy("block").applyInPandas(by_block, "doc_id long, n_words long, known long, words_score double, score double")
    return both.select(
        "doc_id", _held_out(F.col("doc_id"), fold).alias("held_out"),
        (F.col("n_words") + 1).alias("n_tokens"), (F.col("known") + F.lit(1 if own else 0)).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("words_score") + F.lit(end)).alias("base_score"), "score")


def _texts(data: np.ndarray, size: np.ndarray) -> list[pa.Array]:
    """The texts of a block, in runs of about SLICE bytes."""
    off = np.concatenate([[0], np.cumsum(size)])
    out, at = [], 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE, side="right")) - 1)
        out.append(pa.Array.from_buffers(pa.large_string(), to - at, [None, pa.py_buffer((off[at:to + 1] - off[at]).tobytes()),
                                                                      pa.py_buffer(data[off[at]:off[to]].tobytes())]))
        at = to
    return out


def _in_order(part: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values that the parts sent back one part after the other, in the block's order."""
    out = np.empty(len(part), values.dtype)
    out[np.argsort(part, kind="stable")] = values
    return out


def _word_parts(words: np.ndarray, parts: int) -> np.ndarray:
    return ((words >> U64(40)) % U64(parts)).astype(np.int64)


def _by_word(texts: list[pa.Array], counts: np.ndarray, width: float, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words seen in training, log10 probability and number of all words of each text of a block."""
    runs = []
    for arr in texts:
        w = split_words(arr, lower=True)
        runs.append((*np.unique(word_hashes(w), return_inverse=True), w.first))
    words = np.unique(np.concatenate([r[0] for r in runs]))
    count = _in_order(_word_parts(words, parts), counts)
    out = []
    for some, which, first in runs:
        c = count[np.searchsorted(words, some)][which]
        logs = np.concatenate([[0.0], np.cumsum(np.log10(c + 0.5) - width)])
        known = np.concatenate([[0], np.cumsum(c > 0)])
        out.append((np.diff(known[first]), np.diff(logs[first]), np.diff(first)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _by_byte(texts: list[pa.Array], values: np.ndarray, order: int, parts: int) -> np.ndarray:
    """log10 probability of each text of a block and its end; ``values`` of its distinct strings, by part."""
    runs = []
    for arr in texts:
        padded, begin = _padded(arr, order)
        code, ok = _grams(padded, begin, order)
        strings, which = np.unique(code[ok], return_inverse=True)
        place = np.zeros(len(code), np.uint32)
        place[ok] = which
        runs.append((strings, place, ok, begin, np.diff(raw_bytes(arr)[1])))
    strings = np.unique(np.concatenate([r[0] for r in runs]))
    value = _in_order(_parts_of(strings, order, parts), values)
    out = []
    for some, place, ok, begin, n in runs:
        own = np.where(ok, value[np.searchsorted(strings, some)][place], 0.0)
        total = np.concatenate([[0.0], np.cumsum(own)])
        out.append(total[begin - order + n + 1] - total[begin - order])
    return np.concatenate(out)


def _held_out(doc_id, fold: int):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == fold


def _train_docs(base: DataFrame, fold: int) -> int:
    return base.where(~_held_out(F.col("doc_id"), fold)).count()
