"""Line dedup by an exact set-similarity join over the words of lines.

Method.  A line is the set of its words (A-Z lower-cased); lines without words are never touched.  Words are
ordered by rarity, and a line posts its first ``|x| - ceil(t |x|) + 1`` words: two sets with Jaccard ``t`` or more
share one of these.  Lines that meet in a word's list pass the length filter, the positional filter (words left after
the shared one on both sides) and a parity-sketch filter (a lower bound of the symmetric difference) before the
exact Jaccard is taken from their whole sets.  A line goes if an earlier line, by ``(doc_id, line number)``, has
Jaccard ``t`` or more with it; lines are judged on the input.

Rarity is the corpus count of a word's hash bucket (2^22 of them: a table of fixed size) in steps of an eighth, one byte each, ties
by hash: any order that all lines share keeps the prefix filter exact, and this one puts rare words first.  A word that a bitmap of fixed size
knows to occur once in the corpus is not posted: nobody can share it.

A line needs one earlier similar line, not all.  So each list names, for every member, the earlier member that its sketch says
is nearest, and the nearest of all lists is verified by whole sets.  Lines that this leaves open (few: those whose nearest
earlier line is under ``t`` after all) then meet every earlier line that passes the filters, in the lists of their own words
only.  There the postings bring the whole sets along, so a pair is settled where it meets and only late lines leave a task.

Scale.  Equal lines are one member of the join, whatever their number.  Postings travel as packed arrays, byte planes
compressed, one row per task and hash part.  Whole sets are only read for lines that passed all filters with some other line.  A list
of more than ``LONG`` members is cut into blocks by size; pairs of blocks whose sizes can match are dealt out as rows of
their own.  No pairs leave a task: the first round sends one row per line and part, the second at most one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .edit import MARK_BITS, bitmap_of, edit_texts
from .store import save, slots
from .text import LOWER, SPACE, mix, raw_bytes, slices

U64 = np.uint64
BUCKETS = 1 << 22
LOW = U64(42)  # bits of a word's hash below its bucket
LONG = 4096
SPLIT = 64  # parts of the tables that tasks send
NARROW = 56  # lines of so many words at most send 64 bits of sketch, others 128
POST = np.dtype([("word", "<u8"), ("line", "<i8"), ("size", "<u4"), ("s1", "<u8"), ("s2", "<u8"), ("doc", "<i8"), ("num", "<u4")])
FOUND = np.dtype([("b", "<i8"), ("far", "<i8"), ("doc", "<i8"), ("num", "<u4"), ("a", "<i8")])
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def line_words(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(row, number, hashes, first)`` of all lines of a string column: each line's row and number, and the hashes of its words
    (A-Z lower-cased), those of line ``i`` from ``first[i]`` up to ``first[i + 1]``.  A word is hashed by eight bytes at a time."""
    raw, off = raw_bytes(arr)
    cut = np.flatnonzero(raw == 10)
    lines = np.bincount(np.searchsorted(off, cut, side="right") - 1, minlength=len(off) - 1) + 1
    begin = np.sort(np.concatenate([off[:-1], cut + 1]), kind="stable")
    row = np.repeat(np.arange(len(off) - 1), lines)
    number = np.arange(len(row)) - np.repeat(np.cumsum(lines) - lines, lines)
    if not len(raw):
        return row, number, np.zeros(0, U64), np.zeros(len(row) + 1, np.int64)
    blank = np.append(SPACE[raw], True)
    head, tail = np.append(True, blank[:-1]), np.append(blank[1:], True)
    head[off] = True
    tail[off[off > 0] - 1] = True
    starts = np.flatnonzero(head & ~blank)
    size = np.flatnonzero(tail & ~blank) + 1 - starts
    low = np.zeros(len(raw) + 8, np.uint8)
    low[:-8] = LOWER[raw]
    eight = np.ndarray(len(raw) + 1, "<u8", low, strides=(1,))
    h = mix((eight[starts] & _FIRST[np.minimum(size, 8)]) ^ (size.astype(U64) * U64(0xA24BAED4963EE407)))
    more, done = np.flatnonzero(size > 8), 8
    while len(more):
        h[more] = mix(h[more] * U64(0x9E3779B97F4A7C15) ^ (eight[starts[more] + done] & _FIRST[np.minimum(size[more] - done, 8)]))
        done += 8
        more = more[size[more] > done]
    return row, number, h, np.append(np.searchsorted(starts, begin), len(starts))


def line_ids(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit id of each line's word sequence (0: no words)."""
    size = np.diff(first)
    ids = np.zeros(len(size), U64)
    some = np.flatnonzero(size)
    if len(some):
        places = mix(np.arange(1, int(size.max()) + 1, dtype=U64))
        keyed = mix(h + places[np.arange(len(h)) - np.repeat(first[:-1], size)])
        ids[some] = mix(np.add.reduceat(keyed, first[some]) + size[some].astype(U64)) | U64(1)
    return ids.view(np.int64)


def _packed(p: np.ndarray) -> bytes:
    """Records as compressed byte planes: equal high bytes and numbers in order shrink to little."""
    from zstandard import ZstdCompressor
    return ZstdCompressor(level=1).compress(np.ascontiguousarray(p.view(np.uint8).reshape(len(p), -1).T).tobytes())


def _unpacked(rows: list[bytes]) -> np.ndarray:
    from zstandard import ZstdDecompressor
    tool = ZstdDecompressor()
    planes = [np.frombuffer(tool.decompress(x), np.uint8).reshape(POST.itemsize, -1) for x in rows]
    return np.ascontiguousarray(np.concatenate(planes, axis=1).T).view(POST).ravel() if planes else np.zeros(0, POST)


def word_sets(h: np.ndarray, first: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(words, first)``: per line its distinct words in the common order, rarest first.  A word is its hash with
    the bucket replaced by the bucket's rank, so numeric order is the common order."""
    line = np.repeat(np.arange(len(first) - 1), np.diff(first))
    v = (rank[(h >> LOW).astype(np.int64)].astype(U64) << LOW) | (h & ((U64(1) << LOW) - U64(1)))
    key = line.astype(U64) << U64(48) | v >> U64(16)
    at = np.argsort(key) if len(first) < 1 << 16 else np.zeros(0, np.int64)
    key, told = key[at], v[at]
    if len(at) < len(v) or np.any((key[1:] == key[:-1]) & (told[1:] != told[:-1])):  # the upper bits do not settle the order
        at = np.lexsort((v, line))
    v, line = v[at], line[at]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (line[1:] != line[:-1])
    v, line = v[new], line[new]
    return v, np.searchsorted(line, np.arange(len(first)))


def read_lines(docs: DataFrame) -> DataFrame:
    """One pass over the texts: ``(doc_id, tid, number, line)`` per line with words, and, in rows without ``line``, each
    task's counts of word buckets and bitmaps of words seen and seen again (``number`` tells which part, ``n`` holds them)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdCompressor
        n = np.zeros(BUCKETS, np.uint32)
        seen = np.zeros(MARK_BITS, np.uint8)  # 1: a word here, 2: more than one
        names = ["doc_id", "tid", "number", "line", "n"]
        for batch in batches:
            for b in slices(batch, "text"):
                row, number, h, first = line_words(b.column(2))
                ids = line_ids(h, first)
                h = np.sort(h)
                new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[:len(h)])
                times = np.diff(np.append(new, len(h)))
                np.add.at(n, (h[new] >> LOW).astype(np.int64), times.astype(np.uint32))
                spot = _spot(h[new])
                again = (times > 1) | (seen[spot] > 0)
                order = np.sort(spot)
                seen[spot] = np.maximum(seen[spot], 1)
                seen[spot[again]] = 2
                seen[order[1:][order[1:] == order[:-1]]] = 2
                at = np.flatnonzero(np.diff(first) > 0)
                idx = pa.array(row[at])
                yield pa.RecordBatch.from_arrays([b.column(0).take(idx), b.column(1).take(idx), pa.array(number[at].astype(np.int32)),
                                                  pa.array(ids[at]), pa.nulls(len(at), pa.binary())], names)
        none, small = pa.nulls(SPLIT, pa.int64()), ZstdCompressor(level=1)
        told = zip(n.reshape(SPLIT, -1), np.packbits(seen > 0, bitorder="little").reshape(SPLIT, -1),
                   np.packbits(seen > 1, bitorder="little").reshape(SPLIT, -1))
        yield pa.RecordBatch.from_arrays([none, none, pa.array(range(SPLIT), pa.int32()), none,
                                          pa.array([small.compress(b"".join(x.tobytes() for x in part)) for part in told], pa.binary())], names)
    return docs.mapInArrow(run, "doc_id long, tid long, number int, line long, n binary")


def _spot(h: np.ndarray) -> np.ndarray:
    """The bit of a word in a bitmap of ``MARK_BITS`` bits; hashes and words of ``word_sets`` give the same."""
    return (h & U64(MARK_BITS - 1)).astype(np.int64)


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a bitmap holds the bits of words."""
    spot = _spot(h)
    return (bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1


def levels(n: np.ndarray) -> np.ndarray:
    """Counts as one byte each, six steps an octave: a larger count never has a smaller byte."""
    return np.minimum(np.log2(n + 1.0) * 6, 255).astype(np.uint8)


class Ranks:
    """The rarity rank of each word bucket, worked out from the levels of their counts where it is first asked for."""

    def __init__(self, level: np.ndarray):
        self.level, self._rank = level, None

    def __getstate__(self):
        return {"level": self.level, "_rank": None}

    def table(self) -> np.ndarray:
        if self._rank is None:
            rank = np.empty(len(self.level), np.int32)
            rank[np.argsort(self.level, kind="stable")] = np.arange(len(self.level), dtype=np.int32)
            self._rank = rank
        return self._rank


def word_ranks(read: DataFrame) -> tuple[Ranks, np.ndarray]:
    """The rarity of each of ``BUCKETS`` word buckets over all documents, and which words may occur more than once."""
    size, bits = 4 * BUCKETS // SPLIT, MARK_BITS // SPLIT // 8

    def add(df: pd.DataFrame) -> pd.DataFrame:
        from zstandard import ZstdDecompressor
        n, once, twice = np.zeros(BUCKETS // SPLIT, np.int64), np.zeros(bits, np.uint8), np.zeros(bits, np.uint8)
        for x in df["n"]:
            raw = ZstdDecompressor().decompress(x)
            n += np.frombuffer(raw, np.uint32, BUCKETS // SPLIT)
            here = np.frombuffer(raw, np.uint8, bits, size)
            twice |= np.frombuffer(raw, np.uint8, bits, size + bits) | (once & here)
            once |= here
        return pd.DataFrame({"number": [df["number"].iloc[0]], "level": [levels(n).tobytes()], "twice": [twice.tobytes()]})

    level, twice = np.zeros((SPLIT, BUCKETS // SPLIT), np.uint8), np.zeros((SPLIT, bits), np.uint8)
    for r in read.where("line is null").select("number", "n").groupBy("number").applyInPandas(add, "number int, level binary, twice binary").collect():
        level[r.number] = np.frombuffer(r.level, np.uint8)  # SPLIT rows: tables of fixed size, 8 MB together
        twice[r.number] = np.frombuffer(r.twice, np.uint8)
    return Ranks(level.ravel()), twice.ravel()


def need(size, t: float):
    return np.ceil(np.round(t * np.asarray(size), 9)).astype(np.int64)


def _passing(p: np.ndarray, i: np.ndarray, j: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of postings pass the length and sketch filters, and how far apart their sketches are."""
    sx, sy = p["size"][i].astype(np.int64), p["size"][j].astype(np.int64)
    total = sx + sy
    least = np.ceil(np.round(total * (t / (1 + t)), 9)).astype(np.int64)
    s1, s2 = p["s1"][i] ^ p["s1"][j], p["s2"][i] ^ p["s2"][j]
    fold = np.minimum(sx, sy) <= NARROW
    apart = np.where(fold, np.bitwise_count(s1 ^ s2), np.bitwise_count(s1) + np.bitwise_count(s2)).astype(np.int64)
    ok = np.minimum(sx, sy) >= need(np.maximum(sx, sy), t)
    return ok & (apart <= total - 2 * least), (apart << 20) // np.maximum(total, 1)


def _earlier(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether ``x`` comes after ``y``: by doc_id, line number, then the line's hash."""
    return (x["doc"] > y["doc"]) | ((x["doc"] == y["doc"]) & ((x["num"] > y["num"]) | ((x["num"] == y["num"]) & (x["line"] > y["line"]))))


def _pairs(p: np.ndarray, i: np.ndarray, j: np.ndarray, t: float) -> np.ndarray:
    """Of the pairs of postings ``i`` and ``j``, those that pass, as ``(later, distance, doc and number of the earlier, earlier)``."""
    ok, far = _passing(p, i, j, t)
    x, y, far = p[i[ok]], p[j[ok]], far[ok]
    swap = _earlier(y, x)
    out = np.empty(len(x), FOUND)
    out["b"], out["far"], out["a"] = np.where(swap, y["line"], x["line"]), far, np.where(swap, x["line"], y["line"])
    out["doc"], out["num"] = np.where(swap, x["doc"], y["doc"]), np.where(swap, x["num"], y["num"])
    return out


def _nearest(found: np.ndarray) -> np.ndarray:
    """For each later line its nearest earlier one; of equally near ones the first.  A line that is only ever another one's
    earlier line, and not the nearest, stays as a row of its own with ``far`` -1 and itself as ``a`` and ``b``."""
    pair = found["far"] >= 0
    one = found[pair]
    one = one[np.lexsort((one["num"], one["doc"], one["far"], one["b"]))]
    one = one[np.concatenate([[True], one["b"][1:] != one["b"][:-1]])[:len(one)]]
    rest = np.setdiff1d(found["a"], np.concatenate([one["a"], one["b"]]))
    alone = np.zeros(len(rest), FOUND)
    alone["a"], alone["b"], alone["far"] = rest, rest, -1
    return np.concatenate([one, alone])


class Sets:
    """Whole sets of some lines, the open ones among them marked, from rows of ``_told``."""

    def __init__(self, rows: list[bytes]):
        parts = [_read(x) for x in rows]
        names = np.concatenate([x[3] for x in parts])
        self.names, to = np.unique(names, return_inverse=True)
        begin = np.cumsum([0, *(len(x[3]) for x in parts)])
        flat = np.concatenate([to[at:at + len(x[3])][x[4]] for at, x in zip(begin.tolist(), parts)])
        line, size = np.concatenate([x[0] for x in parts]), np.concatenate([x[2] for x in parts])
        self.line, at = np.unique(line, return_index=True)
        self.open = np.concatenate([x[1] for x in parts])[at]
        self.flat = flat[_runs((np.cumsum(size) - size)[at], size[at])]
        self.first = np.append(0, np.cumsum(size[at]))
        self.mark = np.zeros(len(self.names), bool)
        self.whole = self.line, self.open.copy(), self.first, self.names, self.flat

    def some(self, line: np.ndarray) -> bytes:
        """The sets of some of the lines, packed."""
        return _told(*self.whole, np.searchsorted(self.line, np.unique(line)))

    def late(self, found: np.ndarray, t: float) -> np.ndarray:
        """Which later lines of pairs are open and have Jaccard ``t`` or more with the earlier one."""
        b = np.searchsorted(self.line, found["b"])
        keep = self.open[b]
        b, a = b[keep], np.searchsorted(self.line, found["a"][keep])
        order = np.argsort(b, kind="stable")
        b, a = b[order], a[order]
        edge = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])[:len(b)]), len(b))
        out = []
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
            own = self.flat[self.first[b[x]]:self.first[b[x] + 1]]
            self.mark[own] = True
            some = np.unique(a[x:y])
            size = self.first[some + 1] - self.first[some]
            place = _runs(self.first[some], size)
            both = np.add.reduceat(self.mark[self.flat[place]], np.cumsum(size) - size, dtype=np.int64)
            self.mark[own] = False
            if np.any(both >= t * (len(own) + size - both) - 1e-9):
                out.append(b[x])
        self.open[out] = False  # settled
        return self.line[out]


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``begin[i]`` up to ``begin[i] + size[i]``, one run after another."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _planes(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T).tobytes()


def _told(line: np.ndarray, open_: np.ndarray, first: np.ndarray, names: np.ndarray, flat: np.ndarray, at: np.ndarray) -> bytes:
    """The sets of lines ``at``, packed: their distinct words once, in order and by differences, the sets as places among them."""
    from zstandard import ZstdCompressor
    size = np.diff(first)[at]
    some, place = np.unique(flat[_runs(first[:-1][at], size)], return_inverse=True)
    told = names[some]
    told = np.diff(told, prepend=told[:1] * 0)
    body = [np.array([len(at), len(told), len(place)], "<u8").tobytes(), _planes(line[at], "<i8"), open_[at].astype(np.uint8).tobytes(),
            _planes(size, "<u4"), _planes(told, "<u8"), _planes(place, "<u4")]
    return ZstdCompressor(level=1).compress(b"".join(body))


def _read(row: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(lines, open, sizes, words, places)`` of a row of ``_told``."""
    from zstandard import ZstdDecompressor
    raw = ZstdDecompressor().decompress(row)
    n, words, places = (int(x) for x in np.frombuffer(raw, "<u8", 3))
    at, out = 24, []
    for count, kind in ((n, "<i8"), (n, "u1"), (n, "<u4"), (words, "<u8"), (places, "<u4")):
        wide = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, count * wide, at).reshape(wide, count)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += count * wide
    return out[0], out[1] > 0, out[2].astype(np.int64), np.cumsum(out[3], dtype=U64), out[4].astype(np.int64)


def _open(found: np.ndarray, bits: np.ndarray | None) -> np.ndarray:
    """The pairs whose later line is marked."""
    if bits is None:
        return found
    spot = found["b"] & (MARK_BITS - 1)
    return found[(bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1]


def _within(p: np.ndarray, t: float, sets: Sets | None, bits: np.ndarray | None = None, budget: int = 1 << 18) -> np.ndarray:
    """Pairs inside lists, all lists side by side: ``p`` is sorted by word and size, each posting meets the next, the
    second next, ... of its list until sizes are too far apart.  With ``sets``, the open lines that prove late."""
    begin = np.flatnonzero(np.append(True, p["word"][1:] != p["word"][:-1])[:len(p)])
    n = np.diff(np.append(begin, len(p)))
    end, sizes = np.repeat(begin + n, n), p["size"].astype(np.int64)
    held, size, left, d = [], 0, np.arange(len(p)), 0
    least = need(sizes, t)
    while len(left):
        d += 1
        left = left[left + d < end[left]]
        left = left[sizes[left] >= least[left + d]]
        for at in range(0, len(left), budget):
            some = left[at:at + budget]
            got = _open(_pairs(p, some, some + d, t), bits)
            held.append(got if sets is None else sets.late(got, t))
            size += len(held[-1])
        if size > 4 * budget and sets is None:
            held = [_nearest(np.concatenate(held))]
            size = 0
    return _gathered(held, sets)


def _between(x: np.ndarray, y: np.ndarray, t: float, sets: Sets | None, bits: np.ndarray | None = None, step: int = 64) -> np.ndarray:
    """Pairs of postings of one word in two blocks; with ``sets``, the open lines that prove late."""
    held = []
    both = np.concatenate([x, y])
    for at in range(0, len(x), step):
        i, j = (k.ravel() for k in np.meshgrid(np.arange(at, min(at + step, len(x))), np.arange(len(x), len(both)), indexing="ij"))
        got = _open(_pairs(both, i, j, t), bits)
        held.append(_nearest(got) if sets is None else sets.late(got, t))
    return _gathered(held, sets)


def _gathered(held: list[np.ndarray], sets: Sets | None) -> np.ndarray:
    if sets is None:
        return _nearest(np.concatenate(held)) if held else np.zeros(0, FOUND)
    return np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)


def sketches(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity of each of 128 bits per set: two sets differ in as many words at least; of short sets the two halves folded into one."""
    bits = mix(words)
    half, bit = (bits >> U64(6)) & U64(1) == 1, U64(1) << (bits & U64(63))
    s1, s2 = np.bitwise_xor.reduceat(np.where(half, U64(0), bit), first[:-1]), np.bitwise_xor.reduceat(np.where(half, bit, U64(0)), first[:-1])
    fold = np.diff(first) <= NARROW
    return np.where(fold, s1 ^ s2, s1), np.where(fold, U64(0), s2)


def postings(words: np.ndarray, first: np.ndarray, ids: np.ndarray, doc: np.ndarray, num: np.ndarray, useful: np.ndarray, t: float, parts: int):
    """``(part, postings)`` of the prefixes of sets, of words in the bitmap ``useful`` only.  A posting names a word by its upper 40 bits:
    words that share them are in one list, where the filters tell their lines apart."""
    size = np.diff(first)
    s1, s2 = sketches(words, first)
    k = size - need(size, t) + 1
    src = np.repeat(np.arange(len(size)), k)
    word = words[np.repeat(first[:-1] - (np.cumsum(k) - k), k) + np.arange(len(src))]
    keep = _has(useful, word)
    src, word = src[keep], word[keep] >> U64(24)
    part = (mix(word) % U64(parts)).astype(np.int64)
    at = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
    src, part = src[at], part[at]
    p = np.empty(len(src), POST)
    p["word"], p["line"], p["size"], p["s1"], p["s2"], p["doc"], p["num"] = word[at], ids[src], size[src], s1[src], s2[src], doc[src], num[src]
    edge = np.searchsorted(part, np.arange(parts + 1))
    return [(i, p[edge[i]:edge[i + 1]]) for i in range(parts) if edge[i] < edge[i + 1]]


def _lists(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings by word, then size, each line once a list, at its first place; where lists begin and how long they are."""
    p = _unpacked(rows)
    key = p["word"] << U64(24) | np.minimum(p["size"], (1 << 24) - 1).astype(U64)  # words are named by 40 bits
    at = np.argsort(key)
    key = key[at]
    same = np.append(key[1:] == key[:-1], False)
    same[1:] |= same[:-1].copy()
    ties = np.flatnonzero(same)
    at[ties] = at[ties][np.lexsort((p["line"][at[ties]], p["size"][at[ties]], key[ties]))]
    p = p[at]
    new = np.append(True, (p["word"][1:] != p["word"][:-1]) | (p["line"][1:] != p["line"][:-1]))[:len(p)]
    again = np.flatnonzero(~new)
    if len(again):  # a line that came from several slices of texts
        group = np.cumsum(new)
        some = np.unique(np.concatenate([again, again - 1]))
        p[some] = p[some[np.lexsort((p["num"][some], p["doc"][some], group[some]))]]
        p = p[new]
    begin = np.flatnonzero(np.append(True, p["word"][1:] != p["word"][:-1])[:len(p)])
    return p, begin, np.diff(np.append(begin, len(p)))


def _together(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.Table]:
    """Batches with a row put together to tables of about ``limit`` bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.nbytes for x in held) >= limit:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def meeting(rows: DataFrame, t: float, exact: bool, name: str, marks=None) -> DataFrame:
    """Lists of ``rows(part, posts[, sets])``: ``(a, b, far)`` of the nearest earlier line a list knows for each later one, and lines
    that are no such pair's end (``far`` -1); with ``exact``, open lines that prove late as ``a``.  With ``marks``, pairs of marked later lines only."""
    spark, kinds = rows.sparkSession, "a long, b long, far long, word long, block long, low long, high long, posts binary, sets binary"

    def told(got: np.ndarray) -> list[pa.Array]:
        return [pa.array(got), pa.nulls(len(got), pa.int64()), pa.nulls(len(got), pa.int64())] if exact else [pa.array(got[c]) for c in ("a", "b", "far")]

    def meet(group: pa.Table) -> pa.Table:
        p, begin, n = _lists(group["posts"].to_pylist())
        sets = Sets(group["sets"].to_pylist()) if exact else None
        got = told(_within(p[np.repeat((n > 1) & (n <= LONG), n)], t, sets, None if marks is None else marks.value))
        cut = []
        for b, m in zip(begin[n > LONG].tolist(), n[n > LONG].tolist()):
            for i, at in enumerate(range(b, b + m, LONG)):
                own = p[at:min(at + LONG, b + m)]
                cut.append((int(own["word"][0]), i, int(own["size"][0]), int(own["size"][-1]), _packed(own), sets.some(own["line"]) if exact else None))
        cols = [pa.concat_arrays([x, pa.nulls(len(cut), pa.int64())]) for x in got]
        for c, kind in enumerate((pa.int64(),) * 4 + (pa.binary(),) * 2):
            cols.append(pa.concat_arrays([pa.nulls(len(got[0]), kind), pa.array([x[c] for x in cut], kind)]))
        return pa.Table.from_arrays(cols, [k.split()[0] for k in kinds.split(", ")])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if marks is None else marks.value
        for batch in batches:
            for same, x, y, own, other in zip(*(batch.column(c).to_pylist() for c in range(5))):
                x, y, sets = _unpacked([x]), _unpacked([y]), Sets([own, other]) if exact else None
                yield pa.RecordBatch.from_arrays(told(_within(x, t, sets, bits) if same else _between(x, y, t, sets, bits)), ["a", "b", "far"])

    met = save(rows.groupBy("part").applyInArrow(meet, kinds), name)
    blocks = met.where("posts is not null")
    x, y = (blocks.select("word", *(F.col(c).alias(c + side) for c in ("block", "low", "high", "posts", "sets"))) for side in ("_x", "_y"))
    wide = (x.join(y, "word").where((F.col("block_x") <= F.col("block_y")) & (F.col("low_y") * (t - 1e-9) <= F.col("high_x")))
            .select((F.col("block_x") == F.col("block_y")).alias("same"), "posts_x", "posts_y", "sets_x", "sets_y")
            .repartition(slots(spark)).mapInArrow(across, "a long, b long, far long"))
    return met.where("posts is null").select("a", "b", "far").unionByName(wide)


def candidates(docs: DataFrame, rank, twice, t: float) -> tuple[DataFrame, DataFrame]:
    """``(a, b)``: ids of lines that passed the prefix, length and sketch filters, the earlier first, for each later line the nearest one;
    and ``(line)``: all lines that passed them with another one, earlier or later."""
    parts = max(16, slots(docs.sparkSession))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                row, number, h, first = line_words(b.column(1))
                ids = line_ids(h, first)
                doc = b.column(0).to_numpy(zero_copy_only=False)[row]
                some = np.flatnonzero(np.diff(first))
                one = some[np.lexsort((number[some], doc[some], ids[some]))]  # the first place of each line
                one = np.sort(one[np.concatenate([[True], ids[one][1:] != ids[one][:-1]])[:len(one)]])
                if not len(one):
                    continue
                count = np.diff(first)[one]
                own = np.repeat(first[one] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                words, first = word_sets(h[own], np.append(0, np.cumsum(count)), rank.value.table())
                out = postings(words, first, ids[one], doc[one], number[one], twice.value, t, parts)
                yield pa.RecordBatch.from_pydict({"part": pa.array([i for i, _ in out], pa.int32()),
                                                  "posts": pa.array([_packed(p) for _, p in out], pa.binary())})

    met = meeting(docs.select("doc_id", "text").mapInArrow(post, "part int, posts binary"), t, False, "lines-met")
    told = save(met.groupBy("b").agg(F.min(F.when(F.col("far") >= 0, F.struct("far", "a"))).alias("near"), F.collect_set("a").alias("seen"))
                .select("b", "near.a", F.array_except("seen", F.array("b")).alias("seen")), "lines-candidates")
    ends = told.select(F.col("b").alias("line")).unionByName(told.select(F.explode("seen").alias("line"))).distinct()
    return told.where("a is not null").select("a", "b"), ends


def late_lines(docs: DataFrame, home: DataFrame, rank, twice, t: float) -> DataFrame:
    """``(line)``: ids of lines that have an earlier line with Jaccard ``t`` or more.

    Two rounds, so that a group of many near copies costs one pair per member: first each line meets the nearest earlier
    one; lines that this leaves open (a bitmap of fixed size tells which words they post) then meet all earlier ones
    among the lines that passed the filters with some line, with whole sets at hand.  No link that decides a line is lost.
    """
    spark = docs.sparkSession
    cand, ends = candidates(docs, rank, twice, t)
    near, sets = similar(docs, home, rank, t, cand, ends)
    judged = save(cand.select(F.col("b").alias("line")).join(near.select(F.col("b").alias("line"), F.lit(True).alias("late")), "line", "left"), "lines-judged")
    late, left = judged.where("late").select("line"), judged.where("late is null").select("line")
    own = save(sets.join(left.withColumn("open", F.lit(True)), "line", "left").withColumn("open", F.coalesce("open", F.lit(False))), "lines-open")

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [np.frombuffer(x, U64) for x in b.column(0).to_pylist()]
            bits = [_spot(x[:len(x) - int(need(len(x), t)) + 1]) for x in held]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bits) if bits else np.zeros(0, np.int64))], ["bit"])

    useful = spark.sparkContext.broadcast(bitmap_of(own.where("open").select("words").mapInArrow(prefix, "bit long"), F.col("bit")))
    marks = spark.sparkContext.broadcast(bitmap_of(own.where("open"), F.pmod(F.col("line"), F.lit(MARK_BITS))))
    parts = max(16, slots(spark))

    def posted(rows: DataFrame, whole: bool) -> DataFrame:
        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _together(batches):
                words = b.column("words").to_pylist()
                ids, doc, num, open_ = (b.column(c).to_numpy() for c in ("line", "doc", "num", "open"))
                first = np.append(0, np.cumsum([len(x) // 8 for x in words]))
                flat = np.frombuffer(b"".join(words), U64)
                out = postings(flat, first, ids, doc, num, useful.value, t, parts)
                sets = [None] * len(out)
                if whole:
                    names, place = np.unique(flat, return_inverse=True)
                    order = np.argsort(ids)
                    sets = [_told(ids, open_, first, names, place, order[np.searchsorted(ids, np.unique(p["line"]), sorter=order)]) for _, p in out]
                yield pa.RecordBatch.from_pydict({"part": pa.array([i for i, _ in out], pa.int32()), "posts": pa.array([_packed(p) for _, p in out], pa.binary()),
                                                  "sets": pa.array(sets, pa.binary())})
        return rows.select("line", "words", "doc", "num", "open").mapInArrow(post, "part int, posts binary, sets binary")

    # the lines that pass the filters with an open later line: only their sets travel
    met = meeting(posted(own, False), t, False, "lines-met-open", marks)
    few = own.join(met.select(F.col("a").alias("line")).unionByName(met.select(F.col("b").alias("line"))).distinct(), "line")
    return late.unionByName(meeting(posted(few, True), t, True, "lines-settled").select(F.col("a").alias("line"))).distinct()


def similar(docs: DataFrame, home: DataFrame, rank, t: float, cand: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs ``(a, b)`` of ``cand`` whose sets have Jaccard ``t`` or more, and ``(line, words, doc, num)`` of all lines of ``ends``."""
    # whole sets are read from the first place of each line that passed the filters
    where = save(ends.join(home, "line").select("line", "home.doc_id", "home.tid", F.struct("home.number", "line").alias("at")), "lines-wanted")

    def sets(b: pa.RecordBatch, wanted: list) -> pa.RecordBatch:
        own = [(p["line"], text.split("\n")[p["number"]], doc, p["number"])
               for doc, text, at in zip(b.column(b.schema.get_field_index("doc_id")).to_pylist(), b.column(b.schema.get_field_index("text")).to_pylist(), wanted)
               for p in at or ()]
        _, _, h, first = line_words(pa.array([x[1] for x in own], pa.string()))
        words, first = word_sets(h, first, rank.value.table())
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in own], pa.int64()),
                                           pa.array([words[x:y].tobytes() for x, y in zip(first[:-1].tolist(), first[1:].tolist())], pa.binary()),
                                           pa.array([x[2] for x in own], pa.int64()), pa.array([x[3] for x in own], pa.int32())],
                                          ["line", "words", "doc", "num"])

    full = save(edit_texts(docs, where, "at", sets, "line long, words binary, doc long, num int").dropDuplicates(["line"]), "lines-sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= t * (len(x) + len(y) - both) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = (cand.join(full.select(F.col("line").alias("a"), F.col("words").alias("wa")), "a")
             .join(full.select(F.col("line").alias("b"), F.col("words").alias("wb")), "b").select("a", "b", "wa", "wb"))
    return pairs.mapInArrow(check, "a long, b long"), full


def drop_lines(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
               others: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, tid, text, *others, n_lines, n_removed)`` per input row, ``text`` without its removed lines.

    Lines are cut at line feeds; a null text stays null with no lines; lines without words stay; an
    equal line that occurs again, in the same or a later document, is a later match; rows with a null id
    keep their lines and remove none; rows that share a doc_id are one document (lines of equal number
    compare by their hash); an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tid"), F.col(text_col).alias("text"), *others)
    real = base.where("doc_id is not null and text is not null").select("doc_id", "tid", "text")
    names = [*base.columns, "n_lines", "n_removed"]
    kinds = T.StructType(base.schema.fields + [T.StructField(c, T.LongType()) for c in names[-2:]])
    read = save(read_lines(real), "lines-read")
    rank, twice = map(spark.sparkContext.broadcast, word_ranks(read))
    seen = read.where("line is not null").drop("n")
    place = F.struct("doc_id", "number", "tid")
    home = save(seen.groupBy("line").agg(F.min(place).alias("home"), F.count("*").alias("n")), "lines-home")
    late = late_lines(real, home, rank, twice, threshold)
    # sets to look at: those with an earlier similar set, and those that occur more than once
    rule = save(home.join(late.withColumn("late", F.lit(True)), "line", "left").where("late or n > 1")
                .select("line", "home", F.coalesce("late", F.lit(False)).alias("late")), "lines-rule")
    gone = save(seen.join(rule, "line").where(F.col("late") | (place > F.col("home"))).select("doc_id", "tid", "number"), "lines-gone")

    def result(b: pa.RecordBatch, edits: list) -> pa.RecordBatch:
        texts, total, cut = b.column(b.schema.get_field_index("text")).to_pylist(), [], []
        out = []
        for text, drop in zip(texts, edits):
            lines = text.split("\n") if text is not None else []
            total.append(len(lines))
            drop = set(drop or ())
            cut.append(len(drop))
            out.append("\n".join([x for i, x in enumerate(lines) if i not in drop]) if drop else text)
        kept = [pa.array(out, pa.string()) if c == "text" else b.column(b.schema.get_field_index(c)) for c in names[:-2]]
        return pa.RecordBatch.from_arrays(kept + [pa.array(total, pa.int64()), pa.array(cut, pa.int64())], names)

    return edit_texts(base, gone, "number", result, kinds)
