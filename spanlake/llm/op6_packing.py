"""Best-fit packing of token documents into sequences of fixed capacity, in bulk-synchronous rounds.

Method.  Documents longer than the capacity are cut from their end into full pieces, so at most
the first piece is shorter.  Pieces are range-sorted by size over all partitions, which gives each its rank among those of its
size.  Documents and gaps are then handled in bulk, as runs: so many pieces of one size, so many sequences with one gap.
A round takes the largest size that waits.  Its pieces sweep the sorted gaps for the successor of their size, the smallest gap that
is large enough; a run of gaps takes as many pieces as fit in each, one after another, since what is left of a gap is still
the best fit.  Which piece goes where is settled by rank: piece ``i`` of the run lands in gap ``i // k`` at place ``i mod k``,
so no two can ask for one place.  Gaps shrink, runs split, and the sweep repeats until the size is placed; where no gap is
large enough, as many empty sequences open as its pieces need.  The outcome is that of best fit by descending size, piece by piece.

Scale.  Texts are read once, to encode them; pieces are shuffled once, by the range sort, and placed where they then lie.
Rounds work on runs: their number depends on the capacity and not on how many documents there are, and so does
the table of placements that the tasks look up.  The driver holds one count per size and per range partition.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import save, slots
from .text import slices
from .tokens import load

SLICE = 3 << 20  # bytes of text encoded at a time: what an encoder holds is a multiple of them


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``(doc_id, row, piece, start, length, ids_crc32[, ids])`` per piece; ``ids`` holds little-endian
    unsigned 32-bit numbers and ``row`` tells rows with the same or no doc_id apart."""
    kinds = "doc_id long, row long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(tokenizer)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for b in slices(batch, "text", SLICE):
                rows = []
                for i, ids in enumerate(own.encode(b.column(2))):
                    ids += end
                    n = len(ids) // 4
                    at, piece = 0, 0
                    while at < n:
                        to = at + ((n - at - 1) % capacity + 1 if at == 0 else capacity)
                        part = ids[4 * at:4 * to]
                        rows.append((i, piece, at, to - at, zlib.crc32(part), part))
                        at, piece = to, piece + 1
                idx, piece, at, size, crc, part = zip(*rows)
                idx = pa.array(idx)
                cols = [b.column(0).take(idx), b.column(1).take(idx), pa.array(piece, pa.int32()), pa.array(at, pa.int64()),
                        pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(part, pa.binary())] if with_ids else []), names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                       F.col(text_col).alias("text")).mapInArrow(run, kinds)


def rounds(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit of ``counts`` pieces per size: ``(size, first rank, first sequence, pieces a sequence, offset)`` per run of pieces."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # size of the gap -> runs (first sequence, how many)
    order: list[int] = []  # sizes that have gaps, ascending
    out, opened = [], 0

    def add(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in gaps:
                gaps[size] = []
                insort(order, size)
            gaps[size].append((first, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect_left(order, size)
            if at == len(order):
                n = -(-left // (capacity // size))
                add(capacity, opened, n)
                opened += n
                continue
            gap = order[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            k = gap // size
            full, rest = min(n, left // k), 0
            if full < n:
                rest = left - full * k
            out.append((size, rank, first, k, capacity - gap))
            rank, left = rank + full * k + rest, left - full * k - rest
            add(gap - k * size, first, full)
            if full < n:
                add(gap - rest * size, first + full, 1)
                add(gap, first + full + 1, n - full - 1)
    return out


def place(items: DataFrame, capacity: int = 2048) -> DataFrame:
    """Items ``(item, size)`` with distinct ids and 1 <= size <= capacity, and any other columns -> the same rows with
    ``sequence_id`` (from 0) and ``offset``.  Ties are broken by id."""
    spark = items.sparkSession
    kinds = T.StructType(items.schema.fields + [T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType())])
    names = kinds.names

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, last, done = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column(names.index("size")).to_numpy()
            new = np.append(0, np.flatnonzero(size[1:] != size[:-1]) + 1)
            own = np.arange(len(size)) - np.repeat(new, np.diff(np.append(new, len(size))))
            if size[0] == last:
                own[:int(new[1]) if len(new) > 1 else len(size)] += done
            last, done = size[-1], int(own[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(size), part, np.int32)), pa.array(own)], names)

    ranked = save(items.repartitionByRange(slots(spark), "size", "item").sortWithinPartitions("size", "item").mapInArrow(rank, kinds), "packing-ranked")
    counts: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    # a size and partition: at most one row per partition and one per size
    for r in ranked.groupBy("part", "size").agg((F.max("rank") + 1).alias("n")).orderBy("part", "size").collect():
        before[r.part, r.size] = counts.get(r.size, 0)
        counts[r.size] = before[r.part, r.size] + r.n
    plan = np.array(sorted(rounds(counts, capacity)), np.int64).reshape(-1, 5)
    told = spark.sparkContext.broadcast((plan, before))
    done = T.StructType(items.schema.fields + [T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")])

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, before = told.value
        firsts = plan[:, 0].astype(np.uint64) << np.uint64(48) | plan[:, 1].astype(np.uint64)
        for b in batches:
            size, part, own = (b.column(names.index(c)).to_numpy() for c in ("size", "part", "rank"))
            both, which = np.unique(part.astype(np.int64) << 32 | size.astype(np.int64), return_inverse=True)
            start = np.array([before[int(x) >> 32, int(x) & 0xFFFFFFFF] for x in both], np.int64)
            own = own + start[which] if len(both) else own
            run = plan[np.searchsorted(firsts, size.astype(np.uint64) << np.uint64(48) | own.astype(np.uint64), side="right") - 1]
            i = own - run[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(run[:, 2] + i // run[:, 3]), pa.array(run[:, 4] + i % run[:, 3] * size)], done.names)

    return ranked.mapInArrow(seat, done)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset)`` per piece.

    A null or empty text is the end id alone.  Rows with the same or no doc_id are packed each by
    itself; ties go by row; an empty table gives an empty result; other columns are not read.
    Sequences are gapless from offset 0 and numbered from 0 as they open.
    """
    cut = save(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids)
               .withColumn("item", F.monotonically_increasing_id()), "packing-pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if with_ids else []) + ["sequence_id", "offset"]
    return place(cut.drop("row").withColumn("size", F.col("length")), capacity).select(names)
