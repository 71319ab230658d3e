"""Handing per-document edits to texts without shuffling the texts that have none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import slices

MARK_BITS = 1 << 25


def bitmap(df: DataFrame, *cols: str) -> np.ndarray:
    """A bitmap of ``MARK_BITS`` bits with those of the rows' hashed ``cols`` set: 4 MB at any input size."""
    return bitmap_of(df, F.pmod(F.xxhash64(*cols), F.lit(MARK_BITS)))


def bitmap_of(df: DataFrame, place) -> np.ndarray:
    """A bitmap with the bits at ``place`` (0 up to ``MARK_BITS``) set."""
    bit = place + 1  # the bitmap functions count from 1
    rows = (df.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect())
    out = np.zeros(MARK_BITS // 8 + 8192, np.uint8)
    for r in rows:  # MARK_BITS / 32768 rows at most; bucket k holds bits (k - 1) * 32768 and on
        at = (r.bucket - 1) * 4096
        out[at:at + len(r.bits)] |= np.frombuffer(bytes(r.bits), np.uint8)
    return out


def marked(bits: np.ndarray, at: pa.Array) -> np.ndarray:
    at = at.to_numpy(zero_copy_only=False).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def with_bit(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumn("bit", F.pmod(F.xxhash64(*cols), F.lit(MARK_BITS)))


def edit_texts(docs: DataFrame, edits: DataFrame, column: str, result: Callable[[pa.RecordBatch, list], pa.RecordBatch],
               kinds: str) -> DataFrame:
    """``result(batch, edits per row)`` over all ``docs(doc_id, tid, text, ...)``, where ``edits(doc_id, tid,
    column)`` are collected per document.  Only documents that the bitmap of edits marks are shuffled."""
    marks = docs.sparkSession.sparkContext.broadcast(bitmap(edits, "doc_id", "tid"))
    with_marks = with_bit(docs, "doc_id", "tid")
    schema = docs.schema

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                stay = b.filter(pa.array(~marked(marks.value, b.column(b.schema.get_field_index("bit")))))
                if stay.num_rows:
                    yield result(stay, [None] * stay.num_rows)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("bit")
            yield b.select([n for n in b.schema.names if n != "bit"]).filter(pa.array(marked(marks.value, b.column(at))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                if b.num_rows:
                    yield result(b, b.column(b.schema.get_field_index("__edits")).to_pylist())

    own = edits.groupBy("doc_id", "tid").agg(F.collect_list(column).alias("__edits"))
    some = with_marks.mapInArrow(touched, schema).join(own, ["doc_id", "tid"], "left")
    return (with_marks.mapInArrow(untouched, kinds)
            .unionByName(some.select(*docs.columns, "__edits").mapInArrow(cut, kinds)))
