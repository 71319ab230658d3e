"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked by a segment-popcount grid.

Method.  A fingerprint is embedded as the vector of bit counts of its 16 four-bit segments.  The
Manhattan distance of two such vectors is a lower bound of the bit distance, so links lie within
``max_bits`` of each other in that 16-dimensional integer grid.  The range join uses unit cells:
two points within Manhattan distance 2 always share a cell at most one step from either (a
midpoint on a shortest path), so each point visits its own cell and the cells one step away, and
an equi-join on the cell key finds every candidate; the bit distance is then checked exactly.
The sixteen counts (0-4) are the nibbles of one 64-bit key, computed with shifts and masks.

Scale.  Equal fingerprints are first reduced to one representative (the smallest doc_id) by a
partial aggregate, so a group of copies of any size is one point.  Points shuffle as 33 rows of
two numbers.  Components are found by distributed star rounds over representatives only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import components, save
from .text import slices, split_words


def shingle_hashes(arr: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of each row's shingles of ``shingle`` words, and each row's first shingle."""
    w = split_words(arr, lower=True)
    counts = w.counts()
    n = np.where(counts >= shingle, counts - shingle + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(n)])
    begin = np.repeat(w.first[:-1] - first[:-1], n) + np.arange(first[-1])
    last = begin + np.repeat(np.minimum(counts, shingle), n) - 1
    data, digest = w.data.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(data[s:e], 42) for s, e in zip(w.starts[begin].tolist(), w.ends[last].tolist())),
                    np.uint64, int(first[-1]))
    return h, first


def majority_bits(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per row of hashes: the 64-bit number whose bits are set in over half of them (0 for none)."""
    out = np.zeros(len(first) - 1, np.uint64)
    weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for d in range(len(out)):
        own = h[first[d]:first[d + 1]]
        if len(own):
            ones = np.zeros(64, np.int64)
            for at in range(0, len(own), 1 << 16):
                part = np.ascontiguousarray(own[at:at + (1 << 16)])
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones += bits.sum(axis=0, dtype=np.int32)
            out[d] = weight[2 * ones > len(own)].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for every row, ``fp`` a signed 64-bit number.  Null and wordless texts: 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                h, first = shingle_hashes(b.column(1), shingle)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(majority_bits(h, first).view(np.int64))],
                                                 ["doc_id", "fp"])
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, fp long"))


def link_fingerprints(points: DataFrame, max_bits: int = 2) -> DataFrame:
    """Distinct ``points(rep, fp)`` -> links ``(a, b)`` between representatives whose fingerprints
    differ in at most ``max_bits`` (0, 1 or 2) bits."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the unit-cell range join covers bit distances up to 2")
    def nibble_counts(half):  # of 32 bits in a long: a count of 0-4 in each of eight nibbles
        two = half.bitwiseAND(F.lit(0x55555555)) + F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(0x55555555))
        return two.bitwiseAND(F.lit(0x33333333)) + F.shiftrightunsigned(two, 2).bitwiseAND(F.lit(0x33333333))

    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    p = points.withColumn("cell", F.shiftleft(nibble_counts(high), 32).bitwiseOR(nibble_counts(low)))
    steps = [F.col("cell")]
    for i in range(16):
        nibble = F.shiftrightunsigned("cell", 4 * i).bitwiseAND(F.lit(15))
        steps.append(F.when(nibble < 4, F.col("cell") + F.lit(1 << (4 * i))))
        steps.append(F.when(nibble > 0, F.col("cell") - F.lit(1 << (4 * i))))
    visits = p.select("rep", "fp", F.explode(F.array(*steps)).alias("cell")).where("cell is not null")
    a = visits.select("cell", F.col("rep").alias("a"), F.col("fp").alias("fa"))
    b = visits.select("cell", F.col("rep").alias("b"), F.col("fp").alias("fb"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= max_bits)
    # never a broadcast: the planner sizes the visits like the points they are exploded from, 33 times too low
    return a.join(b.hint("merge"), "cell").where(near).select("a", "b").distinct()


def simhash_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` per input row.

    Nulls and wordless texts have fingerprint 0 and link like any other; texts shorter than a
    shingle hash their whole word sequence; rows with a null id get their fingerprint but belong
    to no group (component_id null); repeated rows with the same id stay repeated; an empty table
    gives an empty result.  Ties cannot occur: a component is named by its smallest doc_id.
    """
    prints = save(fingerprints(docs, shingle, id_col, text_col), "simhash-prints")
    points = save(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-points")
    comp = components(link_fingerprints(points, max_bits), "simhash-links")
    named = points.join(comp, points.rep == comp.node, "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id"))
    return (prints.join(named, "fp", "left")
            .select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")))


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` that are the smallest doc_id of their group; rows with a null id stay.
    Rows that repeat a kept doc_id all stay."""
    groups = simhash_groups(docs, shingle, max_bits)
    drop = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__drop")).distinct()
    return docs.join(drop, docs.doc_id == F.col("__drop"), "left_anti")
