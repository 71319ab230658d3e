"""Token-id files of independent zstandard frames with a trailing seek table.

Layout of a part file, in ascending doc_id order (all numbers little-endian):

* frames: zstandard frames with their content checksum switched on, each decodable by itself.  A frame's content is
  ``n`` (u32), ``n`` doc_ids (i64, smallest i64 for null), ``n`` token counts (u32), then all ids (u32);
* the seek table, a skippable frame (magic 0x184D2A5E): per frame its compressed size (u32), content size
  (u32), low 32 bits of XXH64 of the content (u32), number of documents (u32), number of tokens (u64),
  first and last doc_id (i64); then the number of frames (u32) and the end magic 0x8F92EAB1.

A reader fetches the table from the end of the file and then only the frames that hold the documents asked
for.  A manifest table lists the committed files in order, so files of failed attempts are never read.

Scale.  Texts are range-partitioned once by doc_id, and each task streams one file; the prefix sums of
documents before a file need one number per file on the driver.  Files go through ``pyarrow.fs``, to whatever
store the shared folder is in.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .store import save, slots
from .text import slices
from .tokens import load

ENTRY = struct.Struct("<IIIIQqq")
FOOT = struct.Struct("<II")
SKIP, MAGIC = 0x184D2A5E, 0x8F92EAB1
NO_ID = -(1 << 63)
SLICE = 3 << 20  # bytes of text encoded at a time


def store_of(path: str):
    """``(filesystem, path inside it)`` of a path or URI."""
    from pyarrow import fs
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Writer:
    """Writes one part file; frames close at about ``frame_bytes`` of ids."""

    def __init__(self, out, frame_bytes: int, level: int):
        import zstandard
        self.out, self.limit = out, frame_bytes
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.table: list[bytes] = []
        self.docs = self.tokens = 0
        self._new()

    def _new(self) -> None:
        self.ids, self.sizes, self.parts, self.held = [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.sizes.append(len(ids) // 4)
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.limit:
            self.flush()

    def flush(self) -> None:
        if not self.ids:
            return
        n, tokens = len(self.ids), sum(self.sizes)
        body = b"".join([struct.pack("<I", n), np.asarray(self.ids, "<i8").tobytes(), np.asarray(self.sizes, "<u4").tobytes(), *self.parts])
        frame = self.zip.compress(body)
        self.out.write(frame)
        self.table.append(ENTRY.pack(len(frame), len(body), xxhash.xxh64_intdigest(body) & 0xFFFFFFFF, n, tokens, self.ids[0], self.ids[-1]))
        self.docs, self.tokens = self.docs + n, self.tokens + tokens
        self._new()

    def close(self) -> None:
        self.flush()
        body = b"".join(self.table) + FOOT.pack(len(self.table), MAGIC)
        self.out.write(struct.pack("<II", SKIP, len(body)) + body)


def seek_table(f) -> list[tuple]:
    """Per frame: place in the file, compressed size, content size, checksum, documents, tokens, first and last id."""
    size = f.size()
    f.seek(size - FOOT.size)
    frames, magic = FOOT.unpack(f.read(FOOT.size))
    if magic != MAGIC:
        raise ValueError("no seek table at the end of the file")
    f.seek(size - FOOT.size - frames * ENTRY.size)
    table, at = [], 0
    for e in ENTRY.iter_unpack(f.read(frames * ENTRY.size)):
        table.append((at, *e))
        at += e[0]
    return table


def read_frame(f, entry: tuple) -> tuple[np.ndarray, np.ndarray, bytes]:
    """``(doc_ids, token counts, ids)`` of one frame; raises if its bytes are not those written."""
    import zstandard
    f.seek(entry[0])
    body = zstandard.ZstdDecompressor().decompress(f.read(entry[1]), max_output_size=entry[2])
    if len(body) != entry[2] or xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != entry[3]:
        raise ValueError(f"frame at {entry[0]}: checksum differs")
    n = struct.unpack_from("<I", body)[0]
    return np.frombuffer(body, "<i8", n, 4), np.frombuffer(body, "<u4", n, 4 + 8 * n), body[4 + 12 * n:]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", frame_bytes: int = 1 << 18, level: int = 3) -> DataFrame:
    """Write all documents and return the manifest ``(part, file, n_docs, n_tokens, base_docs, base_tokens)``.

    A null or empty text is the end id alone; null doc_ids come first; rows with the same doc_id follow
    each other in the order of their text; an empty table gives files without frames.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        own, end = load(tokenizer), np.asarray([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        fs, folder = store_of(path)
        fs.create_dir(folder, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}.ids.zst"
        with fs.open_output_stream(f"{folder}/{name}", compression=None) as out:
            w = Writer(out, frame_bytes, level)
            for batch in batches:
                for b in slices(batch, "text", SLICE):
                    for doc_id, ids in zip(b.column(0).to_pylist(), own.encode(b.column(1))):
                        w.add(doc_id, ids + end)
            w.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"{path}/{name}"],
                                          "n_docs": [w.docs], "n_tokens": [w.tokens]})

    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .repartitionByRange(slots(spark), F.asc_nulls_first("doc_id"), F.xxhash64("text"))
            .sortWithinPartitions(F.asc_nulls_first("doc_id"), "text"))
    done = save(rows.mapInArrow(run, "part int, file string, n_docs long, n_tokens long"), "token-manifest")
    base_docs = base_tokens = 0
    out = []
    for r in sorted(done.collect()):  # one row per file
        out.append((*r, base_docs, base_tokens))
        base_docs, base_tokens = base_docs + r.n_docs, base_tokens + r.n_tokens
    return spark.createDataFrame(out, "part int, file string, n_docs long, n_tokens long, base_docs long, base_tokens long")


def read_tokens(manifest: DataFrame, only: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` from the files; with ``only``, just those
    doc_ids, decompressing just the frames that can hold them."""
    want = None if only is None else np.unique(np.asarray(only, np.int64))
    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, at = store_of(file)
                with fs.open_input_file(at) as f:
                    for e in seek_table(f):
                        if want is None or np.searchsorted(want, e[6]) < np.searchsorted(want, e[7], side="right"):
                            ids, sizes, data = read_frame(f, e)
                            to = np.cumsum(sizes.astype(np.int64))
                            begin = to - sizes
                            own = [data[4 * s:4 * t] for s, t in zip(begin.tolist(), to.tolist())]
                            cols = [pa.array(ids, mask=ids == NO_ID), pa.array(begin + base), pa.array(sizes.astype(np.int64)),
                                    pa.array([zlib.crc32(x) for x in own], pa.int64())]
                            out = pa.RecordBatch.from_arrays(cols + ([pa.array(own, pa.binary())] if with_ids else []), names)
                            yield out if want is None else out.filter(pa.array(np.isin(ids, want)))
                        base += e[5]
    return manifest.select("file", "base_tokens").repartition(slots(manifest.sparkSession), "file").mapInArrow(run, kinds)
