"""Tokenizing, packing and token files: exact ids, gapless sequences, round trips, damaged frames."""

import random
import zlib

import numpy as np
import pytest
from test_text_ops import corpus, docs

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def path(name):
    return pytest.importorskip("public_tokenizers").path(name)


def plain_ids(name, text):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path(name))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_cached_ids_equal_plain_ids(name):
    from spanlake.llm.tokens import load
    rng = random.Random(2)
    bits = ["a", "B", " ", " ", "\n", "\t", "é", "'s", "'ll", "12", "!", " ", "　", "Σ", "́", "İ", "\r", "\x1c", "<|endoftext|>", "word."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + [None, "", "a" * 5000]
    own = load(path(name))
    assert own.encode(texts) == [b"" if not t else x for t, x in zip(texts, own._whole([t or "" for t in texts]))]


def check_packing(rows, got, capacity, ids_of):
    want = {}
    for i, t in rows:
        ids = ids_of(t) + [0]
        at, piece = 0, 0
        while at < len(ids):
            to = at + ((len(ids) - 1) % capacity + 1 if at == 0 else capacity)
            want.setdefault((i, piece, at, to - at, zlib.crc32(np.asarray(ids[at:to], "<u4").tobytes())), 0)
            want[(i, piece, at, to - at, zlib.crc32(np.asarray(ids[at:to], "<u4").tobytes()))] += 1
            at, piece = to, piece + 1
    have = {}
    for r in got:
        k = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        have[k] = have.get(k, 0) + 1
    assert have == want
    full = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == full.get(r.sequence_id, 0)
        full[r.sequence_id] = r.offset + r.length
    assert not full or max(full.values()) <= capacity
    return len(full), -(-sum(full.values()) // capacity)


def test_packing(spark):
    from spanlake.llm.op6_packing import pack
    rows = corpus(40)
    got = pack(docs(spark, rows).repartition(3), path(FILES[0]), capacity=256).collect()
    used, least = check_packing(rows, got, 256, lambda t: plain_ids(FILES[0], t))
    assert used <= 1.1 * least + 2
    assert pack(docs(spark, []), path(FILES[0])).count() == 0


@pytest.mark.parametrize("sizes", [[1] * 500, [600] * 40 + [424] * 40, list(range(1, 1025)), [1024] * 30 + [1023] * 10, [341] * 60])
def test_placing_is_gapless_and_tight(spark, sizes):
    from spanlake.llm.op6_packing import place
    seats = place(spark.createDataFrame(list(enumerate(sizes)), "item long, size long"), 1024).collect()
    assert sorted(r.item for r in seats) == list(range(len(sizes)))
    full = {}
    for r in sorted(seats, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == full.get(r.sequence_id, 0)
        full[r.sequence_id] = r.offset + sizes[r.item]
    assert max(full.values()) <= 1024
    gaps = []  # best fit, largest first, for comparison
    for s in sorted(sizes, reverse=True):
        k = min((g, i) for i, g in enumerate(gaps + [1024]) if g >= s)[1]
        if k == len(gaps):
            gaps.append(1024)
        gaps[k] -= s
    assert len(full) <= 1.05 * len(gaps) + 1


def test_rounds_are_serial_best_fit():
    """Runs of pieces fill the gaps exactly as one piece after another would."""
    from spanlake.llm.op6_packing import rounds
    rng = random.Random(6)
    for capacity in (7, 32, 300):
        for n in (0, 1, 40, 900):
            sizes = sorted((rng.randint(1, rng.choice([capacity, max(1, capacity // 3)])) for _ in range(n)), reverse=True)
            gaps = []
            for s in sizes:
                k = min(((g, i) for i, g in enumerate(gaps) if g >= s), default=(0, len(gaps)))[1]
                if k == len(gaps):
                    gaps.append(capacity)
                gaps[k] -= s
            counts = {s: sizes.count(s) for s in set(sizes)}
            plan = rounds(counts, capacity)
            filled = {}
            for s, n_s in counts.items():
                runs = sorted(r for r in plan if r[0] == s)
                for rank in range(n_s):
                    _, first, seq, k, at = [r for r in runs if r[1] <= rank][-1]
                    filled.setdefault(seq + (rank - first) // k, []).append((at + (rank - first) % k * s, s))
            for parts in filled.values():
                at = 0
                for place, s in sorted(parts):
                    assert place == at
                    at += s
                assert at <= capacity
            assert sorted(capacity - sum(s for _, s in p) for p in filled.values()) == sorted(gaps)


def test_token_files(spark, tmp_path):
    from spanlake.llm.op8_tokenfile import read_frame, read_tokens, seek_table, write_tokens
    rows = corpus(40)
    manifest = write_tokens(docs(spark, rows).repartition(3), path(FILES[1]), path=str(tmp_path / "files"), frame_bytes=600)
    got = read_tokens(manifest).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for i, t in order:
        ids = plain_ids(FILES[1], t) + [1]
        data = np.asarray(ids, "<u4").tobytes()
        want.append((i, at, len(ids), zlib.crc32(data), data))
        at += len(ids)
    assert sorted((tuple(r[:4]) + (bytes(r.ids),) for r in got), key=lambda r: r[1]) == want
    some = read_tokens(manifest, only=[25, 30, 9999]).collect()
    assert sorted(tuple(r[:4]) for r in some) == sorted(w[:4] for w in want if w[0] in (25, 30))
    file = max(manifest.collect(), key=lambda r: r.n_tokens).file
    from spanlake.llm.op8_tokenfile import store_of
    fs, at = store_of(file)
    with fs.open_input_file(at) as f:
        table = seek_table(f)
        data = bytearray(fs.open_input_file(at).read())
    assert len(table) > 1
    data[table[0][0] + table[0][1] // 2] ^= 255
    (tmp_path / "bad").write_bytes(bytes(data))
    from pyarrow import fs as pfs
    with pfs.LocalFileSystem().open_input_file(str(tmp_path / "bad")) as f:
        with pytest.raises(Exception):
            read_frame(f, table[0])
        assert read_frame(f, table[1])  # other frames are independent
    assert read_tokens(write_tokens(docs(spark, []), path(FILES[1]))).count() == 0
