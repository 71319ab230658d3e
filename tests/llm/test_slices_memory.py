"""What the packing encoder holds at a time is bounded by its slices, not by the batch."""

import random
import tracemalloc

import public_tokenizers
import pyarrow as pa

from spanlake.llm.op6_packing import SLICE
from spanlake.llm.text import slices
from spanlake.llm.tokens import load


def test_slices_bound_the_encoder():
    text = " ".join(f"word{k % 5000} of some, text." for k in range(2000))
    batch = pa.RecordBatch.from_pydict({"text": [text] * ((12 << 20) // len(text))})
    own = load(public_tokenizers.path("byte_bpe_50k.json"))
    want = own.encode([text])[0]
    tracemalloc.start()
    for b in slices(batch, "text", SLICE):
        assert own.encode(b.column(0)) == [want] * b.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20


def test_frequent_pieces_outlive_the_cache(monkeypatch):
    from spanlake.llm import tokens
    monkeypatch.setattr(tokens, "CACHE", 100)
    own = tokens.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    plain, asked = own.tokenizer, []

    class Counted:
        def encode_batch_fast(self, texts, add_special_tokens):
            asked.extend(texts)
            return plain.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    own.tokenizer = Counted()
    for k in range(12):
        text = "The frequent, word" + "".join(f" rare{k}x{j}" for j in range(40)) + " a\tb  c\nd.\nThe it's"
        assert list(memoryview(own.encode([text])[0]).cast("I")) == plain.encode(text, add_special_tokens=False).ids
    assert "".join(asked).count("frequent") == 1
    assert len(own.cache) + len(own.older) < 300


def test_words_with_marks_share_their_letters(monkeypatch):
    """Word-level: letters and the marks after them are cached apart, and frequent words outlive a full cache."""
    from spanlake.llm import tokens
    path = public_tokenizers.path("word_bpe_49k.json")
    own = tokens.Ids(path)
    seen = []
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda pieces: seen.append(set(pieces)) or learn(pieces))
    assert own.encode(["alpha Alpha, alpha. été été!? 12, a-b. ..."]) == own._whole(["alpha Alpha, alpha. été été!? 12, a-b. ..."])
    assert seen[0] == {"alpha", ",", ".", "été", "!?", "12,", "a-b.", "..."}
    monkeypatch.setattr(tokens, "CACHE", 100)
    for k in range(12):
        batch = ["alpha, " + " ".join(f"{chr(97 + k)}{chr(97 + i)}x" for i in range(20))]
        assert own.encode(batch) == own._whole(batch)
    assert sum("alpha" in s for s in seen) == 1
    rng = random.Random(5)
    bits = ["a", "b", "Z", "É", "é", "×", "÷", "ª", "…", "̈", "ſ", "K", "Ω", "ß", "'s", "7", ".", ",", "$", "|", ";", "<", " ", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 16))) for _ in range(3000)]
    assert own.encode(texts) == own._whole(texts)
