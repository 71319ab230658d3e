"""Token ids of whole texts with the tokenizers library, cached per piece of text.

A text is cut where the tokenizer's own pre-tokenizer always cuts, each distinct piece is encoded
once per Python worker, and the ids of the pieces are joined.  Texts with white space for which
such a cut is not certain are encoded whole, so ids always equal those of ``Tokenizer.encode``.
The cache holds about ``CACHE`` pieces in two halves: when the younger one is full it becomes the older one, and pieces that
are asked for again are carried over, so frequent ones stay.  Word-level, letters and the ASCII marks after them are two pieces.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import SPACE as BLANK
from .text import raw_bytes, split_words

CACHE = 400_000
TOGETHER = 200
RUN = 50  # byte-level pieces encoded as one text
_LOADED: dict[str, "Ids"] = {}
# Byte-level files: a space starts the piece after it and a line end is a piece, unless three white-space
# characters meet, two end the text, or there is white space beyond ASCII.
_BYTE_ODD = re.compile(r"\s\s(?:\s|\Z)|[^\S\t-\r ]")
# Word-level files drop white space and lower-case; a capital sigma is lower-cased by position in Python only.
_WORD_ODD = re.compile(r"[^\S\t-\r ]|\u03a3")
_TAIL = ".,!?;:%$#&*|"
MARK = np.zeros(256, bool)
MARK[np.frombuffer(_TAIL.encode(), np.uint8)] = True
# bytes of letters: a-z and the first byte of U+00C0 to U+00FF (second bytes: all but those of the two signs among them)
LETTER = np.zeros(256, bool)
LETTER[[*range(0x61, 0x7B), 0xC3]] = True
SECOND = np.zeros(256, bool)
SECOND[0x80:0xC0] = True
SECOND[[0x97, 0xB7]] = False
# first bytes of all white space beyond 0x20 and 0x09-0x0D, and of the capital sigma
RARE_BYTE = np.zeros(256, bool)
RARE_BYTE[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
RARE_WORD = RARE_BYTE.copy()
RARE_WORD[0xCE] = True


class Ids:
    """``encode(texts)``: per text, its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.words = self.tokenizer.normalizer is not None  # the word-level file drops white space
        size = self.tokenizer.get_vocab_size()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        # the first token of a piece that starts with a space, or the last token of a word
        self.edge = np.array([n.endswith("</w>") if self.words else n.startswith("\u0120") for n in names])
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the older half of the cache

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Texts are cut before every blank on the column's buffer; only distinct pieces are looked up, so that new pieces of
        many texts are encoded together, and the ids of all pieces are gathered by their places."""
        arr = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        raw, off = raw_bytes(arr)
        odd = self._odd(arr, raw, off)
        if odd:
            whole = dict(zip(odd, self._whole([arr[i].as_py() for i in odd])))
            mask = np.zeros(len(arr), bool)
            mask[odd] = True
            raw, off = raw_bytes(pc.if_else(pa.array(mask), pa.scalar("", arr.type), arr))
        if self.words:
            w = split_words(pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(raw))]), lower=True)
            data, words = w.data[~BLANK[w.data]], np.append(0, np.cumsum(w.ends - w.starts))
            at = np.sort(np.concatenate([words, _mark_cuts(data, words)]))
            place = np.searchsorted(at, words[w.first])
        else:
            begin = (raw == 0x20) | (raw == 0x0A)
            begin[off[:-1][off[:-1] < len(raw)]] = True
            cuts = np.flatnonzero(begin)
            place, data, at = np.searchsorted(cuts, off), np.ascontiguousarray(raw), np.append(cuts, len(raw))
        told = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        cut = told.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = self._pieces(cut) if self.words else self._spaced(cut, _plain(told.dictionary))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        piece = told.indices.to_numpy(zero_copy_only=False)
        n = size[piece]
        ends = np.append(0, np.cumsum(n))
        data = flat[np.repeat(first[piece] - ends[:-1], n) + np.arange(int(ends[-1]))].tobytes()
        edge = 4 * ends[place]
        out = [data[x:y] for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())]
        for i in odd:
            out[i] = whole[i]
        return out

    def _odd(self, arr: pa.Array, raw: np.ndarray, off: np.ndarray) -> list[int]:
        """Rows to encode whole; bytes tell which texts need the exact look."""
        maybe = (RARE_WORD if self.words else RARE_BYTE)[raw]
        if not self.words and len(raw):
            blank = np.append(BLANK[raw], [True, True])
            edge = off[1:] - 1
            maybe = maybe | (blank[:-2] & blank[1:-1] & blank[2:])
            two = edge[(edge > 0)]
            maybe[two[blank[two] & blank[two - 1]]] = True
        rows = np.unique(np.searchsorted(off, np.flatnonzero(maybe), side="right") - 1)
        odd = _WORD_ODD if self.words else _BYTE_ODD
        return [i for i in rows.tolist() if odd.search(arr[i].as_py())]

    def _known(self, cut: list[str]) -> tuple[list[bytes | None], list[int]]:
        """Ids of distinct pieces as far as the cache holds them, and the places of those it does not hold."""
        if len(self.cache) > CACHE // 2:
            self.older, self.cache = self.cache, {}
        young, old = self.cache, self.older
        out = list(map(young.get, cut))
        new = []
        for i, ids in enumerate(out):
            if ids is None:
                p = cut[i]
                ids = old.get(p)
                if ids is None:
                    new.append(i)
                else:
                    out[i] = young[p] = ids
        return out, new

    def _pieces(self, cut: list[str]) -> list[bytes]:
        """Ids of distinct words and parts of words."""
        out, new = self._known(cut)
        young = self.cache
        bare = [p if p.isascii() else p.lower() for p in (cut[i] for i in new)]
        known = self._learn({*bare})
        for i, p in zip(new, bare):
            out[i] = young[cut[i]] = known[p]
        return out

    def _spaced(self, cut: list[str], plain: np.ndarray) -> list[bytes]:
        """Ids of distinct byte-level pieces.  A space before other text starts a pre-token, and only first tokens of such hold it:
        ``plain`` pieces are encoded many as one text and told apart by their first tokens."""
        out, new = self._known(cut)
        young = self.cache
        at = np.array(new, np.int64)
        alike, rest = at[plain[at]].tolist(), at[~plain[at]].tolist()
        for at in range(0, len(alike), 400 * RUN):
            some = alike[at:at + 400 * RUN]
            runs = [[cut[i] for i in some[x:x + RUN]] for x in range(0, len(some), RUN)]
            told: list[bytes] = []
            for run, encoding in zip(runs, self.tokenizer.encode_batch_fast(["".join(r) for r in runs], add_special_tokens=False)):
                ids = np.asarray(encoding.ids, "<u4")
                edge = (4 * np.flatnonzero(self.edge[ids])).tolist()
                if len(edge) == len(run):
                    data = ids.tobytes()
                    told += [data[a:b] for a, b in zip(edge, [*edge[1:], len(data)])]
                else:
                    told += self._whole(run)
            for i, ids in zip(some, told):
                out[i] = young[cut[i]] = ids
        if rest:
            line, = self._whole(["\n"])
            bare = [p[p[:1] == "\n":] for p in (cut[i] for i in rest)]
            for i, ids in zip(rest, self._whole(bare)):
                out[i] = young[cut[i]] = line + ids if cut[i][:1] == "\n" else ids
        return out

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of new words.  Letters followed by ASCII marks are cut between the two by the
        pre-tokenizer; pieces of letters are encoded some at a time and told apart by their last tokens."""
        known: dict[str, bytes] = {}
        mixed = {p: p.rstrip(_TAIL) for p in pieces if not p.isalpha()}
        cores = [*{*(p for p in pieces if p not in mixed), *(c for c in mixed.values() if c.isalpha())}]
        groups = [cores[at:at + TOGETHER] for at in range(0, len(cores), TOGETHER)]
        for at in range(0, len(groups), 200):
            some = groups[at:at + 200]
            whole = self.tokenizer.encode_batch_fast([" ".join(g) for g in some], add_special_tokens=False)
            for part, encoding in zip(some, whole):
                ids = np.asarray(encoding.ids, "<u4")
                edge = np.flatnonzero(self.edge[ids])
                if len(edge) == len(part):
                    data, begin = ids.tobytes(), 0
                    for core, end in zip(part, (4 * edge + 4).tolist()):
                        known[core] = data[begin:end]
                        begin = end
                else:
                    known.update(zip(part, self._whole(part)))
        tails: dict[str, bytes] = {}
        rest = []
        for p, core in mixed.items():
            if core.isalpha():
                tail = p[len(core):]
                if tail not in tails:
                    tails[tail] = self._whole([tail])[0]
                known[p] = known[core] + tails[tail]
            else:
                rest.append(p)
        known.update(zip(rest, self._whole(rest)))
        return known


def _mark_cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places in words (``data[at[i]:at[i + 1]]``, A-Z lower-cased) between letters, nothing else before them, and the ASCII marks that
    end the word: there the word-level pre-tokenizer always cuts."""
    letter, mark = LETTER[data], MARK[data]
    letter[1:] |= SECOND[data[1:]] & (data[:-1] == 0xC3)
    spoilt = ~letter & ~mark  # the byte's word is left whole
    spoilt[1:] |= mark[:-1] & letter[1:]
    spoilt[at[:-1]] = ~letter[at[:-1]]
    cut = np.flatnonzero(letter[:-1] & mark[1:]) + 1
    total = np.append(0, np.cumsum(spoilt))
    word = np.searchsorted(at, cut, side="right") - 1
    return cut[(at[word] != cut) & (total[at[word + 1]] == total[at[word]])]


def _plain(pieces: pa.Array) -> np.ndarray:
    """Which pieces are one space and then other text without white space."""
    raw, off = raw_bytes(pieces)
    blanks = np.append(0, np.cumsum(BLANK[raw]))
    size = np.diff(off)
    first = np.zeros(len(size), bool)
    first[size > 0] = raw[off[:-1][size > 0]] == 0x20
    return first & (size > 1) & (np.diff(blanks[off]) == 1)


def load(path: str) -> Ids:
    """The encoder of one file, once per Python process."""
    if path not in _LOADED:
        _LOADED[path] = Ids(path)
    return _LOADED[path]
