"""Token ids of Arrow text columns with the tokenizers library, each distinct word encoded once.

A text is cut where its tokenizer never joins tokens, so that the ids of a text are those of its pieces in a row:
"word" (tokenizers that drop white space): at ASCII white space. "byte" (byte-level BPE that keeps it): before each
run of white space that follows another character. For both also before a full stop or comma that ends such a
run behind an ASCII letter. Pieces of a batch are dictionary-encoded by Arrow; pieces not
met before by this Python worker are encoded by the library, many in one call, separated by a sentinel piece.

A text with an added token of the tokenizer in it (a control string, which the library gives its own id) is encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lumora.llm.common import SPACE, Words, utf8

MOST = 600_000  # pieces that a worker remembers; beyond that it keeps those of its last batch
SENTINEL = " \x00"
WIDE_SPACE = "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))  # white space beyond ASCII
_encoders: dict[tuple[str, str], Encoder] = {}


def _letters(data: np.ndarray) -> np.ndarray:
    return (data | 0x20) - np.uint8(97) < 26


def _stops(data: np.ndarray) -> np.ndarray:
    return (data == 0x2E) | (data == 0x2C)


def _pieces_word(column) -> tuple[pa.Array, np.ndarray]:
    w = Words(column, lower=True)  # as these tokenizers do themselves
    ends = np.cumsum(w.ends - w.starts)
    # a full stop or comma behind a letter at a word's end is a piece of its own
    two = np.flatnonzero((w.ends - w.starts > 1) & _stops(w.data[w.ends - 1]) & _letters(w.data[w.ends - 2]))
    offsets = np.concatenate([[0], np.insert(ends, two, ends[two] - 1)])
    return _strings(w.data[w._word], offsets), w.counts + np.bincount(w.texts()[two], minlength=len(w.counts))


def _pieces_byte(column) -> tuple[pa.Array, np.ndarray]:
    data, off = utf8(column)
    space = SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = space[1:] & ~space[:-1]
    # white space beyond ASCII joins the run that follows it
    at = np.flatnonzero(cut[: len(data)] & (np.concatenate([[0], data[:-1]]) >= 0x80) if len(data) else cut[:0])
    for i in at.tolist():
        before = data[max(0, i - 4) : i].tobytes().decode("utf-8", "ignore")
        if before and before[-1] in WIDE_SPACE:
            cut[i] = False
    last = np.ones(len(data), bool)  # of a run without white space
    last[:-1] = space[1:]
    last[off[1:][off[1:] > 0] - 1] = True
    cut[1:-1] |= (_stops(data) & last)[1:] & _letters(data)[:-1]
    cut[off] = True
    cut[len(data)] = False
    starts = np.flatnonzero(cut)
    first = np.searchsorted(starts, off)
    return _strings(data, np.append(starts, len(data))), np.diff(first)


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def _ranges(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... of size[0], then of the next one."""
    end = np.cumsum(size, dtype=np.int64)
    kind = np.int32 if len(end) == 0 or end[-1] < 1 << 31 else np.int64
    step = (at - (end - size)).astype(kind)
    return np.arange(end[-1] if len(end) else 0, dtype=kind) + np.repeat(step, size)


class Encoder:
    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.cut = {"word": _pieces_word, "byte": _pieces_byte}[kind]
        self.mark = self._plain([SENTINEL])[0]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 20, self.dtype), 0
        self.at, self.size = np.zeros(1 << 18, np.int32), np.zeros(1 << 18, np.int32)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        for i in range(0, len(pieces), 2000):
            part = pieces[i : i + 2000]
            odd = [p for p in part if "\x00" in p]
            even = [p for p in part if "\x00" not in p]
            for p, ids in zip(odd, self._plain(odd), strict=True):
                self._add([p], np.array(ids, self.dtype), np.array([len(ids)]))
            # a sentinel after each piece; each piece keeps its own leading white space
            glue = SENTINEL if self.cut is _pieces_byte else f"{SENTINEL} "
            ids = np.array(self._plain(["".join(p + glue for p in even)])[0] if even else [], np.int64)
            m = len(self.mark)
            hit = np.ones(max(0, len(ids) - m + 1), bool)
            for j, x in enumerate(self.mark):
                hit &= ids[j : len(ids) - m + 1 + j] == x
            ends = np.flatnonzero(hit)
            if len(ends) != len(even):  # never seen; one by one is always right
                for p, one in zip(even, self._plain(even), strict=True):
                    self._add([p], np.array(one, self.dtype), np.array([len(one)]))
                continue
            begins = np.concatenate([[0], ends[:-1] + m])
            own = np.ones(len(ids), bool)
            for j in range(m):
                own[ends + j] = False
            self._add(even, ids[own].astype(self.dtype), ends - begins)

    def _add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, k = len(self.known), len(pieces)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + k > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[n : n + k] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + k] = sizes
        self.used += len(ids)
        self.known.update(zip(pieces, range(n, n + k), strict=True))

    def _forget(self, names: list[str]) -> None:
        """Keep only the pieces in names."""
        kept = [p for p in names if p in self.known]
        old = np.fromiter(map(self.known.__getitem__, kept), np.int64, len(kept))
        at, size, flat = self.at[old], self.size[old], self.flat
        self.clear()
        self._add(kept, flat[_ranges(at, size)], size)

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of each text; a null text has none."""
        whole = np.zeros(len(column), bool)
        for t in self.added:
            head = re.match(r"[^a-zA-Z]*", t)[0]  # the same in any case of letters, and seldom in a text
            if not head or pc.any(pc.match_substring(column, head)).as_py():
                # in any case, as pieces of words are lower-cased
                whole |= pc.fill_null(pc.match_substring(column, t, ignore_case=self.cut is _pieces_word), False).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._encode(column)
        ids, n = self._encode(pc.if_else(pa.array(whole), "", column))
        at, cuts = np.flatnonzero(whole), np.cumsum(n)
        own = [np.array(self._plain([column[i].as_py()])[0], self.dtype) for i in at.tolist()]
        n = n.copy()
        n[at] = [len(x) for x in own]
        parts = np.split(ids, cuts[at])
        return np.concatenate([parts[0], *(x for pair in zip(own, parts[1:], strict=True) for x in pair)]), n

    def _encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        pieces, counts = self.cut(column)
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.known) > MOST:
            self._forget(names)
        new = [p for p in names if p not in self.known]
        if new:
            self._learn(new)
        number = np.fromiter(map(self.known.__getitem__, names), np.int32, len(names))
        word = number[coded.indices.to_numpy()] if len(names) else number
        size = self.size[word]
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        ends = np.cumsum(counts)
        return self.flat[_ranges(self.at[word], size)], total[ends] - total[ends - counts]


def encoder(path: str, kind: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]
