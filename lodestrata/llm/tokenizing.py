"""Token ids of whole texts by a public tokenizer, batch-wise on byte arrays: no Python loop over a text's words."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodestrata.llm.common import strings

#: Classes of characters; a pre-token is a run of letters, one digit, or a run of others, and a hard word is left to the library.
SPACE, LETTER, DIGIT, OTHER, HARD = range(5)


def _class(c: int) -> int:
    if c in (0x20, *range(0x09, 0x0E)):
        return SPACE
    kind = unicodedata.category(chr(c))
    # controls and spaces beyond ASCII; an apostrophe may start a contraction
    if kind in ("Cc", "Zs") or c == 0x27:
        return HARD
    return {"L": LETTER, "N": DIGIT}.get(kind[0], OTHER)


#: Class of a byte alone; lead bytes of U+0080 to U+00FF are judged with the byte after them, all other lead bytes are hard.
_CLASS = np.array([_class(b) if b < 0x80 else HARD for b in range(256)], np.uint8)
_CLASS[0x80:0xC0] = OTHER
_TWO = np.array([_class(b) for b in range(0x80, 0x100)], np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Second bytes of U+00C0 to U+00FF in lower case.
_LOWER_TWO = np.array([ord(x) & 0x3F | 0x80 if len(x := chr(c).lower()) == 1 and 0xC0 <= ord(x) < 0x100 else c & 0x3F | 0x80 for c in range(0xC0, 0x100)], np.uint8)


def _byte_form() -> dict[int, str]:
    """Byte-level models write printable bytes as themselves and the others from U+0100 on; a line feed stays as what parts words."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)} | {0x0A: "\n"}


_BYTES = _byte_form()
#: glibc's number of the option.
_MMAP_THRESHOLD = -3


def pretokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts of pre-tokens and the end, number of pre-tokens before each row and in all, numbers of hard ones).

    White space is left out. Words of Latin-1 characters are in lower case and cut where the tokenizer cuts; a word with
    any other character, a control, an apostrophe or "<|" (which may begin a special token) is hard: one pre-token, as it stands.
    """
    data, offsets = strings(column)
    n = len(data)
    if not n:
        return data, np.zeros(1, np.int64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    cls, low = _CLASS[data], _LOWER[data]
    lead = np.flatnonzero((data == 0xC2) | (data == 0xC3))
    if len(lead):
        upper = data[lead] == 0xC3
        second = data[lead + 1]
        cls[lead] = cls[lead + 1] = _TWO[second - 0x80 + np.where(upper, 0x40, 0).astype(np.uint8)]
        at = lead[upper] + 1
        low[at] = _LOWER_TWO[data[at] - 0x80]
    ink = cls != SPACE
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    new = np.empty(n, bool)
    new[0], new[1:] = True, cls[1:] != cls[:-1]
    new |= cls == DIGIT
    if len(lead):
        new[lead[cls[lead] == DIGIT] + 1] = False
    hard = cls == HARD
    hard[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C) & ~first[1:]
    words = np.zeros(0, np.int64)
    if hard.any():
        # whole words of them, in their own bytes
        edge = first.copy()
        edge[1:] |= ~ink[:-1]
        start = np.flatnonzero(edge & ink)
        word = np.unique(np.searchsorted(start, np.flatnonzero(hard), "right") - 1)
        stop = np.append(start[1:], n)[word]
        step = np.zeros(n + 1, np.int8)
        step[start[word]] += 1
        np.subtract.at(step, stop, 1)
        within = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        low[within], new[within] = data[within], False
        new[start[word]] = True
        words = start[word]
    new |= first
    new &= ink
    kept = np.flatnonzero(new)
    out = low[ink]
    cuts = np.append(np.flatnonzero(new[ink]), len(out))
    return out, cuts, np.searchsorted(kept, offsets), np.searchsorted(kept, words)


class Tokens:
    """Ids by a tokenizer whose pre-tokens never span white space, so that each distinct one is encoded once.

    Some `most` pre-tokens are held, of `most_bytes` in all; then those not met since the last time this was so are forgotten.
    """

    def __init__(self, path: str, most: int = 500_000, most_bytes: int = 32 << 20) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.t, self.most, self.most_bytes = Tokenizer.from_file(path), most, most_bytes
        # the model alone: it is given pre-tokens in byte form, one a line
        self.model = Tokenizer(self.t.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        vocab = self.t.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.keep(None)

    def keep(self, which: np.ndarray | None) -> None:
        """Hold only these of the pre-tokens held; None: none."""
        if which is None:
            self.keys = pa.array([], pa.binary())
            self.start, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        else:
            self.keys = self.keys.filter(pa.array(which))
            start, self.count = self.start[which], self.count[which]
            self.ids = self.ids[spread(start, self.count)]
            self.start = np.cumsum(self.count) - self.count
        self.used = np.zeros(len(self.keys), bool)

    def whole(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each text by the library alone."""
        return [np.array(e.ids, np.uint32) for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each, ids) of pre-tokens that are not hard."""
        counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for at in range(0, len(keys), 8192):
            part = keys[at : at + 8192]
            lines = b"\n".join(part).decode("latin-1").translate(_BYTES)
            got = np.array(self.model.encode_batch_fast([lines], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[got])
            if len(last) != len(part):
                # a model without word ends: one by one
                each = self.whole([k.decode() for k in part])
                got, last = np.concatenate(each), np.cumsum([len(x) for x in each]) - 1
            counts.append(np.diff(last, prepend=-1))
            ids.append(got)
        return np.concatenate(counts), np.concatenate(ids)

    def learn(self, new: pa.BinaryArray, hard: np.ndarray) -> None:
        """Hold these too; hard: the numbers of those that the library has to encode."""
        easy = np.ones(len(new), bool)
        easy[hard] = False
        count = np.zeros(len(new), np.int64)
        count[easy], ids = self.plain((new.filter(pa.array(easy)) if len(hard) else new).to_pylist())
        start = np.zeros(len(new), np.int64)
        start[easy] = np.cumsum(count[easy]) - count[easy]
        if len(hard):
            each = self.whole([k.decode() for k in new.take(pa.array(hard)).to_pylist()])
            count[hard] = [len(x) for x in each]
            start[hard] = len(ids) + np.cumsum(count[hard]) - count[hard]
            ids = np.concatenate((ids, *each))
        self.keys = pa.concat_arrays([self.keys, new])
        self.start, self.count = np.concatenate((self.start, start + len(self.ids))), np.concatenate((self.count, count))
        self.ids, self.used = np.concatenate((self.ids, ids)), np.concatenate((self.used, np.zeros(len(new), bool)))

    def encode(self, column: pa.Array | Sequence[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, ids before each row and in all) of a string column; null: none. end: an id after each row."""
        if not isinstance(column, pa.Array):
            column = pa.array(column, pa.large_string())
        data, cuts, rows, hard = pretokens(column)
        words = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
        del data, cuts
        full = lambda: len(self.keys) > self.most or self.keys.nbytes > self.most_bytes
        if full():
            self.keep(self.used)
            if full():
                self.keep(None)
        at = pc.fill_null(pc.index_in(words, value_set=self.keys), -1).to_numpy()
        missing = np.flatnonzero(at < 0)
        if len(missing):
            at, held = at.copy(), len(self.keys)
            coded = words.take(pa.array(missing)).dictionary_encode()
            number = coded.indices.to_numpy()
            is_hard = np.zeros(len(words), bool)
            is_hard[hard] = True
            self.learn(coded.dictionary, np.unique(number[is_hard[missing]]))
            at[missing] = held + number
        del words
        self.used[at] = True
        begin, count = self.start[at], self.count[at]
        before = np.concatenate(([0], np.cumsum(count)))[rows]
        if end is None:
            return self.ids[spread(begin, count)], before
        # the end id as one more word of each row
        count, begin = np.insert(count, rows[1:], 1), np.insert(begin, rows[1:], len(self.ids))
        return np.append(self.ids, np.uint32(end))[spread(begin, count)], before + np.arange(len(before))


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], ..., start[0] + n[0] - 1, start[1], ...: places in 32 bits where they fit."""
    total = np.cumsum(n)
    size = int(total[-1]) if len(total) else 0
    kind = np.int32 if size < 1 << 31 and (not len(start) or int(start.max()) < 1 << 30) else np.int64
    at = np.arange(size, dtype=kind)
    at += np.repeat((start - (total - n)).astype(kind), n)
    return at


@functools.lru_cache(2)
def tokens(path: str) -> Tokens:
    """A worker's own; blocks of a megabyte or more go back to the system when freed, where the allocator can be told so."""
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).mallopt(_MMAP_THRESHOLD, 1 << 20)
    return Tokens(path)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
