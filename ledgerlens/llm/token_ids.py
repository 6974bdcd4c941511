"""Token ids of whole texts by the tokenizers library.

A byte-level BPE cuts a text into words, numbers, signs and white space and merges only inside them.
Those parts are found here for a whole batch with numpy; each distinct one is encoded once by the
library and remembered under a 64-bit hash, and a text's ids are its parts' ids in a row: the same ids
as from the whole text, at a fraction of the time. A text with characters outside the ranges below, or
a vocabulary of another kind, goes to the library as a whole.
"""
from __future__ import annotations

import json
import os
import unicodedata
from functools import cache

import numpy as np

from ledgerlens.llm import codes

#: Parts remembered by one worker (about 30 MB).
REMEMBERED = 700_000
#: Scripts whose character classes have been the same in all versions of Unicode of the last decade:
#: Latin, Greek, Cyrillic, and general punctuation.
_LETTERS, _SIGNS = 0x0530, range(0x2000, 0x2070)
_SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]
SPACE, LETTER, NUMBER, SIGN, END = range(5)
#: Byte-level vocabularies write a byte as the Latin-1 character if that is visible, else as the next one from 256 on.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SEEN)}


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _written() -> np.ndarray:
    """The character a byte is written as, in UTF-16."""
    return np.array([_BYTES.get(b, b) for b in range(256)], dtype="<u2")


@cache
def _classes() -> np.ndarray:
    out = np.full(0x2070, SIGN, dtype=np.uint8)
    for c in range(0x2070):
        kind = unicodedata.category(chr(c))
        out[c] = SPACE if c in _SPACES else LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else SIGN
    return out


def _plain(points: np.ndarray) -> bool:
    high = points[points >= _LETTERS]
    return not len(high) or bool(((high >= _SIGNS.start) & (high < _SIGNS.stop)).all())


def part_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Flags where a part begins. ends: positions of one extra character after each text, a part of its own."""
    kind = _classes()[points]
    kind[ends] = END
    start = np.ones(len(points), dtype=bool)
    start[1:] = kind[1:] != kind[:-1]
    start[ends] = True
    start[ends[:-1] + 1] = True
    follows = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] >= LETTER) & (kind[1:] <= SIGN))
    start[follows] = True  # the last white space before something else stands alone,
    start[follows[points[follows] == 32] + 1] = False  # or, if a blank, opens the next part
    quote = np.flatnonzero((points == 39) & start)
    quote = quote[quote + 1 < len(points)]
    if len(quote):
        a, b = points[quote + 1], points[np.minimum(quote + 2, len(points) - 1)]
        b = np.where(kind[quote + 1] == LETTER, b, 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for taken, size in ((quote[one], 1), (quote[two], 2)):
            start[taken + 1] = False
            start[taken + 1 + size] = True
    return start


class Encoder:
    """Texts to ids. No special tokens are added; their strings in a text are ordinary text."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_parts = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                         and not pre.get("add_prefix_space", True))
        self._forget()

    def _forget(self):
        self.hashes, self.at, self.size, self.ids = (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.uint32))

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encoded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts in a row and how many each has, from the library's model."""
        merge = self.tokenizer.model.tokenize
        raw = [p.encode("utf-8", "surrogatepass") for p in parts]
        written = _written()[np.frombuffer(b"".join(raw), np.uint8)].tobytes().decode("utf-16-le")  # all parts at once
        ids, at = [], 0
        for x in raw:
            ids.append([t.id for t in merge(written[at:at + len(x)])])
            at += len(x)
        return np.array([i for x in ids for i in x], dtype=np.uint32), np.array([len(x) for x in ids], dtype=np.int64)

    def _learn(self, hashes: np.ndarray, parts: list[str]) -> None:
        """Remember parts; their hashes ascend and are new."""
        if len(self.hashes) > REMEMBERED:
            self._forget()
            return
        ids, size = self._encoded(parts)
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, ids])
        place = np.searchsorted(self.hashes, hashes)
        self.hashes, self.at, self.size = np.insert(self.hashes, place, hashes), np.insert(self.at, place, at), np.insert(self.size, place, size)

    def _place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return at, self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), dtype=bool)

    def _by_parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\n".join(texts) + "\n"
        points = codes.code_points(joined)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = np.flatnonzero(part_starts(points, ends))
        sizes = np.diff(starts, append=len(points))
        hashes = codes.hash_pieces(points, starts, sizes)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at, found = self._place(distinct)
        while not found.all():
            new = np.flatnonzero(~found)
            a = starts[first[new]]
            self._learn(distinct[new], [joined[i:j] for i, j in zip(a.tolist(), (a + sizes[first[new]]).tolist())])
            at, found = self._place(distinct)
        length = self.size[at][which]
        closing = np.searchsorted(starts, ends)
        length[closing] = 0
        before = np.cumsum(length) - length
        total = int(length.sum())
        ids = self.ids[np.repeat(self.at[at][which] - before, length) + np.arange(total)]
        return ids, np.append(0, before[closing])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin (one more entry at the end)."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if self.by_parts:
            if _plain(codes.code_points("".join(texts))):
                return self._by_parts(texts)
            if len(texts) > 1:
                half = len(texts) // 2
                (a, i), (b, j) = self(texts[:half]), self(texts[half:])
                return np.concatenate([a, b]), np.append(i, j[1:] + i[-1])
        ids = self._whole(texts)
        return np.concatenate(ids), np.cumsum([0] + [len(x) for x in ids])


@cache
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def groups(sizes, block: int = 1 << 20):
    """(first, last) of runs of rows whose sizes add up to about so much."""
    first = total = 0
    for k, size in enumerate(sizes):
        total += size
        if total >= block:
            yield first, k + 1
            first, total = k + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def encoded(texts: list[str | None], vocabulary: str, end_id: int):
    """For groups of texts: (first, last, ids in a row, where each text's begin), an end id after each text's."""
    texts = [t or "" for t in texts]
    for i, j in groups([len(t) for t in texts]):
        ids, at = encoder(vocabulary)(texts[i:j])
        yield i, j, np.insert(ids, at[1:], end_id), at + np.arange(len(at))


def binary(values: np.ndarray, at: np.ndarray):
    """An Arrow column of the slices of an array between the given places, as bytes."""
    import pyarrow as pa
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * width).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def flat(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows of a binary Arrow column without nulls in a row, and where each row's begin."""
    width = np.dtype(kind).itemsize
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return values.view(kind), (at - at[0]) // width
