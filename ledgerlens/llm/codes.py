"""Texts as numpy arrays of code points, words and shingle hashes; used inside Arrow batches.

All texts of a batch are joined, cut into blocks at white space, and hashed block by block, so that
memory follows the block and not the longest text.
"""
from __future__ import annotations

import re

import numpy as np

BLOCK = 1 << 18
SPACES = " \t\n\v\f\r"
_SPACE = re.compile("[ \t-\r]")


def mix(x):
    """A bijection of 64-bit integers whose output bits depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


GOLD = np.uint64(0x9E3779B97F4A7C15)
_PLANE = mix(np.arange(1 << 16, dtype=np.uint64) + GOLD)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def blocks(text: str, size: int = BLOCK):
    """(offset, part) of the text; parts end after a white space, so that no word is cut."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            m = _SPACE.search(text, end)
            end = m.end() if m else len(text)
        yield at, text[at:end]
        at = max(end, at + 1)


def text_blocks(texts: list[str], size: int = BLOCK):
    """(index, texts) of runs of whole texts of about so many characters; a longer text comes alone, in parts
    cut at places of its own."""
    first = total = 0
    for k, t in enumerate(texts):
        if len(t) >= size or total >= size:
            if first < k:
                yield first, texts[first:k]
            first, total = k, 0
        if len(t) >= size:
            yield from ((k, [part]) for _, part in blocks(t, size))
            first = k + 1
        else:
            total += len(t)
    if first < len(texts):
        yield first, texts[first:]


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _STEP, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_POWERS = _powers(1 << 12)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def hash_pieces(points: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the pieces that begin at `first` and together fill the points."""
    value = _PLANE[points & 0xFFFF]
    high = points > 0xFFFF
    if high.any():
        value[high] = mix(points[high].astype(np.uint64) + GOLD)
    powers = _POWERS if sizes.max() <= len(_POWERS) else _powers(int(sizes.max()))
    value *= powers[np.arange(len(points)) - np.repeat(first, sizes)]
    return mix(np.add.reduceat(value, first) + sizes.astype(np.uint64) * GOLD)


def hash_runs(points: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the runs of flagged code points."""
    starts, ends = runs(flags)
    if not len(starts):
        return starts, ends, np.zeros(0, dtype=np.uint64)
    sizes = ends - starts
    return starts, ends, hash_pieces(points[flags], np.cumsum(sizes) - sizes, sizes)


def is_space(points: np.ndarray) -> np.ndarray:
    return (points == 32) | ((points >= 9) & (points <= 13))


def lower_ascii(points: np.ndarray) -> np.ndarray:
    return points + np.where((points >= 65) & (points <= 90), np.uint32(32), np.uint32(0))


def words(texts: list[str], lower: bool = True):
    """Words between white space of all texts: starts and ends in the joined texts, hashes, and the
    index of each text's first word (one more entry at the end). A-Z count as a-z if lower."""
    joined = "\n".join(texts) + "\n"
    parts = []
    for at, part in blocks(joined):
        points = code_points(part)
        s, e, h = hash_runs(lower_ascii(points) if lower else points, ~is_space(points))
        parts.append((s + at, e + at, h))
    starts, ends, hashes = (np.concatenate([p[k] for p in parts]) for k in range(3))
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    return starts, ends, hashes, np.searchsorted(starts, begin), begin


ROTORS = np.arange(1, 128, 2, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles of so many words; of the whole sequence if it is shorter."""
    n = len(hashes)
    if n == 0:
        return hashes
    take = min(width, n)
    out = np.full(n - take + 1, ROTORS[take % 64], dtype=np.uint64)
    for k in range(take):
        out = mix(out + hashes[k:n - take + 1 + k] * ROTORS[k % 64])
    return np.unique(out)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
