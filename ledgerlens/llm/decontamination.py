"""Benchmark decontamination by canonical templates.

Numbers, names and units become typed placeholders; what is left of a benchmark item is cut into
windows of template tokens, and windows of the documents are looked up by hash. Every window is looked
up by its values as well, and a capitalised word that opens a sentence both as a word and as a name.
Windows that lie on one diagonal of a document and an item must fill the item's slots consistently,
each value by one value and no two by the same. So a question with other names and figures is found,
and a passage whose slots are filled at random is not.
"""
from __future__ import annotations

from collections import defaultdict
from functools import cache, reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import codes
from ledgerlens.llm.tables import in_batches, small, stage

#: Template tokens in a window, part of an item that must be found, tokens in a row that count whatever part of
#: the item they are, and characters of items looked up in one pass.
WINDOW, COVERAGE, RUN, PASS = 8, 0.5, 13, 2_000_000
UNITS = ("kg g mg lb lbs oz km m cm mm mi mile miles ft feet inch inches yd l ml gal s sec secs second seconds min mins minute minutes "
         "h hr hrs hour hours day days week weeks month months year years mph kph kmh w kw mw kwh v a hz khz mhz ghz kb mb gb tb "
         "usd eur gbp dollar dollars cent cents euro euros pound pounds percent degree degrees c f k").split()
#: Distinct tokens that an item must have to be told from ordinary words, and the part of a short item that must be found.
DISTINCT, SHORT = 3, 0.8
#: A capitalised word that opens a sentence may be a word or a name: OPENER until a reading decides.
WORD, NAME, NUMBER, UNIT, OPENER = range(5)
#: Openers of a window that are read each by itself; of more they are read all alike.
OPENERS = 4
SCHEMA = "doc_id long, item_id long, start long, end long, coverage double, reworded boolean"


@cache
def _tables():
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    digit = np.fromiter((chr(c).isdecimal() for c in range(0x110000)), dtype=bool, count=0x110000)
    upper = np.fromiter((chr(c).isupper() for c in range(0x110000)), dtype=bool, count=0x110000)
    lower = np.fromiter((ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(0x110000)), dtype=np.uint32, count=0x110000)
    units = np.sort([_word_hash(u) for u in UNITS])
    return letter, digit, upper, lower, units


def _word_hash(word: str) -> np.uint64:
    points = codes.code_points(word)
    return codes.hash_pieces(points, np.zeros(1, np.int64), np.array([len(points)]))[0]


def template(texts: list[str]):
    """Of all texts joined: starts, ends, value hashes and kinds of the tokens, and each text's first token."""
    letter, digit, upper, lower, units = _tables()
    joined = "\n".join(texts) + "\n"
    parts = []
    for at, block in codes.blocks(joined):
        p = codes.code_points(block)
        number = digit[p]
        # a point or comma between two digits belongs to the number
        joint = np.zeros(len(p), dtype=bool)
        joint[1:-1] = ((p[1:-1] == 46) | (p[1:-1] == 44)) & number[:-2] & number[2:]
        start, end, value = codes.hash_runs(lower[p], letter[p] | number | joint)
        kind = np.full(len(start), WORD, dtype=np.uint8)
        kind[np.isin(value, units)] = UNIT
        first = p[start] if len(start) else p[:0]
        one, two = p[np.maximum(start - 1, 0)], p[np.maximum(start - 2, 0)]
        opens = (start == 0) | (one == 10) | np.isin(two, [46, 33, 63, 58, 10, 32]) | ~np.isin(one, [32, 40, 45])
        kind[upper[first] & ~opens] = NAME
        kind[digit[first]] = NUMBER
        after = np.append(False, kind[:-1] == NUMBER)
        kind[(kind == UNIT) & ~after] = WORD  # a unit is one only after a number
        kind[(kind == WORD) & upper[first] & opens] = OPENER
        parts.append((start + at, end + at, value, kind))
    start, end, value, kind = (np.concatenate([x[k] for x in parts]) for k in range(4))
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    return start, end, value, kind, np.searchsorted(start, begin), begin


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def window_hashes(value: np.ndarray, kind: np.ndarray, width: int) -> np.ndarray:
    """Hash of the template of each run of `width` tokens: placeholders count by kind, words by value."""
    if len(value) < width:
        return value[:0]
    token = np.where(kind == WORD, value, codes.mix(kind.astype(np.uint64)))
    n = len(token)
    step, back = np.full(n, _BASE), np.full(n, _BACK)
    step[0] = back[0] = 1
    total = np.append(np.uint64(0), np.cumsum(token * np.multiply.accumulate(step), dtype=np.uint64))
    return codes.mix((total[width:] - total[:-width]) * np.multiply.accumulate(back)[:n - width + 1] + np.uint64(width))


def readings(kind: np.ndarray) -> list[np.ndarray]:
    """Kinds of tokens as they are looked up: all by value, openers as words, openers as names."""
    opener = kind == OPENER
    return [np.full_like(kind, WORD), np.where(opener, WORD, kind).astype(np.uint8), np.where(opener, NAME, kind).astype(np.uint8)]


def _mixed(value: np.ndarray, kind: np.ndarray, width: int):
    """(value, kind, first token) of windows with several openers, some of which are words and some names."""
    view = np.lib.stride_tricks.sliding_window_view(kind, width)
    openers = (view == OPENER).sum(axis=1)
    for at in np.flatnonzero((openers > 1) & (openers <= OPENERS)).tolist():
        where = np.flatnonzero(view[at] == OPENER)
        for names in product((WORD, NAME), repeat=len(where)):
            if WORD in names and NAME in names:
                one = view[at].copy()
                one[where] = names
                yield value[at:at + width], one, at


class Benchmark:
    """The template windows of some items, sorted by hash. Every window is looked up by its values; those of
    which half are words also as templates."""

    def __init__(self, item_ids: list[int], texts: list[str], window: int):
        self.items = []
        found = defaultdict(list)
        for k, (item, text) in enumerate(zip(item_ids, texts)):
            _, _, value, kind, _, _ = template([text])
            width = min(window, len(value))
            self.items.append((item, value, kind))
            if len(np.unique(value)) >= DISTINCT:
                at = np.arange(len(value) - width + 1)
                windows = [(value, one, at) for one in readings(kind)] + [(v, one, np.array([p])) for v, one, p in _mixed(value, kind, width)]
                for v, one, places in windows:
                    # the template of a window of placeholders says nothing
                    told = 2 * np.convolve(one == WORD, np.ones(width, int), "valid") >= width
                    found[width].append((window_hashes(v, one, width)[told], np.full(told.sum(), k), places[told]))
        self.tables = {}
        for width, parts in sorted(found.items()):
            hashes, item, at = (np.concatenate([x[k] for x in parts]) for k in range(3))
            order = np.lexsort((at, item, hashes))
            hashes, item, at = hashes[order], item[order], at[order]
            new = np.append(True, (hashes[1:] != hashes[:-1]) | (item[1:] != item[:-1]) | (at[1:] != at[:-1]))
            filled = np.zeros(1 << 20, dtype=bool)
            filled[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.tables[width] = (filled, hashes[new], np.stack([item[new], at[new]], axis=1))

    def hits(self, value, kind):
        """(width, place, item, place in the item) of all windows that the tokens share with an item."""
        looks = readings(kind)
        for width, (filled, hashes, where) in self.tables.items():
            seen = []
            for reading in looks:
                own = window_hashes(value, reading, width)
                look = filled[(own & np.uint64((1 << 20) - 1)).astype(np.int64)]
                for before in seen:
                    look &= own != before
                seen.append(own)
                near = np.flatnonzero(look)
                a, b = np.searchsorted(hashes, own[near], "left"), np.searchsorted(hashes, own[near], "right")
                for place, i, j in zip(near[b > a].tolist(), a[b > a].tolist(), b[b > a].tolist()):
                    for k, at in where[i:j].tolist():
                        yield width, place, k, at


def _consistent(value, shift, own, own_kind, places):
    """Places of an item whose slots are filled consistently, and whether any has another value."""
    to, back, good, changed = {}, {}, set(), False
    for p in sorted(places):
        if own_kind[p] == WORD:
            good.add(p)
            continue
        mine, theirs = int(own[p]), int(value[p + shift])
        if to.setdefault(mine, theirs) == theirs and back.setdefault(theirs, mine) == mine:
            good.add(p)
            changed |= mine != theirs
    return good, changed


def _long_run(good: set[int], told: set[int], run: int) -> tuple[int, int] | None:
    """First and last place of the longest run of `run` places or more, half of them told."""
    best, first, places = None, None, sorted(good)
    for k, p in enumerate(places):
        first = p if first is None else first
        if k + 1 == len(places) or places[k + 1] != p + 1:
            size = p + 1 - first
            if size >= run and 2 * sum(x in told for x in range(first, p + 1)) >= size and (best is None or size > best[1] + 1 - best[0]):
                best = first, p
            first = None
    return best


def matches(benchmark: Benchmark, texts: list[str], coverage: float, run: int = RUN):
    """(text, item, start, end, part of the item found, slots changed) for each item found in a text: `coverage`
    of its tokens, and `run` of them or four fifths if it has fewer, so that a stock phrase of a short item is not the
    item; or `run` neighbouring ones in a row, half of them real: words, or values as in the item."""
    start, end, value, kind, first, begin = template(texts)
    texts_of = np.searchsorted(first, np.arange(len(value)), side="right") - 1
    diagonals = defaultdict(set)
    for width, place, k, at in benchmark.hits(value, kind):
        text = int(texts_of[place])
        if place + width <= first[text + 1]:
            diagonals[text, k, place - at].update(range(at, at + width))
    found = defaultdict(lambda: [set(), False, [], [], []])
    for (text, k, shift), places in diagonals.items():
        _, own, own_kind = benchmark.items[k]
        good, changed = _consistent(value, shift, own, own_kind, places)
        if good:
            slot = found[text, k]
            slot[0] |= good
            slot[1] |= changed
            slot[2].append(int(start[min(good) + shift]))
            slot[3].append(int(end[max(good) + shift]))
            long = _long_run(good, {p for p in good if own[p] == value[p + shift]}, run)
            if long:
                slot[4].append((int(start[long[0] + shift]), int(end[long[1] + shift])))
    for (text, k), (good, changed, a, b, long) in found.items():
        item, own, _ = benchmark.items[k]
        if len(good) < max(coverage * len(own), min(run, SHORT * len(own))):
            a, b = [x for x, _ in long], [x for _, x in long]
        if a:
            yield text, item, min(a) - int(begin[text]), max(b) - int(begin[text]), len(good) / len(own), changed


def _scanned(sent, coverage, run):
    def scan(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = sorted(matches(sent.value, texts, coverage, run))
            column = batch.column(0)
            yield pa.RecordBatch.from_arrays([
                column.take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[k] for r in rows], t) for k, t in (
                    (1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.float64()), (5, pa.bool_())))],
                names=[c.split()[0] for c in SCHEMA.split(", ")])
    return scan


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, per_pass: int = PASS, run: int = RUN) -> DataFrame:
    """docs (doc_id, text, more) against benchmark (item_id, text, more): a row for each row of docs and item of
    which at least `coverage` of the template tokens is found (and `run` tokens, or four fifths of a shorter item),
    or a run of `run` neighbouring ones, half of them with their own values: doc_id, item_id, start and end (code
    points), coverage, reworded (some slot has another value).

    An item shorter than a window is one window; one of fewer than three distinct tokens ("What is?") cannot be told
    from ordinary words and is found nowhere. Null or empty texts and items have no tokens and no rows.
    Items that repeat an item_id, and rows that repeat a doc_id, are matched each. Whole texts are read.
    The items go to every task, `per_pass` of their characters at a time: a benchmark of any size takes
    one more scan of the documents for each such block. Other columns are ignored."""
    spark = docs.sparkSession
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    source = in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    passes, block, size = [], [], 0
    for row in [*items.toLocalIterator(), None]:  # a block at a time
        if row is not None:
            block.append(row)
            size += len(row.text)
        if block and (row is None or size >= per_pass):
            sent = spark.sparkContext.broadcast(Benchmark([r.item_id for r in block], [r.text for r in block], window))
            passes.append(source.mapInArrow(_scanned(sent, coverage, run), SCHEMA))
            block, size = [], 0
    return reduce(DataFrame.unionByName, passes) if passes else spark.createDataFrame([], SCHEMA)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of docs, with all their columns, in which no item is found. Each row is judged by its own text,
    whether its doc_id is null, repeated or neither."""
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = leaks(docs.select(key.alias("doc_id"), "text"), benchmark, **settings)
    gone = stage(found.select(F.col("doc_id").alias("leak_key")).distinct(), "leaks")
    return docs.withColumn("leak_key", key).join(small(gone), "leak_key", "left_anti").select(docs.columns)
