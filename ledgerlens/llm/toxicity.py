"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

Two words are alike as far as they share subsequences of three characters, each gap inside one making
it count for less; so a word with a character put in or left out stays near. Sentences are compared by
the sharpened likeness of their words, approximated through landmarks: strings that labelled toxic
texts have more often than clean ones. A linear machine on these coordinates is trained on sentences;
a toxic document teaches by its worst sentence, a clean one by all of its suspicious ones. A document
scores as its worst sentence.
"""
from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import codes
from ledgerlens.llm.tables import in_batches, sampled, small, stage

#: Labelled rows of each label that are learned from, about, landmarks, weight of a gap, power of the word
#: kernel, sentences of a document that may teach, and words whose score a worker remembers.
SAMPLE, LANDMARKS, GAP, POWER, TEACH, REMEMBERED = 4000, 128, 0.7, 4, 3, 500_000
#: Distances between the characters of a subsequence, over five places at most.
STEPS = ((1, 1), (1, 2), (2, 1), (1, 3), (2, 2), (3, 1))
#: Lengths of the strings that may be landmarks.
SHORT, LONG = 4, 8
PLACES = 1 << 18


@cache
def _tables():
    alive = np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)
    lower = np.fromiter((ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(0x110000)), dtype=np.uint32, count=0x110000)
    return alive, lower


def subsequences(points: np.ndarray, word: np.ndarray):
    """For the characters of some words in a row: (word, place, weight) of all their subsequences."""
    value = points.astype(np.uint64)
    for a, b in STEPS:
        n = len(points) - a - b
        if n <= 0:
            continue
        same = word[:n] == word[a + b:]
        place = codes.mix(value[:n] * codes.GOLD + value[a:a + n] * codes.ROTORS[3] + value[a + b:] * codes.ROTORS[11]) & np.uint64(PLACES - 1)
        yield word[:n][same], place[same].astype(np.int64), GAP ** (a + b - 2)


class Landmarks:
    """The kernel between any words and some landmark strings."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        points, word = _joined(strings)
        parts = list(subsequences(points, word))
        places = np.unique(np.concatenate([p for _, p, _ in parts])) if parts else np.zeros(0, np.int64)
        self.row = np.full(PLACES, -1, dtype=np.int32)
        self.row[places] = np.arange(len(places))
        self.matrix = np.zeros((len(places), len(strings)), dtype=np.float32)
        norm = np.zeros(len(strings))
        for w, p, weight in parts:
            np.add.at(self.matrix, (self.row[p], w), weight)
            norm += np.bincount(w, minlength=len(strings)) * weight ** 2
        self.matrix /= np.sqrt(np.maximum(norm, 1e-9)).astype(np.float32)

    def kernel(self, points: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        """n words x landmarks: the sharpened kernel of words given by their characters."""
        out = np.zeros((n, len(self.strings)), dtype=np.float32)
        norm = np.zeros(n)
        hits = []
        for w, p, weight in subsequences(points, word):
            norm += np.bincount(w, minlength=n) * weight ** 2
            row = self.row[p]
            hit = np.flatnonzero(row >= 0)
            hits.append((w[hit], row[hit], np.full(len(hit), weight, dtype=np.float32)))
        if hits:
            w, row, weight = (np.concatenate(x) for x in zip(*hits))
            order = np.argsort(w, kind="stable")
            block = max(256, (1 << 22) // len(self.strings))  # some 16 MB at a time
            for at in range(0, len(order), block):
                part = order[at:at + block]
                first = np.flatnonzero(np.diff(w[part], prepend=-1))
                out[w[part][first]] += np.add.reduceat(self.matrix[row[part]] * weight[part][:, None], first, axis=0)
        return (out / np.sqrt(np.maximum(norm, 1e-9))[:, None].astype(np.float32)) ** POWER


def _joined(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points = codes.code_points("".join(strings))
    return points, np.repeat(np.arange(len(strings)), [len(s) for s in strings])


def sentences(texts: list[str]):
    """For blocks of texts: the words' characters in a row, where each word begins, each word's sentence, each
    sentence's text.

    A word lies between white space, without the signs around it, in lower case; three single characters or
    more in a row are one word. A sentence ends with a line or after . ! or ?"""
    alive, lower = _tables()
    for base, block in codes.text_blocks(texts):
        points = codes.code_points("\n".join(block) + "\n")
        ends = np.cumsum([len(t) + 1 for t in block])
        start, end = codes.runs(~codes.is_space(points))
        if not len(start):
            continue
        good = alive[points]
        before = np.append(0, np.cumsum(good))
        line = np.append(0, np.cumsum(points == 10))
        stop = (points == 46) | (points == 33) | (points == 63)
        text = base + np.searchsorted(ends, start, side="right")
        # a new sentence after a line's end, or after a word with a stop behind its last letter
        place = np.arange(len(points))
        last = np.maximum.accumulate(np.where(good, place, -1))[end - 1]
        stops = np.append(0, np.cumsum(stop))
        closed = stops[end] > stops[np.maximum(last + 1, start)]
        fresh = np.append(True, (line[start[1:]] > line[start[:-1]]) | closed[:-1])
        sentence = np.cumsum(fresh) - 1
        after = np.append(place[good], len(points))
        first = after[before[start]]
        kept = before[end] > before[start]  # words with a letter or digit
        first, last, sentence, text = first[kept], last[kept] + 1, sentence[kept], text[kept]
        if not len(first):
            continue
        single = (last - first == 1)
        same = np.append(False, single[1:] & single[:-1] & (sentence[1:] == sentence[:-1]))
        group = np.cumsum(~same) - 1
        size = np.bincount(group)
        alone = ~same | (size[group] < 3)
        word = np.cumsum(alone) - 1
        sizes = last - first
        take = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        chars = lower[points[take]]
        begin = (np.cumsum(sizes) - sizes)[alone]
        yield chars, begin, sentence[alone], text[alone]


def _distinct(chars, begin):
    """Distinct words: their hashes, the characters and word numbers of one of each, and which word each one is."""
    sizes = np.diff(begin, append=len(chars))
    hashes = codes.hash_pieces(chars, begin, sizes)
    distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    return distinct, begin[first], sizes[first], which


def _characters(chars, at, size):
    take = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return chars[take], np.repeat(np.arange(len(at)), size)


class Machine:
    """A weight for each landmark and a threshold, and the curve from margins to probabilities."""

    def __init__(self, landmarks: Landmarks, weight: np.ndarray, bias: float, slope: float, shift: float):
        self.landmarks, self.weight, self.bias, self.slope, self.shift = landmarks, weight, bias, slope, shift
        self.hashes, self.known = np.zeros(0, np.uint64), np.zeros(0)

    def _words(self, chars, begin) -> np.ndarray:
        distinct, at, size, which = _distinct(chars, begin)
        place = np.searchsorted(self.hashes, distinct)
        place[place == len(self.hashes)] = 0
        new = self.hashes[place] != distinct if len(self.hashes) else np.ones(len(distinct), dtype=bool)
        value = np.zeros(len(distinct))
        if len(self.hashes):
            value[~new] = self.known[place[~new]]
        if new.any():
            points, word = _characters(chars, at[new], size[new])
            value[new] = self.landmarks.kernel(points, word, int(new.sum())) @ self.weight
            if len(self.hashes) > REMEMBERED:
                self.hashes, self.known = distinct[:0], value[:0]
            merged = np.concatenate([self.hashes, distinct[new]])
            order = np.argsort(merged, kind="stable")
            self.hashes, self.known = merged[order], np.concatenate([self.known, value[new]])[order]
        return value[which]

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability that each text is toxic, by its worst sentence."""
        margin = np.zeros(len(texts))
        for chars, begin, sentence, text in sentences(texts):
            first = np.flatnonzero(np.diff(sentence, prepend=-1))
            each = np.add.reduceat(self._words(chars, begin), first)
            np.maximum.at(margin, text[first], each)
        return 1 / (1 + np.exp(-np.clip(self.slope * (margin + self.bias) + self.shift, -500, 500)))


class Constant:
    def __init__(self, value: float):
        self.value = value

    def score(self, texts):
        return np.full(len(texts), self.value)


def _fragments(taught: DataFrame, most: int) -> list[str]:
    """Strings of words that toxic texts have most in excess of clean ones, unlike ones first."""
    @F.pandas_udf("array<string>")
    def words(column: pd.Series) -> pd.Series:
        def of(text):
            out = set()
            for chars, begin, _, _ in sentences([text]):
                string = "".join(map(chr, chars))
                out.update(string[a:b] for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(string)]))
            return [w for w in out if SHORT <= len(w) <= 40]
        return column.map(of)

    toxic, clean = (F.sum((F.col("toxic") == k).cast("int")) for k in (1, 0))
    vocabulary = taught.select("toxic", F.explode(words("text")).alias("w")).groupBy("w").agg(toxic.alias("t"), clean.alias("c"))
    start = F.explode(F.sequence(F.lit(1), F.length("w") - SHORT + 1))
    pieces = (vocabulary.select("w", "t", "c", start.alias("i"))
              .select("w", "t", "c", F.explode(F.transform(F.sequence(F.lit(SHORT), F.least(F.lit(LONG), F.length("w") - F.col("i") + 1)), lambda n: F.substring("w", F.col("i"), n))).alias("s")))
    totals = {r.toxic: r["count"] for r in taught.groupBy("toxic").count().collect()}
    share = totals[1] / (totals[0] + totals[1])
    n = F.col("t") + F.col("c")
    excess = (F.col("t") - n * share) / F.sqrt(n * share * (1 - share) + 1)
    counted = pieces.groupBy("s").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(F.col("t") >= 3).withColumn("z", excess)
    ranked = [r.s for r in counted.orderBy(F.desc("z"), F.desc(F.length("s")), "s").limit(8 * most).collect()]
    chosen: list[str] = []
    if ranked:
        near = Landmarks(ranked)
        like = near.kernel(*_joined(ranked), len(ranked)) ** (1 / POWER)
        left = np.ones(len(ranked), dtype=bool)
        for k in range(len(ranked)):
            if left[k] and len(chosen) < most:
                chosen.append(ranked[k])
                left &= like[:, k] < 0.8
    return chosen


def _machine(z: np.ndarray, y: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a squared-hinge machine; of a toxic document only its worst sentence counts, chosen anew
    by the machine of the round before. Both labels weigh alike."""
    weight, bias = np.ones(z.shape[1]) / z.shape[1], 0.0
    for _ in range(4):
        margin = z @ weight
        order = np.lexsort((-margin, doc))
        worst = order[np.flatnonzero(np.diff(doc[order], prepend=-1))]
        use = np.union1d(np.flatnonzero(y == 0), worst[y[worst] == 1])
        x, t = np.column_stack([z[use], np.ones(len(use))]), np.where(y[use] == 1, 1.0, -1.0)
        cost = np.where(t > 0, 0.5 / max(1, (t > 0).sum()), 0.5 / max(1, (t < 0).sum()))
        ridge = np.append(np.full(z.shape[1], 1e-5), 1e-9)
        w = np.zeros(x.shape[1])
        for _ in range(50):
            inside = t * (x @ w) < 1
            xs, c = x[inside], cost[inside]
            new = np.linalg.solve((xs * c[:, None]).T @ xs + np.diag(ridge), (xs * (c * t[inside])[:, None]).sum(axis=0))
            if np.abs(new - w).max() < 1e-8:
                break
            w = new
        weight, bias = w[:-1], float(w[-1])
    return weight, bias


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins, on labels drawn in a little from 0 and 1."""
    high, low = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (high + 1) / (high + 2), 1 / (low + 2))
    x = np.column_stack([margin, np.ones(len(margin))])
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * w)
        w += np.clip(step, -5, 5)
    return float(max(w[0], 1e-3)), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS):
    """A machine fitted on docs (doc_id, text) that labels (doc_id, toxic) mark, about `sample` of each label
    (chosen by the hash of their doc_id); a document with several labels is toxic if one says so.
    Without toxic or without clean texts every text scores as the share of toxic ones."""
    docs = in_batches(docs)
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    marked = stage(marked, "labels")
    few = stage(sampled(marked.where("toxic = 0"), F.col("doc_id"), sample).unionByName(sampled(marked.where("toxic = 1"), F.col("doc_id"), sample)), "few-labels")
    taught = stage(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(small(few), "doc_id"), "taught")
    totals = {r.toxic: r["count"] for r in taught.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return Constant(1.0 if 1 in totals else 0.0)
    strings = _fragments(taught, landmarks)
    if not strings:
        return Constant(totals[1] / sum(totals.values()))
    marks = Landmarks(strings)

    def suspicious(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [[] for _ in texts]
            for chars, begin, sentence, text in sentences(texts):
                _, at, size, which = _distinct(chars, begin)
                kernel = marks.kernel(*_characters(chars, at, size), len(at))
                first = np.flatnonzero(np.diff(sentence, prepend=-1))
                z = np.add.reduceat(kernel[which], first, axis=0)
                for k, v in zip(text[first].tolist(), z):
                    rows[k] = sorted([*rows[k], v], key=lambda v: -v.sum())[:TEACH]
            n = [len(r) for r in rows]
            flat = [v for r in rows for v in r]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), batch.column(2).take(pa.array(np.repeat(np.arange(len(n)), n))),
                pa.array([v.tobytes() for v in flat], pa.binary())], names=["doc_id", "toxic", "z"])

    got = taught.select("doc_id", "text", "toxic").mapInArrow(suspicious, "doc_id long, toxic int, z binary").toArrow()
    z = np.frombuffer(b"".join(v.as_py() for v in got["z"]), dtype=np.float32).reshape(got.num_rows, -1).astype(float) if got.num_rows else np.zeros((0, len(strings)))
    doc, y = np.unique(got["doc_id"].to_numpy(), return_inverse=True)[1], got["toxic"].to_numpy()
    if len(set(y.tolist())) < 2:
        return Constant(totals[1] / sum(totals.values()))
    own = marks.kernel(*_joined(strings), len(strings)).astype(float)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    value = np.maximum(value, 1e-3)
    half = vector / np.sqrt(value) @ vector.T  # Nyström coordinates are the kernel to the landmarks times this
    weight, bias = _machine(z @ half, y, doc)
    margin = np.zeros(doc.max() + 1)
    np.maximum.at(margin, doc, z @ (half @ weight))
    label = np.zeros(len(margin), dtype=int)
    label[doc] = y
    slope, shift = _curve(margin + bias, label)
    return Machine(marks, half @ weight, bias, slope, shift)


def toxicity(docs: DataFrame, machine) -> DataFrame:
    """docs (text, more) with score, the probability that the whole text is toxic; a column of that name is
    replaced, others stay. A null or empty text has no sentence and scores as one without a suspicious word."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        return pd.Series(sent.value.score([t or "" for t in column]))

    return in_batches(docs).withColumn("score", score(F.col("text").cast("string")))
