"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-gram places per language are summed over all labelled rows by Spark; the matrix of log
probabilities (places x languages, its size fixed by parameters) goes to every task, and numpy scores
batches of whole texts.
"""
from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import codes
from ledgerlens.llm.tables import in_batches

#: Lengths of the n-grams, places they are hashed to, added count, and the most languages a model may have.
ORDERS, PLACES, SMOOTH, MOST = (1, 2, 3), 1 << 16, 0.5, 256
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def grams(texts: list[str]):
    """For blocks of the texts: the places of all n-grams, and the index of the text of each. Upper case counts
    as lower, white space, digits and signs in a row after a letter as one blank."""
    for base, block in codes.text_blocks([t.lower() for t in texts]):
        ends = np.cumsum([len(t) + 1 for t in block])
        points = codes.code_points("\n".join(block) + "\n")
        letter = _letters()[points]
        keep = letter | np.append(False, letter[:-1])
        text = base + np.searchsorted(ends, np.flatnonzero(keep), side="right")
        points = np.where(letter, points, 32)[keep].astype(np.uint64)
        value = np.zeros(len(points), dtype=np.uint64)
        for n in range(1, max(ORDERS) + 1):
            shifted = points[n - 1:]
            value = (value[:len(shifted)] + shifted) * codes.GOLD
            if n in ORDERS:
                same = text[:len(shifted)] == text[n - 1:]
                place = (codes.mix(value + np.uint64(n)) & np.uint64(PLACES - 1)).astype(np.int64)
                yield place[same], text[:len(shifted)][same]


def _counts(labels):
    index = {name: k for k, name in enumerate(labels)}

    def run(batches):
        total = np.zeros((len(labels), PLACES), dtype=np.int64)
        for batch in batches:
            own = np.array([index[x] for x in batch.column(1).to_pylist()], dtype=np.int64)
            for place, text in grams(batch.column(0).to_pylist()):
                total += np.bincount(own[text] * PLACES + place, minlength=total.size).reshape(total.shape)
        k, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(place), pa.array(total[k, place])], names=["k", "place", "n"])
    return run


class Model:
    """Languages and the logarithms of their n-gram probabilities (places x languages)."""

    def __init__(self, labels: list[str], log_probability: np.ndarray):
        self.labels, self.log_probability = labels, log_probability

    def score(self, texts: list[str]) -> np.ndarray:
        """Posterior probability of each language for each text, all languages alike before it is read."""
        out = np.zeros((len(texts), len(self.labels)))
        for place, text in grams(texts):
            if len(text):
                first = np.flatnonzero(np.diff(text, prepend=-1))
                out[text[first]] += np.add.reduceat(self.log_probability[place], first, axis=0, dtype=np.float64)
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)


def fit(rows: DataFrame) -> Model:
    """A model of rows (text, lang). Rows without text or lang teach nothing; all others are read whole.
    More than MOST languages are refused, as the matrix must fit a task."""
    rows = in_batches(rows).where("text is not null and lang is not null").select("text", "lang")
    labels = sorted(r.lang for r in rows.select("lang").distinct().limit(MOST + 1).collect())
    if len(labels) > MOST:
        raise ValueError(f"more than {MOST} languages")
    counts = np.full((len(labels), PLACES), SMOOTH)
    summed = rows.mapInArrow(_counts(labels), "k long, place long, n long").groupBy("k", "place").agg(F.sum("n").alias("n"))
    got = summed.toArrow() if labels else None  # at most languages x places rows
    if got is not None and got.num_rows:
        counts[got["k"].to_numpy(), got["place"].to_numpy()] += got["n"].to_numpy()
    return Model(labels, np.ascontiguousarray(np.log(counts / counts.sum(axis=1, keepdims=True)).T, dtype=np.float32))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True for the rows of the fold that teaches nothing; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0)) == fold


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, more) with lang_pred and score; columns of these names are replaced, others stay.

    lang_pred is one of the model's languages, with its posterior probability as score; `und` and 0
    if the text is null or has no letter, or the model is empty. Ties go to the first language in
    alphabetical order. The whole text is read; other columns are not."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def named(column: pd.Series) -> pd.DataFrame:
        model = sent.value
        texts = [t or "" for t in column]
        spoken = np.array([any(map(str.isalpha, t)) for t in texts], dtype=bool) & bool(model.labels)
        chance = model.score(texts) if model.labels else np.zeros((len(texts), 1))
        best = chance.argmax(axis=1)
        return pd.DataFrame({"lang_pred": [model.labels[b] if s else UNKNOWN for b, s in zip(best, spoken)],
                             "score": np.where(spoken, chance[np.arange(len(best)), best], 0.0)})

    out = in_batches(docs).withColumn("lang_pred", named(F.col("text").cast("string")))
    return out.withColumns({"score": F.col("lang_pred.score"), "lang_pred": F.col("lang_pred.lang_pred")})


def spoken(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents, with their own columns, whose language the model names with a probability of `least`;
    texts without a letter go."""
    marked = docs.withColumn("lang_marked", F.struct("*"))
    return languages(marked, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("lang_marked.*")
