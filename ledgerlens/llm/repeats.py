"""Substring dedup: paragraphs that repeat across documents.

Paragraphs of equal words are one class. Classes are banded by MinHash; colliding ones are confirmed by
the exact Jaccard similarity of their word shingles, and components of links make one passage of many
wordings. Chains of repeated paragraphs are removed but for their first place in the corpus. Passages that
stand inside lines are no paragraphs; `runs` finds them word by word, and they go the same way.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm import codes
from ledgerlens.llm.links import resolve
from ledgerlens.llm.near_dedup import band_hashes, slices
from ledgerlens.llm.runs import repeated_runs
from ledgerlens.llm.tables import in_batches, stage

#: Words in a shingle, percent of the union that a link shares, words of a run that counts as a passage,
#: rows of a band, and the part of pairs at the threshold that the bands may miss.
WIDTH, PERCENT, LEAST, ROWS, MISS = 5, 80, 50, 3, 1e-3
#: Below so many words two different paragraphs never share 80 percent of their shingles.
ALONE = 8


def bands_for(percent: int = PERCENT, rows: int = ROWS, miss: float = MISS) -> int:
    """The fewest bands that miss at most that part of the pairs at the threshold."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def split(texts: list[str]):
    """All paragraphs (lines with a word) of the texts: text index, start and end in the text, string."""
    for k, text in enumerate(texts):
        at = 0
        for line in text.split("\n"):
            if line.strip(codes.SPACES):
                yield k, at, at + len(line), line
            at += len(line) + 1


def _hashed(texts: list[str]):
    """The paragraphs of texts with their words: (index, start, end, line) lists, word hashes, first words, classes."""
    found = list(split(texts))
    _, _, hashes, first, _ = codes.words([p[3] for p in found])
    count = np.diff(first)
    if not len(found):
        return found, hashes, first, count, np.zeros(0, np.int64)
    place = np.arange(len(hashes)) - np.repeat(first[:-1], count)
    value = codes.mix(hashes + (place.astype(np.uint64) + np.uint64(1)) * codes.ROTORS[7])
    same = codes.mix(np.add.reduceat(value, first[:-1]) + count.astype(np.uint64) * codes.GOLD)
    return found, hashes, first, count, same.view(np.int64)


PLACES = "row long, doc_id long, no int, start long, end long, n_words long, id long"


def _placed(batches):
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        found, _, _, count, same = _hashed(texts)
        k = np.array([p[0] for p in found], dtype=np.int64)
        no = np.arange(len(k)) - np.searchsorted(k, k)
        yield pa.RecordBatch.from_arrays([
            pa.array(row + k), batch.column(0).take(pa.array(k)), pa.array(no.astype(np.int32)), pa.array([p[1] for p in found], pa.int64()),
            pa.array([p[2] for p in found], pa.int64()), pa.array(count), pa.array(same)], names=[c.split()[0] for c in PLACES.split(", ")])
        row += len(texts)


def signatures(hashes: np.ndarray, first: np.ndarray, count: np.ndarray, width: int, coordinates: int) -> np.ndarray:
    """Circulant MinHash of the shingles of every paragraph of `width` words or more."""
    shingle = np.zeros(max(0, len(hashes) - width + 1), dtype=np.uint64)
    for k in range(width):
        shingle = codes.mix(shingle + hashes[k:len(hashes) - width + 1 + k] * codes.ROTORS[k])
    out = np.zeros((len(count), coordinates), dtype=np.uint32)
    size = count - width + 1
    at = 0
    while at < len(count):  # some hundred thousand shingles at a time
        end = max(at + 1, int(np.searchsorted(first, first[at] + 100_000, side="right")) - 1)
        offset = np.cumsum(size[at:end]) - size[at:end]
        take = np.repeat(first[at:end] - offset, size[at:end]) + np.arange(int(size[at:end].sum()))
        for a in range(0, len(take), 1 << 20):  # one very long paragraph
            if end > at + 1 or len(take) <= 1 << 20:
                out[at:end] = np.minimum.reduceat(slices(shingle[take], coordinates), offset, axis=0)
                break
            part = slices(shingle[take[a:a + (1 << 20)]], coordinates).min(axis=0)
            out[at] = part if a == 0 else np.minimum(out[at], part)
        at = end
    return out


def _banded(width, bands, rows, alone):
    def run(batches):
        for batch in batches:
            found, hashes, first, count, same = _hashed([t or "" for t in batch.column(0).to_pylist()])
            _, once = np.unique(same, return_index=True)
            once = np.sort(once[count[once] >= max(alone, width)])
            keep = np.zeros(len(same), dtype=bool)
            keep[once] = True
            hashes = hashes[np.repeat(keep, count)]
            count, same = count[keep], same[keep]
            bits = band_hashes(signatures(hashes, np.append(0, np.cumsum(count)), count, width, bands * rows), bands) if len(count) else np.zeros((0, bands), np.int64)
            ends = (np.arange(len(count) + 1) * bands).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(same), pa.ListArray.from_arrays(pa.array(ends), pa.array(bits.ravel()))], names=["id", "bands"])
    return run


def _lines(batches):
    for batch in batches:
        found, _, _, _, same = _hashed([t or "" for t in batch.column(0).to_pylist()])
        _, once = np.unique(same, return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(same[once]), pa.array([found[k][3] for k in once.tolist()], pa.string())], names=["id", "text"])


def repeated(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, least: int = LEAST, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """docs (doc_id, text, more): the passages that several documents share, by paragraphs and by words.

    A row of kind "paragraph": a line with a word; its words lie between white space, A-Z as a-z. Paragraphs of
    the same words are one class (a 64-bit hash of the sequence names it: among 10^9 classes two are mistaken
    for one with a chance of 3 percent), and classes whose shingle sets share `percent` of their union are
    linked. A paragraph under 8 words is linked to equal ones only, as no other can share so much. A
    component that lies in two documents or more is repeated. Neighbouring repeated paragraphs are one chain
    where their two components are neighbours in another document too; a chain of `least` words together is a
    passage. Gives component, n_places, n_docs, passage_start, passage_words, and removed: False at the
    component's first place by (doc_id, start), True elsewhere.
    A row of kind "run": `least` words or more that stand word by word in another document, across lines or
    inside them (see `runs`); its component, n_places and n_docs are null.
    All rows have doc_id, start, end (code points) and n_words; rows of both kinds may overlap.

    Null and empty texts have no paragraphs, a null doc_id no place among the documents. Rows that repeat a
    doc_id are one document. Whole texts are read, of any length; other columns are ignored."""
    source = in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    texts = source.select("text")
    places = stage(source.mapInArrow(_placed, PLACES), "paragraphs")
    bands = stage(texts.mapInArrow(_banded(width, bands_for(percent, rows, miss), rows, ALONE), "id long, bands array<long>"), "paragraph-bands")

    def lines(wanted):
        return texts.mapInArrow(_lines, "id long, text string").join(wanted, "id", "left_semi").dropDuplicates(["id"])

    comps, _ = resolve(bands, percent, width, lines, "paragraphs")
    named = places.join(comps, "id", "left").withColumn("component", F.coalesce("comp", "id")).drop("comp", "id")
    named = stage(named, "named")
    # of each component the places by document first, so that a common line is few rows when it is shuffled
    by_doc = named.groupBy("component", "doc_id").agg(F.count("*").alias("n"), F.min("start").alias("start"))
    firsts = by_doc.groupBy("component").agg(F.sum("n").alias("n_places"), F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).where("n_docs > 1")
    lead = (by_doc.join(firsts, "component").where("doc_id = first_doc").select("component", "n_places", "n_docs", "first_doc", F.col("start").alias("first_start")))
    shared = named.join(lead, "component")
    order = W.partitionBy("row").orderBy("no")
    follower = F.when(F.lead("no").over(order) == F.col("no") + 1, F.lead("component").over(order))
    shared = stage(shared.withColumn("follower", follower), "shared")
    chained = (shared.where("follower is not null").groupBy("component", "follower").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
               .where("lo < hi").select("component", "follower", F.lit(1).alias("goes_on")))
    runs = shared.join(chained, ["component", "follower"], "left")
    opens = F.when((F.lag("goes_on").over(order) == 1) & (F.lag("no").over(order) == F.col("no") - 1), 0).otherwise(1)
    runs = runs.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order))
    run = W.partitionBy("row", "run")
    chains = runs.withColumns({"passage_start": F.min("start").over(run), "passage_words": F.sum("n_words").over(run)}).where(F.col("passage_words") >= least)
    lines = chains.select(F.lit("paragraph").alias("kind"), "doc_id", "start", "end", "n_words", "component", "n_places", "n_docs", "passage_start", "passage_words",
                          ((F.col("doc_id") != F.col("first_doc")) | (F.col("start") != F.col("first_start"))).alias("removed"))
    inside = repeated_runs(source.where("text is not null"), least)
    null = F.lit(None).cast("long")
    return lines.unionByName(inside.select(
        F.lit("run").alias("kind"), "doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("n_words").cast("long").alias("n_words"),
        null.alias("component"), null.alias("n_places"), null.alias("n_docs"), F.col("start").cast("long").alias("passage_start"),
        F.col("n_words").cast("long").alias("passage_words"), "removed"))


def _without(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """Texts without the characters from each start to its end; starts ascend, spans may overlap."""
    out = []
    for text, first, last in zip(texts, starts, ends):
        if text is not None and first is not None:
            at, parts = 0, []
            for a, b in zip(first.tolist(), last.tolist()):
                parts.append(text[at:max(at, a)])
                at = max(at, b)
            text = "".join([*parts, text[at:]])
        out.append(text)
    return pd.Series(out, dtype=object)


def without_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents, with all their columns, without their removed paragraphs (with their line ends) and runs.
    found: the rows of repeated. Rows that repeat a doc_id must repeat its text; rows without one stay as they are."""
    end = F.col("end") + F.when(F.col("kind") == "paragraph", 1).otherwise(0)
    cuts = found.where("removed").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", end.alias("end")))).alias("repeat_cuts"))
    joined = in_batches(docs).join(cuts, "doc_id", "left")
    without = F.pandas_udf(_without, "string")
    return joined.withColumn("text", without("text", "repeat_cuts.start", "repeat_cuts.end")).select(docs.columns)
