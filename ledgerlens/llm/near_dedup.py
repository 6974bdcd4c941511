"""MinHash near-duplicate removal with circulant signatures.

A first permutation scatters a document's shingles over a circle of D places; a second one, shifted
by k places, gives coordinate k. So all coordinates of a shingle are one slice of one table, and a
signature is the minimum over such slices. Coordinates are banded; pairs that share a band are
confirmed by the exact Jaccard similarity of their whole shingle sets.
"""
from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import codes
from ledgerlens.llm.links import resolve
from ledgerlens.llm.tables import in_batches, small, stage

#: Words in a shingle, percent of the union that a link shares, and the shape of the signature: with
#: 32 bands of 6, a pair at 85 percent is missed once in four million.
WIDTH, PERCENT, BANDS, ROWS = 3, 85, 32, 6
CIRCLE = 1 << 20


@cache
def _circle(coordinates: int):
    rng = np.random.RandomState(20)
    scatter = rng.permutation(CIRCLE).astype(np.uint32)
    shifted = rng.permutation(CIRCLE).astype(np.uint32)
    return scatter, np.lib.stride_tricks.sliding_window_view(np.concatenate([shifted, shifted[:coordinates]]), coordinates)


def slices(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """For each hash its slice of the shifted permutation: its value at every coordinate."""
    scatter, table = _circle(coordinates)
    return table[scatter[(shingles & np.uint64(CIRCLE - 1)).astype(np.int64)]]


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """The circulant MinHash of a set of 64-bit hashes."""
    out = np.full(coordinates, CIRCLE, dtype=np.uint32)
    for at in range(0, len(shingles), 4096):
        np.minimum(out, slices(shingles[at:at + 4096], coordinates).min(axis=0), out=out)
    return out


def band_hashes(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit hash for each row and band of a matrix of signatures."""
    parts = signatures.reshape(len(signatures), bands, -1).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * codes.GOLD, parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        out = codes.mix(out + parts[:, :, k] * codes.ROTORS[k])
    return out.view(np.int64)


def set_keys(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    return (int(codes.mix(shingles + codes.GOLD).sum(dtype=np.uint64).view(np.int64)),
            int(codes.mix(shingles ^ codes.GOLD).sum(dtype=np.uint64).view(np.int64)))


def _signed(width, bands, rows):
    """Column 2 is passed on as it is."""
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            _, _, hashes, first, _ = codes.words(texts)
            sets = [codes.shingles(hashes[a:b], width) for a, b in zip(first[:-1], first[1:])]
            full = [s for s in sets if len(s)]
            bits = band_hashes(np.stack([signature(s, bands * rows) for s in full]), bands) if full else np.zeros((0, bands), np.int64)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            keys = np.array([set_keys(s) if len(s) else (0, 0) for s in sets], dtype=np.int64).reshape(-1, 2)
            ends = np.cumsum([0] + [bands if len(s) else 0 for s in sets]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                                              pa.ListArray.from_arrays(pa.array(ends), pa.array(bits.ravel())), batch.column(2)],
                                             names=["doc_id", "n_shingles", "k1", "k2", "bands", "tkey"])
    return run


def _text_key():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs (doc_id, text, more): one row per row with doc_id, n_shingles, component_id, kept.

    A text's set holds its distinct shingles of `width` words (A-Z as a-z, words between white space);
    a shorter text is one shingle; a null or empty text, or one without words, has none and is linked
    with nothing. Texts are linked from `percent` of the union on; component_id is the smallest
    doc_id reachable; kept marks it. Equal sets are collapsed before anything is compared. Rows that
    repeat a doc_id are judged each by its own text. A null doc_id stays alone, with a null
    component_id, kept. Other columns are ignored."""
    return _judged(docs, width, percent, bands, rows).drop("tkey")


def _judged(docs, width, percent, bands, rows) -> DataFrame:
    source = in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stage(source.withColumn("tkey", _text_key()).mapInArrow(
        _signed(width, bands, rows), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, tkey long"), "signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stage(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("id")), "classes")
    lead = full.join(classes, ["k1", "k2"]).where("doc_id = id").select("id", "bands")
    texts = source.select(F.col("doc_id").alias("id"), "text").where("id is not null")

    comps, _ = resolve(lead, percent, width, lambda wanted: texts.join(wanted, "id", "left_semi"), "near")
    named = classes.join(comps, "id", "left").select("k1", "k2", F.coalesce("comp", "id").alias("component_id"))
    out = signed.drop("bands").join(named, ["k1", "k2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "tkey").withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns. A row goes by its doc_id and its text, so
    another text under the same doc_id stays; of rows that repeat both one stays. Rows without a doc_id stay."""
    judged = stage(_judged(docs, width, percent, bands, rows), "judged")
    gone = stage(judged.where("not kept").select("doc_id", F.col("tkey").alias("near_key")).distinct(), "removed")
    left = docs.withColumn("near_key", _text_key()).join(small(gone), ["doc_id", "near_key"], "left_anti")
    again = stage(judged.where("kept and doc_id is not null").groupBy("doc_id", F.col("tkey").alias("near_key")).agg(F.count("*").alias("n")).where("n > 1")
                  .select("doc_id", "near_key"), "repeated")
    if again.limit(1).count() == 0:
        return left.select(docs.columns)
    once = left.join(small(again), ["doc_id", "near_key"], "left_semi").dropDuplicates(["doc_id", "near_key"])
    return left.join(small(again), ["doc_id", "near_key"], "left_anti").unionByName(once).select(docs.columns)
