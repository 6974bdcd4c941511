"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two: full pieces of the longest
length, then one piece for each binary digit of the rest. Every piece is a sequence of its own, so
none is padded and none crosses documents; training draws batches from the buckets of equal length.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.tables import in_batches
from ledgerlens.llm.token_ids import binary, default_vocabulary, encoded

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def piece_lengths(tokens: int, longest: int) -> list[int]:
    """The lengths a document of so many tokens is cut into."""
    full, rest = divmod(tokens, longest)
    return [longest] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _pieces(vocabulary, longest, end_id):
    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0)
            for i, j, tokens, at in encoded(batch.column(1).to_pylist(), vocabulary, end_id):
                sizes = np.diff(at)
                lengths = [piece_lengths(int(n), longest) for n in sizes]
                count = np.array([len(x) for x in lengths])
                length = np.array([x for doc in lengths for x in doc], dtype=np.int64)
                place = np.append(0, np.cumsum(length))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(i, j - i).take(pa.array(np.repeat(np.arange(j - i), count))),
                    pa.array(place[:-1] - np.repeat(at[:-1], count)), pa.array(length), binary(tokens.astype("<u4"), place),
                    pa.array(np.repeat(sizes, count)), pa.array(number + np.arange(len(length))), pa.array(np.zeros(len(length), np.int64))],
                    names=[c.split()[0] for c in SCHEMA.split(", ")])
                number += len(length)
    return run


def pack(docs: DataFrame, vocabulary: str | None = None, longest: int = 1024, end_id: int = 0) -> DataFrame:
    """docs (doc_id, text, more) to pieces: doc_id, start (ids of the document before it), length (a power of
    two, `longest` at most), ids (little-endian unsigned 32-bit), doc_tokens (with the end id),
    sequence_id, offset (always 0: a piece fills its sequence).

    A null or empty text is the end id alone, a piece of one. A text of any length is encoded whole.
    Rows that repeat a doc_id, or have none, give pieces of their own. Sequence ids are unique and
    carry the task's number in their upper bits; the batches of one length are `bucket`s. Nothing is
    shuffled. Other columns are ignored."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    source = in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_pieces(vocabulary or default_vocabulary(), longest, end_id), SCHEMA)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder for each length, for a loader that draws batches of equal length."""
    pieces.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)
