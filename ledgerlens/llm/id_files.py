"""Token ids in files: frequency ranks in a byte-aligned code with separate control bytes.

An id is written as its rank by frequency, in one to four bytes. Control bytes hold the lengths of
four ranks each, two bits a rank, apart from the data bytes, so a reader finds all places at once by
table lookup. Files are Parquet with one row a document (doc_id, ordinal, n_tokens, control, data),
in ascending doc_id order within and across files, so that any store and any committer Spark knows
will do; a small table beside them names the id of each rank.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.tables import fresh, in_batches
from ledgerlens.llm.token_ids import binary, default_vocabulary, encoded, encoder, flat, groups

FILE = "doc_id long, ordinal long, n_tokens long, control binary, data binary"
#: Lengths of the four ranks of a control byte.
LENGTHS = np.stack([(np.arange(256) >> 2 * k & 3) + 1 for k in range(4)], axis=1).astype(np.uint8)


def _slots(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ranks of rows of n ranks each, when every row begins a control byte of its own; where the rows' control bytes begin."""
    control = np.append(0, np.cumsum(-(-n // 4)))
    return np.arange(n.sum()) + np.repeat(4 * control[:-1] - (np.cumsum(n) - n), n), control


def rows_bytes(ranks: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes, where each row's begin, data bytes, where each row's begin; `at`: where each row's ranks (unsigned 32-bit) begin."""
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    slot, control_at = _slots(np.diff(at))
    code = np.zeros(4 * control_at[-1], dtype=np.uint8)
    code[slot] = size - 1
    control = code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    four = ranks.astype("<u4").view(np.uint8).reshape(len(ranks), 4)
    return control, control_at, four[np.arange(4) < size[:, None]], np.append(0, np.cumsum(size, dtype=np.int64))[at]


def rows_ranks(control: np.ndarray, data: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranks of rows of n ranks each, from the control bytes and the data bytes of all rows in a row."""
    slot, _ = _slots(n)
    size = LENGTHS[control].ravel()[slot]
    place = np.cumsum(size, dtype=np.int64) - size
    out = data[place].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(size > k)
        out[longer] |= data[place[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def rank_bytes(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of one row's ranks."""
    control, _, data, _ = rows_bytes(ranks, np.array([0, len(ranks)]))
    return control.tobytes(), data.tobytes()


def byte_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of one row's control and data bytes."""
    return rows_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), np.array([n]))


def _encoded(vocabulary, end_id, kind):
    def run(batches):
        for batch in batches:
            for i, j, tokens, at in encoded(batch.column(1).to_pylist(), vocabulary, end_id):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at)), binary(tokens.astype(kind), at)],
                                                 names=["doc_id", "n_tokens", "ids"])
    return run


def _counted(kind):
    def run(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            n = np.bincount(flat(batch.column(0), kind)[0])
            if len(n) > len(total):
                n[:len(total)] += total
                total = n
            else:
                total[:len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])
    return run


def _written(ids_by_rank, kind):
    rank = np.zeros(int(ids_by_rank.max()) + 1 if len(ids_by_rank) else 0, dtype=np.uint32)
    rank[ids_by_rank] = np.arange(len(ids_by_rank), dtype=np.uint32)

    def run(batches):
        ordinal = 0
        for batch in batches:
            ids, at = flat(batch.column(2), kind)
            for i, j in groups(np.diff(at)):
                control, control_at, data, data_at = rows_bytes(rank[ids[at[i]:at[j]]], at[i:j + 1] - at[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.arange(ordinal, ordinal + j - i)), batch.column(1).slice(i, j - i),
                                                  binary(control, control_at), binary(data, data_at)],
                                                 names=["doc_id", "ordinal", "n_tokens", "control", "data"])
                ordinal += j - i
    return run


def _read(ids_by_rank, digest):
    def run(batches):
        for batch in batches:
            n = batch.column(3).to_numpy()
            (control, control_at), (data, data_at) = (flat(batch.column(k), np.uint8) for k in (4, 5))
            for i, j in groups(n):
                ids = ids_by_rank[rows_ranks(control[control_at[i]:control_at[j]], data[data_at[i]:data_at[j]], n[i:j])].astype("<u4")
                at = np.append(0, np.cumsum(n[i:j]))
                last = pa.array([zlib.crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64()) if digest else binary(ids, at)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(4)), last], names=["file", "doc_id", "ordinal", "n_tokens", "ids"])
    return run


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 0) -> None:
    """Write the ids of docs (doc_id, text, more) below `path`, ascending by doc_id, an end id after each document.

    Every text is encoded whole and once; the ids lie in a table below `path` until their frequencies
    over the whole corpus are known (one row an id of the vocabulary, the only rows that reach the
    driver). A null or empty text is the end id alone; rows that repeat a doc_id stay, in order of
    their ids; a null doc_id comes first. Other columns are ignored."""
    spark = docs.sparkSession
    source = in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vocabulary = vocabulary or default_vocabulary()
    kind = "<u2" if max(encoder(vocabulary).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    raw = source.mapInArrow(_encoded(vocabulary, end_id, kind), "doc_id long, n_tokens long, ids binary")
    raw.write.option("compression", "zstd").parquet(f"{path}/raw")
    raw = spark.read.schema(raw.schema).parquet(f"{path}/raw")
    ranks = raw.select("ids").mapInArrow(_counted(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id")
    by_rank = np.array([r.id for r in ranks.collect()], dtype=np.int64)
    spark.createDataFrame([(k, int(i)) for k, i in enumerate(by_rank)], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    ordered = raw.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(_written(by_rank, kind), FILE).write.option("compression", "zstd").parquet(f"{path}/ids")


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """The documents of the files below `path`: doc_id, start (ids of all documents before it), n_tokens and
    ids (little-endian unsigned 32-bit), or with `digest` ids_crc32 instead, which spares their transport."""
    by_rank = np.array([r.id for r in spark.read.schema("rank long, id long").parquet(f"{path}/ranks").orderBy("rank").collect()], dtype=np.uint32)
    files = spark.read.schema(FILE).parquet(f"{path}/ids").select(F.col("_metadata.file_name").alias("file"), "*")
    last = "ids long" if digest else "ids binary"
    docs = files.mapInArrow(_read(by_rank, digest), f"file string, doc_id long, ordinal long, n_tokens long, {last}")
    # one row a file; names carry the number of the file, of five digits or more
    sums = files.groupBy("file").agg(F.sum("n_tokens").alias("n")).orderBy(F.length("file"), "file").collect()
    before = np.cumsum([0] + [r.n for r in sums]).tolist()
    base = spark.createDataFrame([(r.file, b) for r, b in zip(sums, before)], "file string, base long")
    running = F.sum("n_tokens").over(W.partitionBy("file").orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1))
    return docs.join(F.broadcast(base), "file").select(
        "doc_id", (F.col("base") + F.coalesce(running, F.lit(0))).alias("start"), "n_tokens", F.col("ids").alias("ids_crc32" if digest else "ids"))


def round_trip(docs: DataFrame, **settings) -> DataFrame:
    """Write the ids to the shared folder and read them back: doc_id, start, n_tokens, ids_crc32."""
    path = fresh(docs.sparkSession, "ids")
    write_ids(docs, path, **settings)
    return read_ids(docs.sparkSession, path, digest=True)
