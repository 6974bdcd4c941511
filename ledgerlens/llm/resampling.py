"""Importance resampling towards a target distribution.

Features of documents fall into hashed buckets; the log ratio of the target's and the corpus's bucket
frequencies is a bucket's gain, and a document's weight is the sum over its features, looked up as
arrays. Gumbel noise of the document's id makes the highest scores a draw without replacement. The
cutoff is found by weighted median-of-medians: every part names the median of what it still holds, the
median of these, weighted by the parts' sizes, has a quarter of all on either side at least, and the
side that cannot hold the cutoff is discarded, until one key is left. Only the winners are sorted.
"""
from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import codes
from ledgerlens.llm.tables import in_batches, stage

#: Longest run of words that is a feature, buckets, least words of a document that may be drawn, percent
#: drawn, and the seed of the noise.
LONGEST, BUCKETS, LEAST, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Keys of one part whose median is taken in one piece (24 bytes each).
PART = 2_000_000
#: Distinct words whose buckets a task remembers.
REMEMBERED = 300_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
KEY = ["low", "id", "row"]


class _Buckets(dict):
    """The bucket of a feature, remembered."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        at = self[feature] = zlib.crc32(feature) % self.buckets
        return at


def features(text: str, longest: int, table: _Buckets) -> tuple[int, np.ndarray]:
    """The number of words of a text and the buckets of all its runs of 1 to `longest` words."""
    count, out, before = 0, [], []
    for _, part in codes.blocks(text):  # cut at white space, where no word goes on
        found = _WORD.findall(part.encode("utf-8", "surrogatepass").lower())
        count += len(found)
        out.append(np.fromiter(map(table.__getitem__, found), dtype=np.uint32, count=len(found)))
        if longest > 1:
            row = before + found
            for k in range(2, longest + 1):
                first = max(0, len(before) - k + 1)
                runs = [b" ".join(row[i:i + k]) for i in range(first, len(row) - k + 1)]
                out.append(np.fromiter(map(table.__getitem__, runs), dtype=np.uint32, count=len(runs)))
            before = row[max(0, len(row) - longest + 1):]
    return count, np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def _hashed(longest, buckets, kind):
    def run(batches):
        table = _Buckets(buckets)
        for batch in batches:
            found = [features(t or "", longest, table) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([len(b) for _, b in found], pa.int64()),
                pa.array([b.astype(kind).tobytes() for _, b in found], pa.binary())], names=["doc_id", "n_words", "n_features", "buckets"])
    return run


def _slices(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of bytes in a row, and where each row's begin (one more entry at the end)."""
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(kind), (at - at[0]) // np.dtype(kind).itemsize


def _counted(buckets, kind):
    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_slices(batch.column(0), kind)[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], names=["bucket", "n"])
    return run


def _weighed(gains, kind):
    def run(batches):
        for batch in batches:
            at, first = _slices(batch.column(3), kind)
            running = np.append(0, np.cumsum(gains[at]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(running[first[1:]] - running[first[:-1]])],
                                             names=["doc_id", "n_words", "n_features", "weight"])
    return run


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def hashed(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and buckets (bytes) of every row of docs (doc_id, text, more)."""
    source = in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_hashed(longest, buckets, _kind(buckets)), "doc_id long, n_words long, n_features long, buckets binary")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket, over all rows of hashed."""
    counts = found.select("buckets").mapInArrow(_counted(buckets, _kind(buckets)), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in counts.collect():  # `buckets` rows at most
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket."""
    k, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * float(s + k) / ((a + 1.0) * float(t + k)))) for a, b in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def kth(columns: list[np.ndarray], k: int) -> tuple[int, ...]:
    """The k-th smallest row (from 0) of columns compared one after the other, without sorting."""
    rows = np.arange(len(columns[0]))
    for c in columns:
        if len(rows) == 1:
            break
        values = c[rows]
        value = np.partition(values, k)[k]
        k -= int((values < value).sum())
        rows = rows[values == value]
    return tuple(int(c[rows[0]]) for c in columns)


def below(columns: list[np.ndarray], key: tuple[int, ...]) -> np.ndarray:
    """Flags of the rows that come before the key."""
    out = np.zeros(len(columns[0]), dtype=bool)
    for c, v in zip(reversed(columns), reversed(key)):
        out = (c < v) | ((c == v) & out)
    return out


def _medians(low, high, pivot, part):
    """Of the keys after `low` and before `high`: (side of the pivot, size, median) of each side, part by part."""
    def summary(columns):
        sides = [np.ones(len(columns[0]), bool)] if pivot is None else [s := below(columns, pivot), ~s & ~np.logical_and.reduce([c == v for c, v in zip(columns, pivot)])]
        for side, flags in enumerate(sides):
            n = int(flags.sum())
            if n:
                yield (side, n, *kth([c[flags] for c in columns], (n - 1) // 2))

    def run(batches):
        held, size, out = [], 0, []
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            keep = np.ones(batch.num_rows, dtype=bool)
            if high is not None:
                keep &= below(columns, high)
            if low is not None:
                keep &= ~below(columns, low) & ~np.logical_and.reduce([c == v for c, v in zip(columns, low)])
            held.append([c[keep] for c in columns])
            size += int(keep.sum())
            if size >= part:
                out += summary([np.concatenate(c) for c in zip(*held)])
                held, size = [], 0
        if size:
            out += summary([np.concatenate(c) for c in zip(*held)])
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], names=["side", "n", *KEY])
    return run


def _weighted_median(rows) -> tuple[int, ...]:
    rows = sorted((tuple(r[k] for k in KEY), r.n) for r in rows)
    total, run = sum(n for _, n in rows), 0
    for key, n in rows:
        run += n
        if 2 * run >= total:
            return key


def cutoff(keys: DataFrame, want: int, part: int = PART) -> tuple[int, ...]:
    """The want-th smallest key (from 1) of a stage table of distinct keys (low, id, row, all long).

    A round reads the keys once. One row for each side and part reaches the driver, at most one a million keys
    and task. A round discards a quarter of what is left at least, half as a rule; when less than an eighth of a
    table is left, the rest is written anew, so all rounds together read a few times the keys."""
    low = high = pivot = None
    held = left = None
    while True:
        seen = keys
        if low is not None:
            seen = seen.where(F.col("low") >= low[0])
        if high is not None:
            seen = seen.where(F.col("low") <= high[0])
        rows = seen.select(KEY).mapInArrow(_medians(low, high, pivot, part), "side long, n long, low long, id long, row long").collect()
        if pivot is None:
            left = held = sum(r.n for r in rows)
            pivot = _weighted_median(rows)
            continue
        sides = [[r for r in rows if r.side == k] for k in (0, 1)]
        before = sum(r.n for r in sides[0])
        if want == before + 1:
            return pivot
        if want <= before:
            high, left, pivot = pivot, before, _weighted_median(sides[0])
        else:
            want, low, left, pivot = want - before - 1, pivot, left - before - 1, _weighted_median(sides[1])
        if 8 * left < held:
            seen = keys.where(F.col("low").between(low[0] if low else -(1 << 63), high[0] if high else (1 << 63) - 1)).select(KEY)
            files = max(left // part, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
            keys, held = stage(seen.coalesce(files), "keys"), left


def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with rank 1, 2, 3 ... by distinct keys: sorted by range, numbered in each range, after all before it."""
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("seat", F.monotonically_increasing_id())
    placed = stage(placed, "sorted").withColumns({"range": F.shiftright("seat", 33), "seat": F.col("seat").bitwiseAND((1 << 33) - 1)})
    sizes = sorted((r.range, r.n) for r in placed.groupBy("range").agg(F.count("*").alias("n")).collect())  # one row a range
    first, start = [], 1
    for k, n in sizes:
        first.append((k, start))
        start += n
    starts = rows.sparkSession.createDataFrame(first, "range long, first long")
    return placed.join(F.broadcast(starts), "range").withColumn("rank", F.col("first") + F.col("seat")).drop("range", "seat", "first")


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED,
             part: int = PART) -> DataFrame:
    """docs (doc_id, text, more), one row per row: doc_id, n_features, weight, score, rank (null if not drawn).

    target (text, more) shows the distribution wanted. Words are runs of letters a-z (A-Z lower-cased), digits and
    characters beyond ASCII; features are runs of 1 to `longest` of them, repeats counted. A document's score is its
    weight plus the noise of its doc_id, in thousandths. Of the N rows with `least` words or more, floor(N percent
    / 100) with the highest scores are drawn, ties to the smaller doc_id. A null or empty text has no feature and
    weight 0; a null doc_id has the noise of an empty id and loses ties; rows that repeat a doc_id are drawn each,
    those of equal scores in any but a fixed order. Whole texts are read; other columns are ignored."""
    found = stage(hashed(docs, longest, buckets), "buckets")
    wanted = hashed(target.select(F.lit(0).alias("doc_id"), "text"), longest, buckets)
    gains = bucket_gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets))
    weighed = found.mapInArrow(_weighed(gains, _kind(buckets)), "doc_id long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    noise = F.floor(-1000.0 * F.log(-F.log((F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0)))
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumns({
        "low": -F.col("score"), "id": F.coalesce("doc_id", F.lit((1 << 63) - 1)), "row": F.monotonically_increasing_id()})
    scored = stage(scored, "scores")
    able = scored.where(F.col("n_words") >= least)
    want = able.count() * percent // 100
    out = [F.col(c) for c in ("doc_id", "n_features", "weight", "score")]
    if not want:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    low, at, row = cutoff(able.select(KEY), want, part)
    won = (F.col("n_words") >= least) & ((F.col("low") < low) | ((F.col("low") == low) & ((F.col("id") < at) | ((F.col("id") == at) & (F.col("row") <= row)))))
    winners = ranked(scored.where(won), KEY)
    return winners.select(*out, "rank").unionByName(scored.where(~won).select(*out, F.lit(None).cast("long").alias("rank")))


def sql(longest: int = LONGEST) -> str:
    from ledgerlens.llm.quality import SQL_CRC, sql_crc
    split = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    if longest != 1:
        raise ValueError("the SQL is written for single words")
    return f"""
WITH {SQL_CRC},
l AS (SELECT doc_id, {split} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w FROM l),
q AS (SELECT unnest({split}) AS w FROM benchmark),
crc AS ({sql_crc('(SELECT w FROM w UNION ALL SELECT w FROM q)')}),
g AS (SELECT doc_id, c % {BUCKETS} AS b FROM w JOIN crc USING (w)),
s AS (SELECT b, count(*) AS s FROM g GROUP BY b),
t AS (SELECT c % {BUCKETS} AS b, count(*) AS t FROM q JOIN crc USING (w) GROUP BY ALL),
z AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS s_all, (SELECT coalesce(sum(t), 0) FROM t) AS t_all),
f AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (t_all + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (b), z),
x AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM g JOIN f USING (b) GROUP BY doc_id),
h AS (SELECT doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight, ('0x' || sha256('{SEED}:' || doc_id)[1:8])::BIGINT AS h FROM l LEFT JOIN x USING (doc_id)),
o AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM h),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, {PERCENT} * count(*) OVER () // 100 AS k FROM o WHERE n_features >= {LEAST})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= k THEN rank END AS rank FROM o LEFT JOIN r USING (doc_id)
"""


SQL = sql()
