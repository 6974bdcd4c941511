"""Runs of words that repeat across documents, wherever they stand in their lines.

A text is sampled at content-defined places: word positions whose hash is least among `reach` neighbouring
ones. The `unit` words from such a place on are a unit. With unit + reach - 1 = least, every run of `least`
words holds a whole unit, and holds the same one in every text. Units that several documents have meet one
representative each, and units in a row on one diagonal make a run. Where that leaves open what repeats (at
the ends of runs, and in runs that are too short), all windows of `least` words around the unit are compared.
So a run is found if and only if `least` words of it stand in another document.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm import codes
from ledgerlens.llm.tables import stage

#: Words of the shingle whose hash makes a place the least one.
SHINGLE = 5
#: Whole numbers in arrays that may be sent to every executor (some 30 MB).
BROADCAST_PLACES = 8_000_000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding(op, x: np.ndarray, size: int, fill) -> np.ndarray:
    """op (minimum or maximum) over every `size` neighbours of x."""
    n = len(x) - size + 1
    if n <= 0:
        return x[:0]
    blocks = np.append(x, np.full(-len(x) % size, fill, dtype=x.dtype)).reshape(-1, size)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[size - 1:size - 1 + n])


def places(hashes: np.ndarray, first: np.ndarray, unit: int, reach: int) -> np.ndarray:
    """The content-defined places of texts whose words' hashes stand in a row, text k's from first[k] on."""
    n = len(hashes)
    if n < unit:
        return np.zeros(0, dtype=np.int64)
    wide = min(SHINGLE, unit)
    value = np.full(n, _NONE)
    mixed = np.zeros(n - wide + 1, dtype=np.uint64)
    for k in range(wide):
        mixed += hashes[k:n - wide + 1 + k] * codes.ROTORS[k]
    value[:n - wide + 1] = np.minimum(codes.mix(mixed), _NONE - np.uint64(1))
    # the last unit - 1 places of a text hold no unit; no window of `reach` places spans them
    count = np.diff(first)
    last = np.minimum(count, unit - 1)
    value[np.repeat(first[1:] - np.cumsum(last), last) + np.arange(int(last.sum()))] = _NONE
    edge = np.full(reach - 1, _NONE)
    least = sliding(np.minimum, np.concatenate([edge, value, edge]), reach, _NONE)
    at = np.flatnonzero((sliding(np.maximum, least, reach, np.uint64(0)) == value) & (value != _NONE))
    if not len(at):
        return at
    # one word over and over makes every place least: there each reach-th place and the last one will do
    opens = np.append(True, (np.diff(at) != 1) | (value[at[1:]] != value[at[:-1]]))
    return at[((at - np.maximum.accumulate(np.where(opens, at, 0))) % reach == 0) | np.append(opens[1:], True)]


def window_hashes(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the `size` words from each place on."""
    out = np.zeros(len(at), dtype=np.int64)
    turn = codes.mix(np.arange(1, size + 1, dtype=np.uint64) * codes.GOLD) | np.uint64(1)
    mixed = codes.mix(hashes)
    for k in range(0, len(at), 1 << 14):
        part = mixed[at[k:k + (1 << 14), None] + np.arange(size)]
        out[k:k + (1 << 14)] = codes.mix((part * turn).sum(axis=1, dtype=np.uint64)).view(np.int64)
    return out


UNITS = "doc_id long, tkey long, n int, first int, last int, at int, id long, start int, end int"


def _units(unit, reach):
    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            starts, ends, hashes, first, begin = codes.words(texts)
            at = places(hashes, first, unit, reach)
            k = np.searchsorted(first, at, side="right") - 1
            ints = [np.diff(first)[k], starts[first[k]] - begin[k], ends[first[k + 1] - 1] - begin[k], at - first[k]]
            more = [starts[at] - begin[k], ends[at + unit - 1] - begin[k]]
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c).take(pa.array(k)) for c in (0, 1)), *(pa.array(x.astype(np.int32)) for x in ints),
                pa.array(window_hashes(hashes, at, unit)), *(pa.array(x.astype(np.int32)) for x in more)], names=[c.split()[0] for c in UNITS.split(", ")])
    return run


WINDOWS = "doc_id long, tkey long, hi long, at int, h long, start int, end int"


def _windows(unit, least):
    def run(batches):
        for batch in batches:
            texts = batch.column(3).to_pylist()
            starts, ends, hashes, first, begin = codes.words(texts)
            found = []
            for k, asked in enumerate(batch.column(4).to_pylist()):
                p = np.array(asked, dtype=np.int64)
                s = np.unique((p[:, None] - np.arange(least - unit + 1)).ravel())
                found.append(s[(s >= 0) & (s <= first[k + 1] - first[k] - least)] + first[k])
            at = np.concatenate(found) if found else np.zeros(0, np.int64)
            k = np.repeat(np.arange(len(found)), [len(s) for s in found])
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c).take(pa.array(k)) for c in (0, 1, 2)), pa.array((at - first[k]).astype(np.int32)), pa.array(window_hashes(hashes, at, least)),
                pa.array((starts[at] - begin[k]).astype(np.int32)), pa.array((ends[at + least - 1] - begin[k]).astype(np.int32))],
                names=[c.split()[0] for c in WINDOWS.split(", ")])
    return run


def _merged(intervals: DataFrame) -> DataFrame:
    """Unions (doc_id, start, end, n_words, removed) of overlapping or touching intervals of a text's words."""
    by = W.partitionBy("tkey", "removed")
    order = by.orderBy("a0", "a1")
    before = F.max("a1").over(order.rowsBetween(W.unboundedPreceding, -1))
    cut = intervals.distinct().withColumn("opens", F.coalesce((F.col("a0") > before).cast("int"), F.lit(1)))
    parts = cut.withColumn("island", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return parts.groupBy("tkey", "removed", "island").agg(
        F.min("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), (F.max("a1") - F.min("a0")).alias("n_words")).drop("island")


def repeated_runs(source: DataFrame, least: int) -> DataFrame:
    """source (doc_id, text, neither null): the runs of `least` words and more that stand in two documents or more,
    as doc_id, start, end (code points), n_words, removed.

    Words lie between white space, A-Z as a-z, across lines. Of equal runs the first by doc_id stays
    (removed is False), the others go; a document's removed and staying runs are rows of their own. Equal texts
    are compared once. Texts and words are told apart by 64-bit hashes."""
    unit = least // 2 + 1
    reach = least - unit + 1
    keyed = source.select("doc_id", F.xxhash64("text").alias("tkey"), "text")
    found = stage(keyed.mapInArrow(_units(unit, reach), UNITS), "run-found")
    spread = found.groupBy("id").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    ids = stage(spread.where("least < most").select("id"), "run-ids")
    shared = stage(found.join(ids, "id"), "run-units")
    texts = stage(shared.groupBy("tkey").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), *(F.max(c).alias(c) for c in ("n", "first", "last"))), "run-texts")

    units = shared.select("tkey", "at", "id", "start", "end").distinct()
    lead = stage(shared.groupBy("id").agg(F.min(F.struct("doc_id", "tkey", "at", "start", "end")).alias("r")).select(
        "id", F.col("r.doc_id").alias("rd"), F.col("r.tkey").alias("rt"), F.col("r.at").alias("rp"), F.col("r.start").alias("rs"), F.col("r.end").alias("re")), "run-leads")
    units = stage(units, "run-places")
    met = units.join(lead, "id").where("tkey != rt or at != rp")
    line = W.partitionBy("tkey", "rt", "line").orderBy("at")
    gap = F.coalesce((F.col("at") - F.lag("at").over(line) > unit).cast("int"), F.lit(1))
    in_runs = met.withColumn("line", F.col("at") - F.col("rp")).withColumn("gap", gap).withColumn("run", F.sum("gap").over(line))
    run = W.partitionBy("tkey", "rt", "line", "run")
    in_runs = stage(in_runs.withColumns({"a0": F.min("at").over(run), "a1": F.max("at").over(run) + unit}), "run-rows")

    full = F.col("a1") - F.col("a0") >= least
    apart = F.col("tkey") != F.col("rt")
    runs = in_runs.where(full & apart).groupBy("tkey", "rd", "rt", "line", "run", "a0", "a1").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("rp").alias("r0"), F.min("rs").alias("rs"), F.max("re").alias("re"))
    known = texts.select("tkey", "lo", "hi")
    # a document with two texts has no second document by that alone
    runs = stage(runs.join(known, "tkey").join(known.toDF("rt", "rlo", "rhi"), "rt").where("least(lo, rlo) < greatest(hi, rhi)"), "run-pairs")
    theirs = runs.select("tkey", F.col("lo").alias("doc_id"), "a0", "a1", "start", "end", F.lit(True).alias("removed"))
    leads = runs.select(F.col("rt").alias("tkey"), F.col("rlo").alias("doc_id"), F.col("r0").alias("a0"), (F.col("r0") + F.col("a1") - F.col("a0")).alias("a1"),
                        F.col("rs").alias("start"), F.col("re").alias("end"), F.lit(False).alias("removed"))

    open_ids = in_runs.where(~(full & apart) | (F.col("at") == F.col("a0")) | (F.col("at") + unit == F.col("a1"))).select("id").distinct()
    asked = units.join(stage(open_ids, "run-open"), "id").groupBy("tkey").agg(F.collect_set("at").alias("asked"))
    asked = stage(asked.join(texts.where(F.col("n") >= least), "tkey").select("tkey", F.col("lo").alias("doc_id"), "hi", "asked"), "run-asked")
    size = asked.agg(F.coalesce(F.sum(F.size("asked") + 8), F.lit(0))).first()[0]
    wanted = F.broadcast(asked) if size <= BROADCAST_PLACES else asked
    windows = stage(keyed.join(wanted, ["tkey", "doc_id"]).select("doc_id", "tkey", "hi", "text", "asked")
                    .mapInArrow(_windows(unit, least), WINDOWS), "run-windows")
    same = windows.groupBy("h").agg(F.min(F.struct("doc_id", "tkey", "at")).alias("lead"), F.max("hi").alias("most")).where("lead.doc_id < most").select("h", "lead")
    twice = windows.join(same, "h")
    parts = twice.select("tkey", "doc_id", F.col("at").alias("a0"), (F.col("at") + least).alias("a1"), "start", "end",
                         (F.struct("doc_id", "tkey", "at") != F.col("lead")).alias("removed"))

    merged = _merged(theirs.unionByName(leads).unionByName(parts)).select("doc_id", "start", "end", "n_words", "removed")
    copies = shared.select("tkey", "doc_id").distinct().join(texts.where((F.col("lo") < F.col("hi")) & (F.col("n") >= least)), "tkey")
    whole = copies.select("doc_id", F.col("first").alias("start"), F.col("last").alias("end"), F.col("n").alias("n_words"), (F.col("doc_id") != F.col("lo")).alias("removed"))
    return merged.unionByName(whole)
