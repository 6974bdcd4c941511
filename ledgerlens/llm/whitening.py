"""Whitening of embeddings over distinct vectors.

Equal vectors are grouped first and carry their multiplicity. One weighted centred matrix product gives
the covariance, its eigenvectors the components; every distinct vector is whitened once, and the result
is joined back to the rows. Entries are whole numbers and are centred on the whole number nearest to the
mean, so sums and products are exact in doubles up to 2^53, whatever the order; what is left of the mean,
half a unit at most, is taken off exactly.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.tables import in_batches, stage

#: An entry c becomes floor(SCALE * c) + SHIFT; so many components are returned at most.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Scaled entries are held within these bounds, so that they stay whole numbers in doubles.
FAR = float(1 << 52)
#: A vector with more than this part of all rows is joined by broadcast; there are fewer than that many.
HOT = 1_000
#: Components whose variance is not above this part of the first one's have no scale to be whitened by.
FLAT = 1e-12


def _numbered(scale, shift):
    """Rows of finite vectors as whole numbers, in 4 bytes each if all of a vector fit, else in 8."""
    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            size = np.array([-1 if n is None else n for n in pa.compute.list_value_length(lists).to_pylist()], dtype=np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
            bad = np.append(0, np.cumsum(~np.isfinite(values)))
            end = np.cumsum(np.maximum(size, 0))
            start = end - np.maximum(size, 0)
            keep = np.flatnonzero((size > 0) & (bad[end] == bad[start]))
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(np.where(np.isfinite(values), values, 0) * scale), -FAR, FAR).astype(np.int64) + shift
            rows = [whole[a:b] for a, b in zip(start[keep].tolist(), end[keep].tolist())]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(keep)), pa.array(size[keep].astype(np.int32)),
                pa.array([r.astype("<i4" if -(1 << 31) <= r.min() and r.max() < 1 << 31 else "<i8").tobytes() for r in rows], pa.binary())], names=["vec_id", "dim", "x"])
    return run


def matrix(column, dim: int) -> np.ndarray:
    """The vectors of a column of bytes as rows of 64-bit integers."""
    out = np.empty((len(column), dim), dtype=np.int64)
    for k, x in enumerate(column):
        raw = x.as_buffer()
        out[k] = np.frombuffer(raw, "<i4" if raw.size == 4 * dim else "<i8")
    return out


def _summed(dim, by_count):
    """Weighted sums of each dimension; dimension -1 is the sum of the weights."""
    def run(batches):
        total, n = [0] * dim, 0
        for batch in batches:
            x = matrix(batch.column(0), dim)
            w = batch.column(1).to_numpy() if by_count else np.ones(len(x), dtype=np.int64)
            safe = len(x) and int(np.abs(x).max()) * int(w.sum()) < 1 << 62
            part = (x * w[:, None]).sum(axis=0) if safe else (x.astype(object) * w[:, None].astype(object)).sum(axis=0) if len(x) else np.zeros(dim, np.int64)
            total = [a + int(b) for a, b in zip(total, part)]
            n += int(w.sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), pa.array([str(v) for v in [n, *total]], pa.string())], names=["j", "v"])
    return run


def _product(dim, centre, by_count):
    """The weighted product of the centred vectors with themselves, the upper half of it."""
    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            y = (matrix(batch.column(0), dim) - centre).astype(np.float64)
            total += (y * batch.column(1).to_numpy()[:, None] if by_count else y).T @ y
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"])
    return run


def _whitened(dim, centre, rest, n, fraction, axes):
    def run(batches):
        for batch in batches:
            z = matrix(batch.column(0), dim) - centre
            far = int(np.abs(z).max()) if len(z) else 0
            worst = n * far + max((abs(r) for r in rest), default=0)
            if worst * worst * dim < 1 << 63:
                deviation = ((z * n - np.array(rest, dtype=np.int64)) ** 2).sum(axis=1).tolist()
            else:
                exact = [sum((int(v) * n - r) ** 2 for v, r in zip(row, rest)) for row in z.tolist()]
                deviation = [v if v < 1 << 63 else None for v in exact]
            scores = (z.astype(np.float64) - fraction) @ axes
            ends = np.arange(len(z) + 1, dtype=np.int32) * scores.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(deviation, pa.int64()),
                                              pa.ListArray.from_arrays(pa.array(ends), pa.array(scores.ravel(), pa.float64()))], names=["x", "copies", "deviation", "whitened"])
    return run


def _spread(k, by_count):
    """Product of whitened vectors (already centred) with themselves, and with 1 in row -1."""
    def run(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            y = batch.column(0).flatten().to_numpy().reshape(-1, k)
            w = batch.column(1).to_numpy() if by_count else np.ones(len(y))
            total[0] += w @ y
            total[1:] += (y * w[:, None]).T @ y
        i, j = np.divmod(np.arange(total.size), k)
        yield pa.RecordBatch.from_arrays([pa.array((i - 1).astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "v"])
    return run


def _gathered(products: DataFrame) -> dict[tuple[int, int], float]:
    return {(r.i, r.j): r.v for r in products.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}  # a row an entry of the matrix


def axes_of(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit eigenvectors of a covariance over their standard deviations, by falling variance; the variances; their parts of the trace."""
    e, u = np.linalg.eigh((v + v.T) / 2)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    good = (e > FLAT * max(e[0], 0)) & (e > 0) if len(e) else np.zeros(0, bool)
    return u[:, good] / np.sqrt(e[good]), e[good], e[good] / np.trace(v) if good.any() else e[good]


def whiten(vectors: DataFrame, components: int = COMPONENTS, weights: str = "one", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vectors (vec_id, embedding array of numbers, more): vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds a null or non-finite entry are left out; so are those of another
    length than most (the longer of two equally common ones counts). An entry c becomes floor(scale * c) + shift,
    with scale * c held within 2^52. Equal vectors are one, with weight one or the number of its copies
    (weights "one" or "counts"); n is the sum of the weights. Each row gives a row per component, numbered from 1
    by falling eigenvalue; components without variance are left out, so equal vectors alone give no rows.
    deviation is the exact sum of (n x - S)^2, null if it is beyond 64 bits. Rows that repeat a vec_id, or have
    none, stay. Other columns are ignored; the dimension, not the number of rows, bounds what the driver holds."""
    if weights not in ("one", "counts"):
        raise ValueError("weights must be one or counts")
    by_count, out = weights == "counts", "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    source = in_batches(vectors, 1024).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    read = stage(source.mapInArrow(_numbered(scale, shift), "vec_id long, dim int, x binary"), "vectors")
    most = read.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if most is None:
        return spark.createDataFrame([], out)
    dim, n_rows = most.dim, most.n
    rows = read.where(F.col("dim") == dim).select("vec_id", "x")
    distinct = stage(rows.groupBy("x").agg(F.count("*").alias("copies")), "distinct")

    sums = distinct.mapInArrow(_summed(dim, by_count), "j int, v string").groupBy("j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    got = {r.j: int(r.v) for r in sums.collect()}  # a row a dimension
    n, total = got[-1], [got[j] for j in range(dim)]
    centre = np.array([(2 * s + n) // (2 * n) for s in total], dtype=np.int64)
    rest = [s - n * int(m) for s, m in zip(total, centre)]  # what the whole-numbered centre leaves of the sums
    fraction = np.array([r / n for r in rest])

    v = np.zeros((dim, dim))
    for (i, j), value in _gathered(distinct.mapInArrow(_product(dim, centre, by_count), "i int, j int, v double")).items():
        v[i, j] = v[j, i] = value / n
    axes, variances, explained = axes_of(v - np.outer(fraction, fraction), components)
    if not len(variances):
        return spark.createDataFrame([], out)

    done = stage(distinct.mapInArrow(_whitened(dim, centre, rest, n, fraction, axes), "x binary, copies long, deviation long, whitened array<double>"), "whitened")
    k = len(variances)
    spread = _gathered(done.select("whitened", "copies").mapInArrow(_spread(k, by_count), "i int, j int, v double"))
    mean = np.array([spread[-1, j] / n for j in range(k)])
    covariance = np.array([[spread[i, j] / n for j in range(k)] for i in range(k)]) - np.outer(mean, mean)
    error = float(np.abs(covariance - np.eye(k)).max())

    # copies of one vector are at most a thousandth of the rows where rows are shuffled by their vector
    hot = done.where(F.col("copies") * HOT > n_rows)
    rare = rows.join(F.broadcast(hot.select("x")), "x", "left_anti").join(done, "x")
    joined = rows.join(F.broadcast(hot), "x").unionByName(rare)
    parts = F.split(F.lit(",".join(map(repr, explained.tolist()))), ",").cast("array<double>")
    each = joined.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(parts, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
