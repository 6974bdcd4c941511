"""Best match of every current unit among the previous units of its pair.

Pairs of units never become rows. Both sides are packed into blocks of bounded size, every
(current block, previous block) cell of a pair is one row, and a vectorised UDF reduces the
cell to the best score per current unit; `max` over cells finishes. A document of any size
is therefore spread over many cells, and no task holds more than two blocks at a time.
"""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ledgerlens.functions import scoring as S
from ledgerlens.operators import ordered as O
from ledgerlens.session import in_batches

VECTOR_BLOCK = 512
TEXT_BLOCK = 128
GAP = "\x1f"  # between the tokens of a unit that is shuffled as one string


def _blocks(df, keys, idx, value, block):
    return (df.select(*keys, idx, value, F.floor(F.col(idx) / block).alias("__block"))
            .groupBy(*keys, "__block")
            .agg(F.collect_list(idx).alias("__idx"), F.collect_list(value).alias("__val")))


def _unit_rows(vectors):
    m = np.stack([np.asarray(v, dtype="float64") for v in vectors])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    zero = n[:, 0] == 0.0
    n[n == 0.0] = 1.0
    return m / n, zero


@pandas_udf(ArrayType(DoubleType()))
def _best_cosine(cur: pd.Series, prev: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(cur, prev):
        ua, za = _unit_rows(a)
        best = (ua @ _unit_rows(b)[0].T).max(axis=1)
        best[za] = 0.0
        out.append(best)
    return pd.Series(out)


@pandas_udf(ArrayType(DoubleType()))
def _best_tfidf(cur: pd.Series, prev: pd.Series) -> pd.Series:
    """Cosine of two-document tf-idf vectors: shared terms weigh 1, others ln(1.5) + 1, so the
    squared norm of a unit is c2*|tf|^2 - (c2 - 1)*|tf over shared terms|^2."""
    c2 = (np.log(1.5) + 1.0) ** 2
    out = []
    for a, b in zip(cur, prev):
        a, b = ([u.split(GAP) if u else [] for u in side] for side in (a, b))
        vocab = {}
        for toks in a + b:
            for t in toks:
                vocab.setdefault(t, len(vocab))

        def tf(units):
            m = np.zeros((len(units), max(len(vocab), 1)))
            for i, toks in enumerate(units):
                if len(toks):
                    ids, n = np.unique([vocab[t] for t in toks], return_counts=True)
                    m[i, ids] = n / len(toks)
            return m
        ma, mb = tf(a), tf(b)
        sa, sb = ma ** 2, mb ** 2
        shared_a, shared_b = sa @ (mb > 0).T, (ma > 0) @ sb.T
        na = c2 * sa.sum(axis=1)[:, None] - (c2 - 1) * shared_a
        nb = c2 * sb.sum(axis=1)[None, :] - (c2 - 1) * shared_b
        with np.errstate(divide="ignore", invalid="ignore"):
            sim = np.where((na > 0) & (nb > 0), (ma @ mb.T) / np.sqrt(np.clip(na * nb, 1e-300, None)), 0.0)
        out.append(np.clip(sim, 0.0, 1.0).max(axis=1))
    return pd.Series(out)


def _best_match(pairs, units, cur, prev, unit_keys, idx, value, block, score) -> DataFrame:
    b = _blocks(units, unit_keys, idx, value, block)
    left = b.select(*[F.col(k).alias(c) for k, c in zip(unit_keys, cur)],
                    F.col("__idx").alias(idx), F.col("__val").alias("__a"))
    right = b.select(*[F.col(k).alias(c) for k, c in zip(unit_keys, prev)], F.col("__val").alias("__b"))
    cells = pairs.select(*cur, *[c for c in prev if c not in cur]).join(left, list(cur)).join(right, list(prev))
    keys = list(dict.fromkeys([*cur, *prev]))
    return (in_batches(cells).select(*keys, idx, score("__a", "__b").alias("__s"))
            .select(*keys, F.explode(F.arrays_zip(idx, "__s")).alias("x"))
            .groupBy(*keys, F.col(f"x.{idx}").alias(idx)).agg(F.max("x.__s").alias("best")))


def best_cosine(pairs, vectors, cur, prev, unit_keys, idx="chunk_idx", value="embedding",
                block=VECTOR_BLOCK) -> DataFrame:
    """pairs: one row per (current keys, previous keys). Zero vectors score 0.
    Returns the pair keys, `idx` of the current unit and `best` in [-1, 1]."""
    return _best_match(pairs, vectors, cur, prev, unit_keys, idx, value, block, _best_cosine)


def best_tfidf(pairs, units, cur, prev, unit_keys, idx="unit_idx", value="tokens", block=TEXT_BLOCK) -> DataFrame:
    """Units that lie by their keys already are shuffled once, with the pairs, a string each."""
    units = units.withColumn(value, F.array_join(value, GAP))
    return _best_match(pairs, units, cur, prev, unit_keys, idx, value, block, _best_tfidf)


def top_k_mean(scored: DataFrame, keys, score, idx, evidence=5, hot_rows=O.AUTO) -> DataFrame:
    """Mean of the K largest per group, K = min(n, max(3, ceil(n/4))), plus n, the mean of all
    and the first `evidence` indexes (ties by index). Scores lie in [0, 1].

    The rank is a running count in segments, so a hot group is spread over tasks.
    """
    by_score = O.Order(-F.floor(F.col(score) * 1e15).cast("bigint"), F.col(idx).cast("bigint"))
    if hot_rows is None:  # groups are small: counted where they are ranked, so that the scores are made once
        r = O.running(scored.select(*keys, score, idx), keys, by_score, {"__before": F.lit(1)}, hot_rows=None)
        r = r.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    else:
        sizes = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        r = O.running(scored.select(*keys, score, idx), keys, by_score, {"__before": F.lit(1)}, hot_rows=hot_rows).join(sizes, list(keys))
    r = r.withColumn("__k", S.top_k_count(F.col("__n")))
    first = F.when(F.col("__before") < evidence, F.struct("__before", idx))
    return r.groupBy(*keys).agg(
        F.avg(F.when(F.col("__before") < F.col("__k"), F.col(score))).alias("top_k_mean"),
        F.max("__k").alias("top_k_count"), F.max("__n").alias("unit_count"), F.avg(score).alias("global_mean"),
        F.transform(F.array_sort(F.collect_list(first)), lambda x: x[idx]).alias("top_units"))


_TERM_SUMS = ["dot", "sa", "sb", "qa", "qb"]


@pandas_udf(StructType([StructField(c, DoubleType()) for c in _TERM_SUMS]))
def _shared_terms(ta: pd.Series, na: pd.Series, tb: pd.Series, nb: pd.Series) -> pd.DataFrame:
    """Products and squares of the frequencies of two texts over their shared terms, squares over all of each."""
    out = np.zeros((len(ta), 5))
    for i, (a, m, b, n) in enumerate(zip(ta, na, tb, nb)):
        fa, fb = m / m.sum(), n / n.sum()
        at = {t: j for j, t in enumerate(b)}
        both = [j for j, t in enumerate(a) if t in at]
        x, y = fa[both], fb[[at[a[j]] for j in both]]
        out[i] = x @ y, x @ x, y @ y, fa @ fa, fb @ fb
    return pd.DataFrame(out, columns=_TERM_SUMS)


def tfidf_similarity(pairs, counts, cur, prev, key, keep=()) -> DataFrame:
    """Whole-text similarity of each pair from term counts (key, token, term_count).

    A document is one text, so its terms are one row of two arrays. Counts that lie by their key are
    shuffled once, with the pairs; shared terms are looked up inside the row, and the unshared part
    follows from totals. A pair given n times counts its shared terms n times.
    """
    c2 = (F.log(F.lit(1.5)) + 1.0) * (F.log(F.lit(1.5)) + 1.0)
    docs = counts.groupBy(key).agg(F.collect_list("token").alias("__t"), F.collect_list("term_count").alias("__n"))
    p = pairs.select(cur, prev)
    a = docs.select(F.col(key).alias(cur), F.col("__t").alias("__ta"), F.col("__n").alias("__na"))
    b = docs.select(F.col(key).alias(prev), F.col("__t").alias("__tb"), F.col("__n").alias("__nb"))
    met = in_batches(p.groupBy(cur, prev).agg(F.count(F.lit(1)).alias("__times")).join(a, cur).join(b, prev))
    shared = met.select(cur, prev, "__times", _shared_terms("__ta", "__na", "__tb", "__nb").alias("s"))
    j = p.join(shared, [cur, prev], "left")  # a text without terms meets nothing: 0
    na = c2 * F.col("s.qa") - (c2 - 1.0) * F.col("__times") * F.col("s.sa")
    nb = c2 * F.col("s.qb") - (c2 - 1.0) * F.col("__times") * F.col("s.sb")
    sim = F.coalesce(S.clip01(F.try_divide(F.col("__times") * F.col("s.dot"), F.sqrt(na * nb))), F.lit(0.0))
    return j.select(cur, prev, sim.alias("similarity"))
