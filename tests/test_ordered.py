"""Segmented runs must equal the plain window, whatever the skew."""
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import ordered as O

SCHEMA = "k long, id long, day date, v double"


def data(spark, seed, hot_day=False):
    r = random.Random(seed)
    rows = []
    for i in range(240):
        k = 1 if r.random() < 0.6 else r.randint(2, 6)  # one key with most rows
        off = 5 if hot_day and r.random() < 0.5 else r.randint(0, 40)
        rows.append((k, i, date(2024, 1, 1) + timedelta(days=off), None if r.random() < 0.2 else round(r.random(), 3)))
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("hot_day", [False, True])
def test_lag_trailing_running_equal_plain(spark, hot_day):
    df = data(spark, 3, hot_day)
    order = O.Order.by_day("day", "id")
    assert O.hot_limit(df, ["k"], 20) == 20 and O.hot_limit(df, ["k"], 1000) is None
    cols = {"a": ("v", 1), "b": ("id", 3)}
    assert rows(O.lagged(df, ["k"], order, cols, 20)) == rows(O.lagged(df, ["k"], order, cols, None))
    frame = lambda w: {"c": F.collect_list("id").over(w.rowsBetween(-6, 0))}
    assert rows(O.trailing(df, ["k"], order, 6, frame, 20)) == rows(O.trailing(df, ["k"], order, 6, frame, None))
    for inc in (False, True):
        f = lambda hot: O.running(df, ["k"], order, {"n": F.lit(1), "s": F.when(F.col("v").isNotNull(), F.col("id"))}, inc, hot)
        assert rows(f(20)) == rows(f(None))


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("hot_day", [False, True])
def test_asof_equals_brute_force(spark, strict, hot_day):
    left, right = data(spark, 5, hot_day), data(spark, 6, hot_day)
    ls, rs = left.collect(), right.collect()
    want = []
    for l in ls:
        c = [r for r in rs if r.k == l.k and (r.day < l.day or (not strict and r.day == l.day))]
        best = max(c, key=lambda r: (r.day, r.id), default=None)
        want.append((l.id, best.id if best else None))
    for hot in (None, 15, O.AUTO):
        got = O.asof(left, right, ["k"], "day", "day", "id", ["id", "v"], strict, hot)
        assert sorted((r["id"], r["asof"]["id"] if r["asof"] else None) for r in got.collect()) == sorted(want)


def test_hashed_ties_and_scaled_scores_do_not_overflow(spark):
    df = spark.range(30_000).select(F.lit(1).alias("k"), F.xxhash64("id").alias("tie"), (F.col("id") % 900 / 900).alias("s"), F.lit("2024-01-05").cast("date").alias("day"))
    order = O.Order.by_day("day", "tie")
    run = lambda hot: O.running(df, ["k"], order, {"n": F.lit(1)}, hot_rows=hot).agg(F.sum("n"), F.max("n"), F.count_distinct("n")).first()
    assert run(2000) == run(None)
    from ledgerlens.operators.similarity import top_k_mean
    top = lambda hot: [round(v, 9) for v in top_k_mean(df.withColumn("id", F.monotonically_increasing_id()), ["k"], "s", "id", hot_rows=hot).first()[1:4]]
    assert top(20_000) == top(None)


def test_segments_spread_a_hot_unit(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), "id", F.lit("2024-01-05").cast("date").alias("day"))
    s = O.segmented(df, ["k"], O.Order.by_day("day", "id"), 100)
    sizes = [r["count"] for r in s.groupBy(O.SEG).count().collect()]
    assert len(sizes) >= 9 and max(sizes) <= 120
