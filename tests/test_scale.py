"""What plans do as tables grow: joins that may not be broadcast, rows that joins and shuffles carry."""
import re
from datetime import date, datetime

from pyspark.sql import functions as F

from ledgerlens.plans import queries as R

FILING = "filing_id long, company_id long, form_type string, filed_at date, accession_number string, period_of_report date"
SIGNAL = "filing_id long, company_id long, signal_name string, signal_value double, detail string, computed_at timestamp"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_signal_row_never_broadcasts_filings(spark):
    f = spark.createDataFrame([(1, 7, "10-K", date(2024, 1, 2), "A1", None), (2, 7, "10-Q", date(2024, 4, 2), "A2", None)], FILING)
    at = datetime(2024, 5, 1)
    s = spark.createDataFrame([(1, 7, None, 0.8, '{"label": "watch"}', at), (2, 7, "b", 0.8, "[1]", at), (2, 7, "c", None, None, at),
                               (3, 7, "d", 0.1, "{}", at), (None, 7, "e", 0.1, "{}", at)], SIGNAL)
    d = R.signal_row(s, f)
    assert "BroadcastHashJoin" not in plan_of(d) and "Sort " not in plan_of(d)
    assert d.columns == [*s.columns, "form_type", "filed_at", "accession_number", "period_of_report", "status"]
    assert sorted((r.filing_id, r.signal_name, r.status, r.detail, r.form_type) for r in d.collect()) == [
        (1, "unknown", "watch", '{"label": "watch"}', "10-K"), (2, "b", "critical", '{"items":[1]}', "10-Q"), (2, "c", "unknown", "{}", "10-Q")]
    assert R.signals(s, f, form_type="10-k").count() == 1


def tables(spark, tmp_path, n=12):
    """orders, lineitem and customer of the driver's columns, with a repeated order and a null key."""
    k = F.col("id")
    day = F.timestamp_seconds(F.lit(800_000_000) + k * 9_000_000)
    o = spark.range(n).select(k.alias("o_orderkey"), (k % 5).alias("o_custkey"), F.element_at(F.array(*map(F.lit, "FOP")), (k % 3 + 1).cast("int")).alias("o_orderstatus"),
                              (k * 1000.5 + 900).alias("o_totalprice"), day.alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"))
    o = o.unionByName(o.where("o_orderkey = 3")).unionByName(o.where("o_orderkey = 4").withColumn("o_orderkey", F.lit(None).cast("long")))
    o.write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(5).select(k.alias("c_custkey"), F.concat(F.lit("Customer#00000000"), k).alias("c_name"), F.lit("BUILDING").alias("c_mktsegment"),
                          F.lit(1.0).alias("c_acctbal")).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(4 * n).select((k % n).alias("l_orderkey"), (k % 7).cast("int").alias("l_linenumber"), F.lit(8.0).alias("l_quantity"), (k * 10.25).alias("l_extendedprice"),
                              F.lit(0.1).alias("l_discount"), F.lit(0.02).alias("l_tax"), F.element_at(F.array(F.lit("N"), F.lit("R")), (k % 2 + 1).cast("int")).alias("l_returnflag"),
                              F.lit("O").alias("l_linestatus"), day.alias("l_shipdate")).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_yearly_points_are_not_shuffled_one_row_a_signal(spark, tmp_path):
    from checks import scores
    d = tables(spark, tmp_path)
    y = scores.Q_["yearly_signals"](spark, d)
    above = re.split(r"Generate explode", plan_of(y))[0]
    assert "Exchange" not in above
    assert y.agg(F.sum("point_count")).first()[0] == 11 * 15  # order 3 twice: each copy meets both of its filings
    flags = scores.Q_["yearly_flags"](spark, d)
    assert re.split(r"Generate explode", plan_of(flags))[0].count("Exchange") == 1 and flags.count() == 55


def test_facts_payloads_are_built_in_one_shuffle(spark, tmp_path):
    from checks import records
    f = records.Q_["src_facts_json"](spark, tables(spark, tmp_path))
    assert len(re.findall(r"Exchange hashpartitioning\(l_orderkey", plan_of(f))) == 1
    assert f.count() == f.distinct().count() > 0


def test_spread_bounds_the_rows_of_a_task(spark, tmp_path):
    from ledgerlens.session import spread
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "x"))
    x = spark.read.parquet(str(tmp_path / "x"))
    assert spread(x, "id").rdd.getNumPartitions() == 4
    assert spread(x, "id", rows=50).rdd.getNumPartitions() == 20 and spread(x, "id", rows=50).count() == 1000
    assert spread(spark.range(0, 1000, 1, 30), "id", rows=50).rdd.getNumPartitions() == 30


def test_containing_meets_names_by_long_grams_without_broadcast(spark):
    names = ["Alpha Holdings Group", "alpha holding", "Beta-Holdings Group plc", "AB", "", None, "x%y_z holdings group", "Omega 0000001234 Ltd", "Omega 0000001235 Ltd"]
    c = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "company_id long, name string")
    asked = ["holdings group", "a", "ab", "HOLDING", "0000001234", "000000123", "h%group", "_lpha", "zz0000001234", "group plc", "%", "Beta-Holdings Group plc"]
    got = R.containing(spark.createDataFrame([(a, a) for a in asked], "given string, ident string"), c)

    def like(name, a):
        pattern = "".join({"%": ".*", "_": "."}.get(ch, re.escape(ch)) for ch in a.lower())
        return re.search(pattern, name.lower(), re.S)
    want = {(a, i) for a in asked if a.strip("%_") for i, n in enumerate(names) if n is not None and like(n, a)}
    assert {(r.given, r.company_id) for r in got.collect()} == want and got.count() == len(want)
    assert not {"gram"} & set(got.columns)
    joins = [line for line in plan_of(got).splitlines() if "Join" in line]
    assert joins and not any("Broadcast" in line for line in joins)


def test_tfidf_drift_scores_and_counts_once(spark):
    from ledgerlens.plans import text_signals as TS
    line = "The {} of the company may change when the {} of the market changes a lot this year. "
    texts = spark.createDataFrame([(1, "".join(line.format(w, w) for w in ("price", "risk", "cost"))), (2, "".join(line.format(w, w) for w in ("price", "debt", "cost"))),
                                   (3, "short text"), (4, "entirely different")], "filing_id long, text string")
    pairs = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (1, 1)], "filing_id long, previous_filing_id long")
    d = TS.tfidf_drift(pairs, texts)
    plan = plan_of(d)
    assert len(re.findall(r"ArrowEvalPython \[_best_tfidf", plan)) == 1
    got = {r.filing_id: r for r in d.collect()}
    assert got[2].tfidf_unit_count == 3 and got[2].tfidf_top_k_count == 3 and 0 < got[2].tfidf_drift < 1
    assert got[1].global_drift < 1e-9 and got[4].global_drift == 1.0 and got[4].tfidf_aggregation == "global_fallback"


def test_links_join_trades_before_they_meet_filings(spark, tmp_path):
    from checks import scores
    d, was = tables(spark, tmp_path, 40), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(scores.Q_["insider_activity"](spark, d))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    above, join = re.match(r"(.*?)SortMergeJoin (\[.*?\])", plan, re.S).groups()
    assert "filed_at" in join and "transaction_date" not in join  # the last join of the pairs is the one they are grouped by
    assert "Exchange" not in above


def test_pairs_of_trades_and_anchors_are_joined_once_and_never_shuffled(spark):
    from datetime import timedelta
    from random import Random
    from ledgerlens.plans import behavior_signals as B
    r, day0 = Random(5), date(2020, 1, 1)
    rows = [(i, r.choice([1, 1, 2]), f"A{i}", r.choice(["Ann", "ann ", "Bob", None]), None, r.choice(["CEO", "SVP"]), True, day0 + timedelta(r.randrange(500)) if i % 19 else None,
             r.choice("SSPPA"), r.choice([None, 900.0, 1000.0, 1500.0, 2000.0, 2500.0]), 2.0, None, "direct", "D", False, day0) for i in range(160)]
    trades = spark.createDataFrame(rows, """transaction_id long, company_id long, accession_number string, insider_name string, insider_cik string, officer_title string, is_director boolean,
        transaction_date date, transaction_code string, shares double, price_per_share double, transaction_value double, ownership_nature string, acquired_disposed_code string,
        is_derivative boolean, filed_at date""")
    anchors = spark.createDataFrame([(c, day0 + timedelta(d)) for c in (1, 2, 3) for d in (0, 91, 200, 300, 301, 450, 700)], "company_id long, filed_at date")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = B.classified_trades(anchors, B.prepared_trades(trades).withColumnRenamed("filed_at", "trade_filed_at"))
        plan = plan_of(B.anchor_activity(B.insider_activity(p)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    above = plan[:plan.index("SortMergeJoin")]
    assert plan.count("SortMergeJoin") == 1 and "Exchange" not in above

    def median(sizes):  # a missing size ranks lowest
        s = sorted(sizes, key=lambda x: (x is not None, x))
        mid = s[(len(s) - 1) // 2:len(s) // 2 + 1]
        return None if not mid or None in mid else sum(mid) / len(mid)
    who = lambda t: "|" + t[3].strip().lower() if t[3] else ""
    want = {}
    for c, a in [tuple(x) for x in anchors.collect()]:
        for t in rows:
            if t[1] != c or t[7] is None or not -90 <= (t[7] - a).days <= 90:
                continue
            mine = [h for h in rows if h[1] == c and who(h) == who(t) and h[7]]
            open_ = t[8] in "SP" and (t[9] or 0) >= 1000 and t[5] == "CEO" or t[8] in "SP" and (t[9] or 0) >= 1000 and t[6]
            m = median([h[9] for h in mine if h[8] in "SP" and (a - h[7]).days > 90]) if open_ else None
            linked = any(h[8] == "A" and 0 <= (t[7] - h[7]).days <= 7 and (a - h[7]).days <= 90 for h in mine)
            big = m is not None and t[9] > m
            want[c, a, t[0]] = (m, "opportunistic_buy" if big and t[8] == "P" else "opportunistic_sell" if big and t[8] == "S" and not linked else "routine")
    got = {(x.company_id, x.filed_at, x.transaction_id): (x.median_shares, x.classification) for x in p.collect()}
    assert got == want and {v[1] for v in got.values()} == {"routine", "opportunistic_sell", "opportunistic_buy"}
    act = B.anchor_activity(B.insider_activity(p))
    assert act.columns[:2] == ["company_id", "filed_at"] and act.count() == len({k[:2] for k in want})


def test_terms_are_counted_where_their_text_lies_and_pairs_shuffle_documents(spark):
    import math
    from collections import Counter
    from ledgerlens.operators import aggregates as A, similarity as M
    texts = {1: "Risk of the market, risk of debt", 2: "the market of debt and the sale", 3: "", 4: None, 5: "nothing shared here", 6: "the the the"}
    df = spark.createDataFrame([*texts.items(), (6, "Market 12 x"), (None, "the market")], "filing_id long, text string")
    pairs = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (5, 2), (6, 2), (6, 1), (9, 1), (None, 1)], "filing_id long, previous_filing_id long")
    counts = A.term_counts(df, ["filing_id"], "text")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        s = M.tfidf_similarity(pairs, counts, "filing_id", "previous_filing_id", "filing_id")
        plan = plan_of(s)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert not [x for x in plan.splitlines() if "Exchange" in x and "token" in x]
    below = plan[plan.index("_shared_terms"):]  # the pairs by both keys and by one, their texts twice, the pairs with a text
    assert below.count("Exchange") <= 5
    texts[6] += " market"
    tf = {i: Counter(re.findall(r"[a-z][a-z0-9']+", (t or "").lower())) for i, t in texts.items()}
    assert {(r.filing_id, r.token): r.term_count for r in counts.collect()} == {**{(i, w): n for i, c in tf.items() for w, n in c.items()}, (None, "the"): 1, (None, "market"): 1}

    def want(a, b):
        a, b = tf.get(a, {}), tf.get(b, {})
        va, vb = ({t: n / sum(x.values()) * (math.log(3 / (1 + (t in a) + (t in b))) + 1) for t, n in x.items()} for x in (a, b))
        dot = sum(v * vb.get(t, 0) for t, v in va.items())
        return dot / math.sqrt(sum(v * v for v in va.values()) * sum(v * v for v in vb.values())) if dot else 0.0
    got = {(r.filing_id, r.previous_filing_id): r.similarity for r in s.collect()}
    assert len(got) == 8 and all(abs(v - want(*k)) < 1e-12 for k, v in got.items()) and got[2, 1] > 0.3


def test_units_are_shuffled_as_a_text_and_once_with_their_pairs(spark):
    from ledgerlens.operators import similarity as M
    from ledgerlens.plans import text_signals as TS
    line = "The {} of the company may change when the {} of the market changes a lot this year. "
    texts = spark.createDataFrame([(i, "".join(line.format(w, w) for w in ("price", "risk", f"cost{i % 3}"))) for i in range(7)], "filing_id long, text string")
    pairs = spark.createDataFrame([(i, i - 1) for i in range(1, 7)], "filing_id long, previous_filing_id long")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = TS.tfidf_drift(pairs, texts)
        plan = plan_of(d)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    cells = plan[plan.index("_best_tfidf"):].split("_shared_terms")[0]
    assert not [x for x in cells.splitlines() if "Exchange" in x and "__block" in x]
    assert {r.tfidf_unit_count for r in d.collect()} == {3}
    units = spark.createDataFrame([(1, 0, ["risk", "debt"]), (1, 1, []), (2, 0, []), (2, 1, ["risk"]), (2, 2, ["debt", "risk"])], "filing_id long, unit_idx long, tokens array<string>")
    best = M.best_tfidf(pairs.where("filing_id = 2"), units, ["filing_id"], ["previous_filing_id"], ["filing_id"])
    got = {r.unit_idx: r.best for r in best.collect()}
    assert got[0] == 0.0 and 0 < got[1] < 1 and abs(got[2] - 1) < 1e-12


def test_interval_pairs_by_bucket_are_the_same_and_spread_over_tasks(spark):
    from datetime import timedelta
    from ledgerlens.operators.intervals import interval_join
    day = lambda d: date(1969, 12, 1) + timedelta(d)
    a = spark.createDataFrame([(k, day(7 * i)) for k in (1, 2) for i in range(20)] + [(1, None), (None, day(3))], "k long, filed_at date")
    e = spark.createDataFrame([(i, 1 + i % 3, day(i)) for i in range(120)] + [(500, 1, None), (501, None, day(3))], "i long, k long, day date")
    for before, after in ((5, 9), (20, 0), (0, 0)):
        plain = interval_join(a, e, ["k"], "filed_at", "day", before, after)
        placed = interval_join(a, e, ["k"], "filed_at", "day", before, after, bucket="filed_at_bucket", tasks=7)
        assert placed.rdd.getNumPartitions() == 7 and "filed_at_bucket" in placed.columns
        rows = lambda df: sorted(tuple(x) for x in df.select("k", "filed_at", "i", "day").collect())
        assert rows(placed) == rows(plain) and len(rows(plain)) == len(set(rows(plain))) > 0
