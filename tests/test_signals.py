"""Hand-derived expectations of the score model on small inputs."""
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlens import policies as P
from ledgerlens.operators import aggregates as A
from ledgerlens.plans import (behavior_signals as B, composite as C, market_signals as M, numeric_signals as Q,
                              sentiment_signals as E, text_signals as TS)

def at():
    return F.lit("2026-02-01").cast("timestamp")


FILING = "filing_id long, company_id long, accession_number string, form_type string, filed_at date, period_of_report date, fiscal_year int, fiscal_quarter int"


def values(rows):
    return {(r["filing_id"], r["signal_name"]): r["signal_value"] for r in rows.collect()}


# ---------------------------------------------------------------- numbers
YEARS = {2021: (820, 380, 180, 135, 1800, 330, 260, 1040, 195), 2022: (900, 430, 210, 160, 1900, 360, 280, 1100, 220),
         2023: (1000, 470, 240, 190, 2000, 380, 300, 1150, 250), 2024: (1200, 600, 320, 250, 2200, 450, 320, 1250, 310),
         2025: (1180, 540, 240, 170, 2350, 320, 500, 1050, 190)}
CONCEPTS = ("Revenues", "GrossProfit", "OperatingIncomeLoss", "NetIncomeLoss", "Assets", "CashAndCashEquivalentsAtCarryingValue",
            "LongTermDebt", "StockholdersEquity", "NetCashProvidedByUsedInOperatingActivities")


def numeric_inputs(spark):
    filings, facts, n = [], [], 0
    for i, (y, vals) in enumerate(YEARS.items(), 1):
        filings.append((i, 1, f"a{y}", "10-K", date(y + 1, 1, 31), date(y, 9, 30), y, None))
        for c, v in zip(CONCEPTS, vals):
            n += 1
            facts.append((n, i, c, "USD", float(v), date(y - 1, 10, 1), date(y, 9, 30)))
            facts.append((n + 1000, i, c, "EUR", float(v) * 9, date(y - 1, 10, 1), date(y, 9, 30)))  # other unit loses
    return (spark.createDataFrame(filings, FILING), spark.createDataFrame(
        facts, "fact_id long, filing_id long, concept string, unit string, value double, period_start date, period_end date"))


def test_numeric_layer(spark):
    f, x = numeric_inputs(spark)
    v = values(Q.numeric_signals(Q.numeric_features(Q.canonical_facts(f, x)), at()))
    assert v[5, "fundamental_deterioration"] == pytest.approx(0.2810381356)
    assert v[5, "revenue_growth_deceleration"] == pytest.approx(0.7222222222)
    assert v[5, "balance_sheet_stress"] == pytest.approx(0.2821923922)
    assert v[5, "earnings_quality"] == pytest.approx(0.0296920241)
    assert v[4, "numeric_anomaly"] is None and v[5, "numeric_anomaly"] is not None
    assert v[1, "revenue_growth_deceleration"] is None


def test_numeric_reason_without_facts(spark):
    f, x = numeric_inputs(spark)
    rows = Q.numeric_signals(Q.numeric_features(Q.canonical_facts(f, x.limit(0))), at())
    r = rows.select(F.get_json_object("detail", "$.availability_reason").alias("r"), F.get_json_object("detail", "$.confidence").alias("c")).distinct().collect()
    assert [(a.r, a.c) for a in r] == [("no_xbrl_facts", "0.0")]


def test_quarterly_history_prefers_the_same_quarter(spark):
    rows = [(i, 1, f"q{i}", "10-Q", date(2020, 2, 1) + timedelta(days=91 * i), None, None, i % 3 + 1) for i in range(9)]
    from ledgerlens.plans.history import with_history
    h = {r.filing_id: [x.filing_id for x in r.history] for r in with_history(spark.createDataFrame(rows, FILING), []).collect()}
    assert h[8] == [2, 5, 8] and h[1] == [0, 1]  # fewer than two of the quarter: simply the last ones


# ---------------------------------------------------------------- insiders
def test_behaviour_layer(spark):
    filing = spark.createDataFrame([(1, 1, "a", "10-K", date(2026, 1, 31), None, None, None)], FILING)

    def tx(i, name, title, director, day, code, shares, price):
        return (i, 1, f"acc{i}", name, None, title, director, day, code, float(shares), float(price), float(shares * price), "direct",
                "D" if code == "S" else "A", False, day)
    rows = [tx(1, "Ceo", "Chief Executive Officer", False, date(2025, 5, 1), "S", 100, 150), tx(2, "Cfo", "CFO", False, date(2025, 5, 2), "S", 120, 150),
            tx(3, "Dir", None, True, date(2025, 5, 5), "S", 90, 150), tx(4, "Ceo", "Chief Executive Officer", False, date(2026, 1, 10), "S", 1200, 200),
            tx(5, "Cfo", "CFO", False, date(2026, 1, 12), "S", 1100, 198), tx(6, "Dir", None, True, date(2026, 1, 14), "S", 1050, 197),
            tx(7, "Vp", "Vice President", False, date(2026, 1, 15), "P", 1500, 196)]
    cols = ("transaction_id long, company_id long, accession_number string, insider_name string, insider_cik string, officer_title string, is_director boolean, "
            "transaction_date date, transaction_code string, shares double, price_per_share double, transaction_value double, ownership_nature string, "
            "acquired_disposed_code string, is_derivative boolean, filed_at date")
    trades = spark.createDataFrame(rows + [rows[3][:1] + rows[3][1:]], cols)  # a repeated row counts once
    feats = B.behavior_features(filing, trades)
    r = feats.first()
    assert (r.historical_transaction_count, r.opportunistic_sell_count, r.opportunistic_buy_count, r.unique_sellers_in_window) == (3, 3, 0, 3)
    tone = spark.createDataFrame([(1, 1, "text_sentiment", 0.8, datetime(2026, 2, 1))], "filing_id long, company_id long, signal_name string, signal_value double, computed_at timestamp")
    v = values(B.behavior_signals(feats, tone, at()))
    assert v[1, "insider_concentration"] == 0.75 and v[1, "ita"] > 0.8 and v[1, "insider_signal"] > 0.75
    none = values(B.behavior_signals(B.behavior_features(filing, trades.limit(0)), tone, at()))
    assert set(none.values()) == {None}
    linked = trades.unionByName(spark.createDataFrame([tx(9, "Ceo", "Chief Executive Officer", False, date(2026, 1, 5), "M", 10, 1)], cols))
    assert B.behavior_features(filing, linked).first().opportunistic_sell_count == 2


# ---------------------------------------------------------------- market
def test_market_layer(spark):
    start, prices, pid = date(2025, 6, 25), [], 0
    for off in range(221):
        day = start + timedelta(days=off)
        if day.weekday() < 5:
            pid += 1
            prices.append((1, day, pid, 250 - 0.6 * off))
    for peer, p in ((2, 20.0), (3, 18.0), (4, 22.0)):
        pid += 1
        prices.append((peer, date(2026, 1, 30), pid, p))
    px = spark.createDataFrame(prices, "company_id long, trading_date date, price_id long, price double")
    filings = spark.createDataFrame([(i, i, f"a{i}", "10-K", date(2026, 1, 31), None, None, None) for i in (1, 2, 3, 4)], FILING)
    fin = filings.withColumn("net_income", F.lit(100.0)).withColumn("shares_outstanding", F.lit(10.0))
    comp = spark.createDataFrame([(i, "tech") for i in (1, 2, 3, 4)], "company_id long, sector string")
    feats = M.market_features(filings, px, comp, fin)
    v = values(M.market_signals(feats, at()))
    assert v[1, "price_momentum_risk"] > 0.5 and v[1, "market_fundamental_divergence"] > 0.4 and v[1, "market_signal"] > 0.4
    assert feats.where("filing_id = 1").first().sector_median_pe == pytest.approx(2.0)
    assert v[2, "volatility_spike"] is None  # a single price has no return


def test_median_excluding_self_equals_brute_force(spark):
    import random
    import statistics
    r = random.Random(4)
    rows = [(g, m, None if r.random() < 0.2 else float(r.randint(1, 9))) for g in "abcd" for m in range({"a": 1, "b": 2, "c": 9, "d": 16}[g])]
    df = spark.createDataFrame(rows, "g string, m int, v double")
    for x in [x for hot in (None, 3) for x in A.median_excluding_self(df, ["g"], "m", "v", hot_rows=hot).collect()]:
        others = [v for g, m, v in rows if g == x.g and m != x.m and v is not None]
        assert (x.peer_count, x.peer_median) == (len(others), statistics.median(others) if others else None)


# ---------------------------------------------------------------- news
def news_rows(spark, items):
    return spark.createDataFrame([(1, d, None, '{"sentiment_score": %s}' % s if s is not None else None) for d, s in items],
                                 "company_id long, published_at timestamp, sentiment_label string, raw_json string")


def test_sentiment_layer(spark):
    anchor = datetime(2026, 1, 31, 12)
    n = news_rows(spark, [(anchor - timedelta(days=d), s) for d, s in ((50, .2), (40, .1), (20, -.4), (6, -.7), (4, -.8), (2, -.6), (1, -.9))])
    f = spark.createDataFrame([(1, 1, "a", "10-K", date(2026, 1, 31), None, None, None)], FILING)
    v = values(E.sentiment_signals(f, n, at()))
    assert v[1, "news_sentiment_signal"] > 0.5 and v[1, "sentiment_signal"] > 0.35
    old = spark.createDataFrame([(2, 1, "b", "10-K", date(2025, 10, 9), None, None, None)], FILING)
    fb = values(E.sentiment_signals(old, news_rows(spark, [(datetime(2025, 9, 1), -.6), (datetime(2025, 8, 20), -.4)]), at()))
    w1, w2 = 2.718281828459045 ** (-38 / 15), 2.718281828459045 ** (-50 / 15)
    tone = (-.6 * w1 - .4 * w2) / (w1 + w2)
    assert fb[2, "news_sentiment_signal"] == pytest.approx(0.6 * (1 - tone) / 2)  # 90-day fallback, no deterioration
    r = E.sentiment_signals(old, n, at()).select(F.get_json_object("detail", "$.availability_reason")).distinct().collect()
    assert [x[0] for x in r] == ["no_news_in_anchor_window"]
    r = E.sentiment_signals(old, n.limit(0), at()).select(F.get_json_object("detail", "$.availability_reason")).distinct().collect()
    assert [x[0] for x in r] == ["missing_news_items"]


def test_window_edge_microsecond(spark):
    last = datetime(2025, 11, 2, 23, 59, 59, 999999)  # exactly 90 days before the end-of-day anchor
    f = spark.createDataFrame([(1, 1, "a", "10-K", date(2026, 1, 31), None, None, None)], FILING)
    assert E.news_features(f, news_rows(spark, [(last, .1), (last - timedelta(microseconds=1), .1)])).first().articles_90d == 1


# ---------------------------------------------------------------- text
def test_drift_on_vectors(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 0, [.99, .01]), (2, 1, [.01, .99])], "filing_id long, chunk_idx long, embedding array<double>")
    p = spark.createDataFrame([(2, 1)], "filing_id long, previous_filing_id long")
    assert TS.section_similarity(p, v).first().drift_score < 0.05
    w = spark.createDataFrame([(1, 0, [0.0, 1.0]), (1, 1, [0.0, 1.0]), (2, 0, [1.0, 0.0]), (2, 1, [.8, .2])], "filing_id long, chunk_idx long, embedding array<double>")
    assert TS.section_similarity(p, w).first().drift_score > 0.25
    assert TS.section_similarity(p, v.where("filing_id = 2")).first().drift_score is None


def test_history_relative_needs_three_and_spread(spark):
    rows = [(i, 1, date(2020 + i, 1, 1), x) for i, x in enumerate((.02, .03, .04, .09, .05))]
    d = spark.createDataFrame(rows, "filing_id long, company_id long, filed_at date, raw_score double")
    got = {r.filing_id: r.history_relative_score for r in TS.history_relative(d, ["company_id"]).collect()}
    assert got[0] is None and got[2] is None and got[3] == 1.0
    mean, sd = .045, (sum((x - .045) ** 2 for x in (.02, .03, .04, .09)) / 4) ** .5
    assert got[4] == pytest.approx((.05 - mean) / sd / 2)
    flat = d.withColumn("raw_score", F.lit(.02))
    assert {r.history_relative_score for r in TS.history_relative(flat, ["company_id"]).collect()} == {None}


def test_tone(spark):
    rows = [(1, "mda", 0, 1, i, f"paragraph {i}", i < 2, p, n, u) for i, (p, n, u) in enumerate(((.1, .8, .1), (.2, .6, .2), (.9, .05, .05), (None, None, None)))]
    s = spark.createDataFrame(rows, "filing_id long, section string, sequence_idx int, section_id long, pos int, text string, is_forward_looking boolean, positive double, negative double, neutral double")
    r = TS.tone_features(s).first()
    assert r.text_sentiment == pytest.approx(.4) and r.forward_pessimism == pytest.approx((.7 - .15 + 1) / 2) and r.coverage_ratio_all == .75
    assert len(r.sample_scores) == 3


# ---------------------------------------------------------------- fusion
def signals(spark, filing_id, company_id=1, **vals):
    return spark.createDataFrame([(filing_id, company_id, k, v, '{"confidence": 0.8}', datetime(2026, 2, 1)) for k, v in vals.items()],
                                 "filing_id long, company_id long, signal_name string, signal_value double, detail string, computed_at timestamp")


FULL = dict(rlds=.70, mda_drift=.40, forward_pessimism=.60, text_sentiment=.90, fundamental_deterioration=.80, balance_sheet_stress=.30,
            revenue_growth_deceleration=.50, earnings_quality=.20, numeric_anomaly=.10, insider_signal=.785, market_signal=.65, sentiment_signal=.55)


def filings(spark, *days, form="10-K"):
    return spark.createDataFrame([(i, 1, f"a{i}", form, d, None, d.year, None) for i, d in enumerate(days, 1)], FILING)


def test_composite_full_and_mid_range(spark):
    f = filings(spark, date(2026, 1, 31))
    w = C.composite_wide(f, signals(spark, 1, **FULL)).first()
    assert w.narrative_numeric_divergence == pytest.approx(.20) and w.convergence_boost == .20 and w.convergence_tier == "full"
    assert w.nci_global == 1.0 and w.confidence_label == "high" and w.confidence == pytest.approx(.8)
    names = ("rlds", "mda_drift", "forward_pessimism", "fundamental_deterioration", "balance_sheet_stress", "revenue_growth_deceleration",
             "earnings_quality", "insider_signal", "market_signal", "sentiment_signal")
    mid = dict(zip(names, (.15, .10, .12, .18, .10, .08, .05, .05, .12, .10)))
    m = C.composite_wide(f, signals(spark, 1, **mid)).first()
    raw = sum(P.COMPOSITE_WEIGHTS[n] * x for n, x in mid.items())
    assert m.raw_total == pytest.approx(raw) and m.nci_global == pytest.approx((raw - .04) / .31)


def test_composite_gate_rescale_and_downgrade(spark):
    f = filings(spark, date(2026, 1, 31))
    two = C.composite_signals(C.composite_wide(f, signals(spark, 1, rlds=.7, mda_drift=.4)), at())
    r = two.where("signal_name = 'nci_global'").first()
    assert r.signal_value is None and '"availability_reason":"insufficient_signal_coverage"' in r.detail and '"coverage_ratio":0.2' in r.detail
    part = {k: v for k, v in FULL.items() if k != "insider_signal"}
    w = C.composite_wide(f, signals(spark, 1, **part)).first()
    total = sum(P.COMPOSITE_WEIGHTS.get(k, 0) * v for k, v in part.items())
    assert w.raw_score == pytest.approx(total / .90) and w.missing_critical_layers == ["behavior"] and w.confidence_label == "medium"
    none = C.composite_wide(f, signals(spark, 1, text_sentiment=.5)).first()
    assert none.nci_global is None and none.availability_reason == "missing_all_component_inputs"


def test_composite_carry_forward(spark):
    f = filings(spark, date(2025, 1, 31), date(2025, 4, 30), date(2025, 7, 31), date(2025, 10, 31))
    rest = {k: v for k, v in FULL.items() if k != "fundamental_deterioration"}
    s = signals(spark, 1, fundamental_deterioration=.80)
    for i in (2, 3, 4):
        s = s.unionByName(signals(spark, i, **rest))
    w = {r.filing_id: r for r in C.composite_wide(f, s).collect()}
    assert w[2].fundamental_deterioration == pytest.approx(.76) and w[3].fundamental_deterioration == pytest.approx(.76)
    assert w[2]["in_fundamental_deterioration"].filings_back == 1 and w[3]["in_fundamental_deterioration"].filings_back == 2
    assert w[4].fundamental_deterioration is None  # three filings back is too far
    assert w[2].carried_forward == ["fundamental_deterioration"] and w[2].xbrl_source_filing == 2
    snap = {r.filing_id: r for r in C.snapshot_rows(C.composite_wide(f, s), at()).collect()}
    assert snap[2].staleness_reason == "carried_forward_inputs" and 1 not in snap


def test_hot_company_gives_the_same_scores(spark):
    days = [date(2020, 1, 1) + timedelta(days=17 * i) for i in range(30)]
    f = filings(spark, *days)
    s = None
    for i in range(1, 31):
        vals = {k: v for j, (k, v) in enumerate(FULL.items()) if (i + j) % 3}
        x = signals(spark, i, **vals)
        s = x if s is None else s.unionByName(x)
    pick = lambda hot: sorted((r.filing_id, r.nci_global, r.confidence) for r in C.composite_wide(f, s.coalesce(1), hot_rows=hot).collect())
    assert pick(None) == pick(7)


# ---------------------------------------------------------------- validation
def test_validation_flags(spark):
    rows = [("X", y, k, k, date(y, 2, 1), y, v) for k, vs in (("flat", (.20, .22, .21)), ("missing", (None,) * 3), ("high", (.8, .9, .95)), ("zero", (0.0,) * 3),
                                                               ("move", (.1, .5, .2)), ("sparse", (.4, None, None))) for y, v in zip((2022, 2023, 2024), vs)]
    raw = spark.createDataFrame(rows, "ticker string, year int, signal_key string, signal_label string, filed_at date, seq int, signal_value double")
    got = {r.signal_key: r.verdict for r in A.signal_flags(A.yearly_signals(raw)).collect()}
    assert got == {"flat": "flat", "missing": "missing", "high": "always_high", "zero": "always_zero", "move": "variable", "sparse": "sparse"}
