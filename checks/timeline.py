"""Driver queries: as-of joins, history, windows, interval joins, per-key reductions."""
from pyspark.sql import Window, functions as F

from checks.views import (company, event_filing, events, fact, filing, metric, news, price, r6, r8, signal, sql, t, trade)
from ledgerlens import policies as P
from ledgerlens.functions import dates as D, scoring as S, strings as T
from ledgerlens.operators import aggregates as A, dedupe as DD, intervals as I, ordered as O
from ledgerlens.plans import behavior_signals as B, history as H, market_signals as M, numeric_signals as Q, rows as R
from ledgerlens.plans import sentiment_signals as E, text_signals as TS

Q_, S_ = {}, {}
r7 = lambda c: F.round(c, 7) + F.lit(0.0)


def reg(name, oracle=None):
    def deco(fn):
        Q_[name] = fn
        if oracle:
            S_[name] = oracle
        return fn
    return deco


# ---------------------------------------------------------------- JON-07 FIL-03 DAT-05
@reg("asof_previous", sql("""
SELECT c.filing_id, p.id AS previous_filing_id, p.d AS previous_filed_at,
  CASE WHEN p.id IS NOT NULL THEN greatest(c.filed_at - p.d, 1) END::INT AS days_between_filings,
  CASE WHEN form_type='10-Q' THEN 'most_recent_annual_risk_baseline' ELSE 'prior_annual_same_section' END AS comparison_basis
FROM v_filing c LEFT JOIN (
  SELECT a.filing_id AS fid, arg_max(b.filing_id, (b.filed_at, b.filing_id)) AS id, max(b.filed_at) AS d
  FROM v_filing a JOIN v_filing b ON a.company_id=b.company_id AND b.form_type='10-K' AND b.filed_at < a.filed_at GROUP BY 1
) p ON p.fid=c.filing_id""", "v_filing"))
def asof_previous(spark, d):
    return H.comparison_filings(filing(spark, d), "risk_factors").select(
        "filing_id", "previous_filing_id", "previous_filed_at", "days_between_filings", "comparison_basis")


@reg("asof_previous_mda", sql("""
SELECT a.filing_id, arg_max(b.filing_id, (b.filed_at, b.filing_id)) AS previous_filing_id
FROM v_filing a LEFT JOIN v_filing b ON a.company_id=b.company_id AND b.form_type=a.form_type AND b.filed_at < a.filed_at
GROUP BY 1""", "v_filing"))
def asof_previous_mda(spark, d):
    return H.comparison_filings(filing(spark, d), "mda").select("filing_id", "previous_filing_id")


# ---------------------------------------------------------------- JON-08 WIN-08 DAT-08 SIG-16
@reg("asof_value", sql("""
, px AS (SELECT company_id, trading_date, arg_max(price, price_id) AS price FROM v_price GROUP BY 1,2)
, an AS (SELECT DISTINCT company_id, filed_at FROM v_event_filing)
, lp AS (SELECT an.*, px.trading_date, px.price FROM an ASOF LEFT JOIN px
    ON an.company_id=px.company_id AND an.filed_at >= px.trading_date)
, lb AS (SELECT lp.company_id, lp.filed_at, lp.price, b.price AS p1
    FROM lp ASOF LEFT JOIN px b ON lp.company_id=b.company_id AND lp.trading_date - 30 >= b.trading_date)
, lc AS (SELECT lp.company_id, lp.filed_at, b.price AS p7
    FROM lp ASOF LEFT JOIN px b ON lp.company_id=b.company_id AND lp.trading_date - 7 >= b.trading_date)
SELECT lp.company_id, lp.filed_at, lp.trading_date, round(lp.price,6) AS price,
  round(CASE WHEN p7>0 THEN (lp.price-p7)/p7 END,6)+0e0 AS return_7d,
  round(CASE WHEN p1>0 THEN (lp.price-p1)/p1 END,6)+0e0 AS return_1m
FROM lp JOIN lb USING (company_id, filed_at) JOIN lc USING (company_id, filed_at)""".replace(", px AS", "SELECT * FROM (WITH px AS", 1)
    + ")", "v_price", "v_event_filing"))
def asof_value(spark, d):
    w = Window.partitionBy("company_id").orderBy(F.unix_date("trading_date")).rangeBetween(Window.unboundedPreceding, -7)
    daily = M.daily_prices(price(spark, d))
    m = M.momentum(daily).withColumn("__p7", F.last("price").over(w))
    m = m.withColumn("return_7d", F.when(F.col("__p7") > 0, (F.col("price") - F.col("__p7")) / F.col("__p7")))
    anchors = event_filing(spark, d).select("company_id", "filed_at").distinct()
    a = O.asof(anchors, m, ["company_id"], "filed_at", "trading_date", F.lit(0),
               ["trading_date", "price", "return_7d", "return_1m"])
    return a.select("company_id", "filed_at", "asof.trading_date", r6(F.col("asof.price")).alias("price"),
                    r6(F.col("asof.return_7d")).alias("return_7d"), r6(F.col("asof.return_1m")).alias("return_1m"))


# ---------------------------------------------------------------- JON-10 FIL-05 DAT-06
@reg("interval_join", sql("""
, a AS (SELECT DISTINCT company_id, filed_at FROM v_event_filing)
SELECT a.company_id, a.filed_at, count(*) AS articles, count(score) AS scored, round(sum(score),6)+0e0 AS score_sum
FROM a JOIN v_news n ON a.company_id=n.company_id
 AND n.published_at <= a.filed_at::TIMESTAMP + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND
 AND n.published_at >= a.filed_at::TIMESTAMP + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND - INTERVAL 7 DAY
GROUP BY 1,2""".replace(", a AS", "SELECT * FROM (WITH a AS", 1) + ")", "v_news", "v_event_filing"))
def interval_join(spark, d):
    days = E.daily_news(news(spark, d), E.article_score(F.col("raw_json"), F.col("sentiment_label")))
    a = event_filing(spark, d).select("company_id", "filed_at").distinct()
    p = I.interval_join(a, days, ["company_id"], "filed_at", "day", 7, 0)
    ago = F.datediff("filed_at", "day")
    return (p.where((ago < 7) | F.col("edge")).groupBy("company_id", "filed_at")
            .agg(F.sum("articles").alias("articles"), F.sum("scored").alias("scored"),
                 r6(F.sum("score_sum")).alias("score_sum")))


# ---------------------------------------------------------------- JON-11 WIN-13
@reg("routine_link", sql("""
SELECT s.transaction_id, EXISTS (SELECT 1 FROM v_trade c WHERE c.company_id=s.company_id AND c.insider_name=s.insider_name
  AND c.transaction_code IN ('A','F','M','G') AND s.transaction_date - c.transaction_date BETWEEN 0 AND 7) AS linked
FROM v_trade s WHERE s.transaction_code='S'""", "v_trade"))
def routine_link(spark, d):
    tr = B.prepared_trades(trade(spark, d))
    links = B.compensation_links(tr)
    s = trade(spark, d).where("transaction_code = 'S'").withColumn(
        "insider_key", T.insider_key(F.col("insider_cik"), F.col("insider_name")))
    return (s.join(links, ["company_id", "insider_key", "transaction_date"], "left")
            .select("transaction_id", F.col("comp_date").isNotNull().alias("linked")))


# ---------------------------------------------------------------- JON-12 AGG-06 MTH-22
@reg("peer_median", sql("""
SELECT a.company_id, round(any_value(a.pe),6)+0e0 AS pe, count(b.pe)::INT AS peer_count, round(median(b.pe),6)+0e0 AS peer_median
FROM cp a LEFT JOIN cp b ON a.sector=b.sector AND a.company_id<>b.company_id GROUP BY a.company_id""",
    "v_metric", "v_company", latest="""SELECT company_id, arg_max(filing_id,(filed_at,filing_id)) AS filing_id FROM v_filing GROUP BY 1""",
    cp="""SELECT c.company_id, c.sector, CASE WHEN m.amount>0 AND m.shares_outstanding>0 AND m.net_income>0
       THEN m.amount*m.shares_outstanding/(m.net_income*CASE WHEN m.form_type='10-Q' THEN 4.0 ELSE 1.0 END) END AS pe
       FROM v_company c LEFT JOIN latest l USING (company_id) LEFT JOIN v_metric m ON m.filing_id=l.filing_id"""))
def peer_median(spark, d):
    last = DD.latest_per_key(metric(spark, d), ["company_id"], "filed_at", "filing_id")
    pe = S.price_earnings(F.col("amount"), F.col("shares_outstanding"), S.annualise(F.col("net_income"), F.col("form_type")))
    c = company(spark, d).select("company_id", "sector").join(last.select("company_id", pe.alias("pe")), "company_id", "left")
    m = A.median_excluding_self(c, ["sector"], "company_id", "pe")
    return m.select("company_id", r6(F.col("pe")).alias("pe"), "peer_count", r6(F.col("peer_median")).alias("peer_median"))


@reg("group_median", sql("SELECT insider_name, median(shares) AS median_shares FROM v_trade WHERE transaction_code IN ('S','P') GROUP BY 1",
                         "v_trade"))
def group_median(spark, d):
    return A.exact_median(trade(spark, d).where(F.col("transaction_code").isin("S", "P")), ["insider_name"], "shares",
                          "median_shares")


# ---------------------------------------------------------------- AGG-01
@reg("insider_summary", sql("""SELECT company_id, count(*) AS total_transactions,
 count(*) FILTER (transaction_type_normalized='open_market_sell') AS opportunistic_sells,
 round(coalesce(sum(transaction_value) FILTER (transaction_code='S'),0),2) AS total_sell_value,
 round(coalesce(sum(transaction_value) FILTER (transaction_code='P'),0),2) AS total_buy_value,
 max(transaction_date) AS latest_transaction_date FROM v_trade GROUP BY 1""", "v_trade"))
def insider_summary(spark, d):
    s = A.insider_summary(trade(spark, d))
    return s.withColumns({c: F.round(c, 2) for c in ("total_sell_value", "total_buy_value")})


# ---------------------------------------------------------------- AGG-02 AGG-24
_ALIASES = {"revenue": ("R", "A"), "income": ("N",)}


@reg("latest_facts", sql("""
SELECT company_id, max(period_end) AS period_end,
 coalesce(arg_max(value, (fact_id)) FILTER (concept='R'), arg_max(value, (fact_id)) FILTER (concept='A')) AS revenue,
 arg_max(value, (fact_id)) FILTER (concept='N') AS income
FROM f JOIN mx USING (company_id) WHERE period_end = mx.m GROUP BY 1""", "v_fact", "v_filing",
    f="SELECT v_fact.*, company_id FROM v_fact JOIN v_filing USING (filing_id)",
    mx="SELECT company_id, max(period_end) AS m FROM f GROUP BY 1"))
def latest_facts(spark, d):
    f = fact(spark, d).join(filing(spark, d).select("filing_id", "company_id"), "filing_id")
    return A.latest_period_facts(f.withColumn("created_at", F.timestamp_seconds(F.lit(0))), _ALIASES)


# ---------------------------------------------------------------- AGG-07 AGG-08 WIN-05 WIN-07
_HIST = dict(
    base="""SELECT *, revenue*CASE WHEN form_type='10-Q' THEN 4.0 ELSE 1.0 END AS m_rev, quarter(period_of_report) AS q FROM v_metric""",
    cand="""SELECT a.filing_id AS anchor, a.q AS aq, a.form_type AS aform, f.*,
      row_number() OVER (PARTITION BY a.filing_id ORDER BY f.filed_at DESC, f.filing_id DESC) AS rn
      FROM base a JOIN base f ON a.company_id=f.company_id AND a.form_type=f.form_type
       AND (f.filed_at < a.filed_at OR (f.filed_at=a.filed_at AND f.filing_id<=a.filing_id))""",
    cand2="""SELECT *, sum(CASE WHEN q=aq THEN 1 ELSE 0 END) OVER (PARTITION BY anchor) AS nq,
      row_number() OVER (PARTITION BY anchor, q=aq ORDER BY rn) AS rq FROM cand WHERE rn <= 32""",
    hist="""SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY rn) AS k FROM cand2
      WHERE CASE WHEN aform='10-Q' AND nq >= 2 THEN q=aq AND rq <= 8 ELSE rn <= 8 END""")


@reg("comparable_history", sql("""SELECT anchor AS filing_id, count(*)::INT AS history_size, min(filing_id) AS min_id,
  max(filing_id) FILTER (k=2) AS previous_id FROM hist GROUP BY 1""", "v_metric", **_HIST))
def comparable_history(spark, d):
    h = H.with_history(filing(spark, d), [])
    return h.select("filing_id", F.size("history").alias("history_size"),
                    F.array_min(F.transform("history", lambda x: x["filing_id"])).alias("min_id"),
                    F.get("history", F.size("history") - 2)["filing_id"].alias("previous_id"))


_FEATURES = dict(
    _HIST,
    met="""SELECT *, gross_profit*f/nullif(revenue*f,0) AS gm, operating_income*f/nullif(revenue*f,0) AS om,
      net_income*f/nullif(revenue*f,0) AS nm, long_term_debt/nullif(equity,0) AS dte, cash/nullif(assets,0) AS cr,
      CASE WHEN net_income>0 THEN operating_cash_flow/net_income END AS cfq,
      operating_cash_flow*f/nullif(abs(net_income*f),0) AS ccr, (net_income*f-operating_cash_flow*f)/nullif(assets,0) AS acc
      FROM (SELECT *, CASE WHEN form_type='10-Q' THEN 4.0 ELSE 1.0 END::DOUBLE AS f FROM hist)""",
    grow="""SELECT *, CASE WHEN pm <> 0 THEN (revenue - pm)/pm END AS rg FROM
      (SELECT *, lag(m_rev) OVER (PARTITION BY anchor ORDER BY k DESC) AS pm FROM met)""",
    zz="""SELECT anchor, count(*) FILTER (ok) AS hc,
      count(gm) FILTER (ok) AS n1, avg(gm) FILTER (ok) AS a1, stddev_pop(gm) FILTER (ok) AS s1,
      count(om) FILTER (ok) AS n2, avg(om) FILTER (ok) AS a2, stddev_pop(om) FILTER (ok) AS s2,
      count(rg) FILTER (ok) AS n3, avg(rg) FILTER (ok) AS a3, stddev_pop(rg) FILTER (ok) AS s3,
      count(dte) FILTER (ok) AS n4, avg(dte) FILTER (ok) AS a4, stddev_pop(dte) FILTER (ok) AS s4
      FROM (SELECT *, k>1 AND (aform='10-K' OR q=aq) AS ok FROM grow) GROUP BY 1""",
    feat="""SELECT c.anchor AS filing_id, c.company_id, c.revenue AS raw_rev, c.lines, z.hc,
      c.gm-p.gm AS d_gm, c.om-p.om AS d_om, c.nm-p.nm AS d_nm, c.rg AS rg, p.rg AS prg, c.dte AS dte, p.dte AS pdte,
      c.cr AS cr, p.cr AS pcr, c.cfq AS cfq, c.ccr AS ccr, p.ccr AS pccr, c.acc AS acc, p.acc AS pacc,
      CASE WHEN hc>=4 AND n1>=4 AND s1>=.001 THEN (c.gm-a1)/s1 END AS z1, CASE WHEN hc>=4 AND n2>=4 AND s2>=.001 THEN (c.om-a2)/s2 END AS z2,
      CASE WHEN hc>=4 AND n3>=4 AND s3>=.001 THEN (c.rg-a3)/s3 END AS z3, CASE WHEN hc>=4 AND n4>=4 AND s4>=.001 THEN (c.dte-a4)/s4 END AS z4
      FROM (SELECT * FROM grow WHERE k=1) c LEFT JOIN (SELECT * FROM grow WHERE k=2) p ON p.anchor=c.anchor
      LEFT JOIN zz z ON z.anchor=c.anchor""")
_Z = """sqrt((coalesce(z1*z1,0)+coalesce(z2*z2,0)+coalesce(z3*z3,0)+coalesce(z4*z4,0))
  /nullif((z1 IS NOT NULL)::INT+(z2 IS NOT NULL)::INT+(z3 IS NOT NULL)::INT+(z4 IS NOT NULL)::INT,0))"""


@reg("z_distance", sql(f"""SELECT filing_id, hc::INT AS history_count, round(z1,6)+0e0 AS gross_margin_zscore, round(z2,6)+0e0 AS operating_margin_zscore,
  round(z3,6)+0e0 AS revenue_growth_zscore, round(z4,6)+0e0 AS debt_to_equity_zscore, round({_Z},6)+0e0 AS distance FROM feat""",
                       "v_metric", **_FEATURES))
def z_distance(spark, d):
    f = Q.numeric_features(metric(spark, d))
    return f.select("filing_id", F.col("anomaly_history_count").alias("history_count"),
                    *[r6(F.col(f"{m}_zscore")).alias(f"{m}_zscore") for m in P.ANOMALY_METRICS],
                    r6(F.col("numeric_anomaly_distance")).alias("distance"))


def _c01(x):
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest(0.0,least(1.0,({x}))) END"


def _wavg(parts):
    num = "+".join(f"coalesce(({x})*{w},0)" for x, w in parts)
    den = "+".join(f"CASE WHEN ({x}) IS NOT NULL THEN {w} ELSE 0 END" for x, w in parts)
    return _c01(f"({num})/nullif({den},0)")


_pos = lambda x, cap: f"CASE WHEN ({x}) IS NOT NULL THEN least(1.0, greatest(0.0,({x}))/{cap}) END"
_neg = lambda x, cap: f"CASE WHEN ({x})>=0 THEN 0.0 WHEN ({x})<0 THEN least(1.0, abs({x})/{cap}) END"
_abs = lambda x, cap: f"CASE WHEN ({x}) IS NOT NULL THEN least(1.0, abs({x})/{cap}) END"
_CONS = _wavg([(_abs("ccr-pccr", 1.0), .6), (_abs("acc-pacc", .1), .4)])
NUMERIC_SQL = {
    "fundamental_deterioration": _wavg([(_neg("d_gm", .2), .35), (_neg("d_om", .2), .4), (_neg("d_nm", .2), .25)]),
    "revenue_growth_deceleration": _pos("prg-rg", .3),
    "balance_sheet_stress": _wavg([(_pos("dte-pdte", 1.0), .35), (_pos("pcr-cr", .1), .3), (_c01("(1.0-cfq)/1.5"), .35)]),
    "earnings_quality": _wavg([(_pos("acc", .1), .45), (_c01("1.0-ccr"), .35), (_CONS, .2)]),
    "numeric_anomaly": _c01(f"{_Z}/3.0"),
}


@reg("numeric_signals", sql("SELECT filing_id, company_id, signal_name, round(CASE WHEN lines IS NOT NULL OR amount IS NOT NULL THEN v END,8)+0e0 AS signal_value FROM (SELECT feat.*, v_filing.amount FROM feat JOIN v_filing USING (filing_id)) f, LATERAL (VALUES "
                            + ",".join(f"('{n}', {x})" for n, x in NUMERIC_SQL.items()) + ") s(signal_name, v)",
                            "v_metric", **_FEATURES))
def numeric_signals(spark, d):
    s = Q.numeric_signals(Q.numeric_features(metric(spark, d)), F.lit("2024-01-01").cast("timestamp"))
    return s.select("filing_id", "company_id", "signal_name", r8(F.col("signal_value")).alias("signal_value"))


@reg("period_metrics", sql("""SELECT filing_id, round(gm,8)+0e0 AS gross_margin, round(om,8)+0e0 AS operating_margin, round(nm,8)+0e0 AS net_margin,
 round(dte,8)+0e0 AS debt_to_equity, round(cr,8)+0e0 AS cash_ratio, round(cfq,8)+0e0 AS cf_quality, round(ccr,8)+0e0 AS cash_conversion_ratio,
 round(acc,8)+0e0 AS accruals_ratio FROM met""", "v_metric", met=_FEATURES["met"].replace("FROM hist)", "FROM v_metric)")))
def period_metrics(spark, d):
    m = metric(spark, d)
    p = S.period_metrics({k: F.col(k) for k in P.FACT_ALIASES}, F.col("form_type"))
    return m.select("filing_id", *[r8(p[k]).alias(k) for k in (
        "gross_margin", "operating_margin", "net_margin", "debt_to_equity", "cash_ratio", "cf_quality",
        "cash_conversion_ratio", "accruals_ratio")])


# ---------------------------------------------------------------- WIN-02 MTH-02..05
@reg("growth", sql("""SELECT filing_id, round(l1,2)+0e0 AS prior, round(l2,2)+0e0 AS two_back, round((r-l1)/nullif(l1,0),6)+0e0 AS growth, round(r-l1,2)+0e0 AS delta
 FROM (SELECT filing_id, r, lag(r) OVER w AS l1, lag(r,2) OVER w AS l2 FROM
  (SELECT *, revenue*CASE WHEN form_type='10-Q' THEN 4.0 ELSE 1.0 END AS r FROM v_metric)
  WINDOW w AS (PARTITION BY company_id ORDER BY filed_at, filing_id))""", "v_metric"))
def growth(spark, d):
    m = metric(spark, d).withColumn("r", S.annualise(F.col("revenue"), F.col("form_type")))
    g = O.lagged(m, ["company_id"], O.Order.by_day("filed_at", "filing_id"), {"l1": ("r", 1), "l2": ("r", 2)})
    return g.select("filing_id", (F.round("l1", 2) + 0.0).alias("prior"), (F.round("l2", 2) + 0.0).alias("two_back"),
                    r6(S.growth(F.col("r"), F.col("l1"))).alias("growth"), (F.round(F.col("r") - F.col("l1"), 2) + 0.0).alias("delta"))


# ---------------------------------------------------------------- WIN-03 WIN-04 SIG-17
_RET = dict(
    rets="""SELECT * FROM (SELECT *, (price-p)/nullif(p,0) AS ret, p FROM (SELECT *, lag(price) OVER
      (PARTITION BY company_id ORDER BY trading_date, price_id) AS p FROM v_price)) WHERE p > 0""",
    vol="""SELECT *, CASE WHEN count(ret) OVER w30 >= 30 THEN stddev_pop(ret) OVER w30*sqrt(252.0) END AS v30,
      CASE WHEN count(ret) OVER w30 >= 30 THEN stddev_pop(ret) OVER w180*sqrt(252.0) END AS v180 FROM rets
      WINDOW w30 AS (PARTITION BY company_id ORDER BY trading_date, price_id ROWS 29 PRECEDING),
       w180 AS (PARTITION BY company_id ORDER BY trading_date, price_id ROWS 179 PRECEDING)""")


@reg("returns_vol", sql("""SELECT price_id, round(ret,6)+0e0 AS ret, round(v30,4)+0e0 AS rolling_vol_30d, round(v180,4)+0e0 AS rolling_vol_180d,
 round(greatest(0.0,least(1.0,(v30/nullif(v180,0)-1)/1.5)),6)*CASE WHEN v30 IS NULL OR v180=0 THEN NULL ELSE 1 END+0e0 AS volatility_spike FROM vol""", "v_price", **_RET))
def returns_vol(spark, d):
    v = M.volatility(M.daily_returns(price(spark, d)))
    return v.select("price_id", r6(F.col("ret")).alias("ret"),
                    *[(F.round(c, 4) + 0.0).alias(c) for c in ("rolling_vol_30d", "rolling_vol_180d")],
                    r6(F.col("volatility_spike")).alias("volatility_spike"))


# ---------------------------------------------------------------- WIN-06 MTH-11
@reg("history_score", sql("""
SELECT filing_id, n::INT AS historical_raw_count, round(m,7)+0e0 AS historical_raw_mean, round(sd,7)+0e0 AS historical_raw_std,
 round(CASE WHEN n>=3 AND sd>=.005 THEN greatest(0.0,least(1.0,greatest(0.0,(v-m)/sd)/2.0)) * CASE WHEN v IS NULL THEN NULL ELSE 1 END END,7)+0e0 AS history_relative_score,
 round(CASE WHEN v<=.01 THEN 0.0 WHEN v>=.08 THEN 1.0 ELSE (v-.01)/.07 END,7)+0e0 AS raw_rescaled_score
FROM (SELECT filing_id, v, count(v) OVER w AS n, CASE WHEN count(v) OVER w>=3 THEN avg(v) OVER w END AS m,
   CASE WHEN count(v) OVER w>=3 THEN stddev_pop(v) OVER w END AS sd
  FROM (SELECT f.filing_id, f.company_id, f.filed_at, s.signal_value/7.3 AS v FROM v_filing f JOIN v_signal s USING (filing_id) WHERE signal_name='rlds')
  WINDOW w AS (PARTITION BY company_id ORDER BY filed_at, filing_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""", "v_filing", "v_signal"))
def history_score(spark, d):
    s = signal(spark, d).where("signal_name = 'rlds'").select("filing_id", (F.col("signal_value") / 7.3).alias("raw_score"))
    h = TS.history_relative(filing(spark, d).join(s, "filing_id"), ["company_id"])
    return h.select("filing_id", "historical_raw_count", *[r7(F.col(c)).alias(c) for c in (
        "historical_raw_mean", "historical_raw_std", "history_relative_score")],
        r7(S.rescale(F.col("raw_score"))).alias("raw_rescaled_score"))


# ---------------------------------------------------------------- WIN-01, WIN-09
@reg("latest_per_key", """SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER
 (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn=1""")
def latest_per_key(spark, d):
    return DD.latest_per_key(events(spark, d), ["user_id", "event_type"], "ts", "event_id").select(
        "event_id", "user_id", "event_type", "value")


@reg("keep_first", sql("""SELECT company_id, insider_name, transaction_date, min(transaction_id) AS transaction_id FROM v_trade
 GROUP BY company_id, insider_name, transaction_date""", "v_trade"))
def keep_first(spark, d):
    return DD.keep_first(trade(spark, d), ["company_id", "insider_name", "transaction_date"], "transaction_id").select(
        "company_id", "insider_name", "transaction_date", "transaction_id")


@reg("economic_transactions", sql("""SELECT transaction_id FROM (SELECT *, row_number() OVER (PARTITION BY company_id, accession_number, insider_name,
 transaction_date, transaction_code, shares, price_per_share, ownership_nature, acquired_disposed_code, is_derivative ORDER BY transaction_id) rn
 FROM v_trade) WHERE rn=1""", "v_trade"))
def economic_transactions(spark, d):
    return DD.economic_transactions(trade(spark, d)).select("transaction_id")


# ---------------------------------------------------------------- AGG-11 DAT-07
_BD = """(SELECT count(*) FROM range(1, greatest(filed - tx, 0) + 1) r(i) WHERE isodow(tx + r.i::INT) <= 5)"""


@reg("late_ratio", sql(f"""
SELECT company_id, round(avg(CASE WHEN filed IS NULL THEN 1.0 WHEN filed > tx AND {_BD} > 2 THEN 1.0 ELSE 0.0 END),6)+0e0 AS late_filing_ratio
FROM acc GROUP BY 1""", "v_trade", acc="""SELECT company_id, accession_number, min(transaction_date) AS tx,
 arg_min(filed_at,(transaction_date,transaction_id)) FILTER (filed_at IS NOT NULL) AS filed FROM v_trade GROUP BY 1,2"""))
def late_ratio(spark, d):
    days = trade(spark, d).groupBy("company_id", "accession_number", "transaction_date").agg(
        F.min_by("filed_at", F.when(F.col("filed_at").isNotNull(), F.col("transaction_id"))).alias("filed_at"))
    l = A.late_filing_ratio(days, ["company_id"])
    return l.select("company_id", r6(F.col("late_filing_ratio")).alias("late_filing_ratio"))


# ---------------------------------------------------------------- AGG-14 MTH-12 DAT-12
@reg("decayed_mean", sql("""SELECT company_id, round(sum(score*exp(-d/15.0))/sum(CASE WHEN score IS NOT NULL THEN exp(-d/15.0) END),6)+0e0 AS tone, count(score) AS scored
FROM (SELECT *, greatest(floor(epoch_us(TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 1 MICROSECOND)/86400e6 - epoch_us(published_at)/86400e6),0) AS d FROM v_news) GROUP BY 1""", "v_news"))
def decayed_mean(spark, d):
    n = news(spark, d).withColumn("score", E.article_score(F.col("raw_json"), F.col("sentiment_label")))
    anchor = D.end_of_day(F.lit("2024-01-31").cast("date"))
    n = n.withColumn("days", D.whole_days_ago(anchor, F.col("published_at")))
    return A.decayed_mean(n, ["company_id"], "score", "days", "tone").select("company_id", r6(F.col("tone")).alias("tone"), "scored")


# ---------------------------------------------------------------- AGG-20
_FA = {"revenue": ("R", "A"), "net_income": ("N", "R")}


def _best(names, dur):
    rank = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(names))
    gap = "abs((period_end-period_start) - days)" if dur else "0"
    return (f"arg_min(value, (CASE WHEN unit='USD' THEN 0 ELSE 1 END, CASE concept {rank} END, abs(period_end-pe), {gap}, fact_id))"
            f" FILTER (concept IN ({','.join(repr(c) for c in names)}))")


@reg("best_fact", sql(f"""SELECT filing_id, {_best(("R", "A"), True)} AS revenue, {_best(("N", "R"), True)} AS net_income
 FROM (SELECT x.*, f.period_of_report AS pe, CASE WHEN f.form_type='10-K' THEN 365 ELSE 90 END AS days FROM v_fact x JOIN v_filing f USING (filing_id)) GROUP BY 1""",
                      "v_fact", "v_filing"))
def best_fact(spark, d):
    return A.best_facts(filing(spark, d), fact(spark, d), _FA)
