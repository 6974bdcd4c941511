"""Driver queries: payload readers (round trips), upserts, filters, projections, read queries, streams."""
from pyspark.sql import functions as F

from checks.views import (company, event_filing, events, fact, filing, metric, news, price, r6, r8, signal, signal_table,
                          sql, t, trade, vectors)
from ledgerlens import policies as P
from ledgerlens.functions import arrays as AR, dates as D, jsonpath as J, scoring as S, strings as T
from ledgerlens.operators import aggregates as A, upsert as U
from ledgerlens.plans import queries as R
from ledgerlens.session import spread
from ledgerlens.sources import json_payloads as JP, xml_payloads as XP

Q_, S_ = {}, {}


def reg(name, oracle=None):
    def deco(fn):
        Q_[name] = fn
        if oracle:
            S_[name] = oracle
        return fn
    return deco


def sorted_array(order, value):
    """Values in order; groups below are batches of fixed width."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"])


# ---------------------------------------------------------------- SRC-07 ARR-04 ARR-06 DAT-03 FIL-09
@reg("src_price_chart", """SELECT 'B'||(event_id//50) AS ticker, ts::DATE AS trading_date, value AS open, CASE WHEN event_id%5<>0 THEN value END AS close,
 CASE WHEN event_id%5<>0 THEN value END AS adjusted_close, event_id AS volume FROM events""")
def src_price_chart(spark, d):
    e = events(spark, d).withColumn("sym", F.concat(F.lit("B"), F.floor(F.col("event_id") / 50)))
    v = F.col("value")
    rows = e.groupBy("sym").agg(
        sorted_array("event_id", F.unix_seconds("ts")).alias("timestamp"), sorted_array("event_id", v).alias("open"),
        sorted_array("event_id", F.when(F.col("event_id") % 5 != 0, v)).alias("close"),
        sorted_array("event_id", F.col("event_id")).alias("volume"))
    none = F.lit(None).cast("array<double>")
    quote = F.array(F.struct("open", none.alias("high"), none.alias("low"), "close", "volume"))
    chart = F.struct(F.struct(F.array(F.struct("timestamp", F.struct(quote.alias("quote")).alias("indicators"))).alias("result")).alias("chart"))
    p = rows.select(F.col("sym").alias("ticker"), F.lit("x").alias("provider"), F.to_json(chart).alias("payload"))
    return JP.price_chart(p).select("ticker", "trading_date", "open", "close", "adjusted_close", "volume")


# ---------------------------------------------------------------- SRC-03 DAT-01 STR-18
@reg("src_filing_index", """SELECT lpad((o_orderkey//40)::VARCHAR,10,'0') AS cik, 'A-'||o_orderkey AS accession_number, form AS form_type, o_orderdate::DATE AS filed_at,
 CASE WHEN pos<30 THEN o_orderdate::DATE-31 END AS period_of_report, 'https://www.sec.gov/Archives/edgar/data/'||(o_orderkey//40)||'/A'||o_orderkey||'/'||
   CASE WHEN o_orderkey%3=0 THEN 'doc'||o_orderkey||'.htm' ELSE 'A'||o_orderkey||'.txt' END AS document_url
FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey//40 ORDER BY o_orderkey) AS rn FROM
  (SELECT *, o_orderkey%40 AS pos, CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-Q' ELSE 'S-1' END AS form FROM orders) WHERE form<>'S-1' AND o_orderkey%10<>9)""")
def src_filing_index(spark, d):
    o = t(spark, d, "orders")
    k = F.col("o_orderkey")
    form = F.when(F.col("o_orderstatus") == "F", "10-k").when(F.col("o_orderstatus") == "O", " 10-Q").otherwise("S-1")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    g = o.groupBy(F.floor(k / 40).alias("b")).agg(
        sorted_array("o_orderkey", F.concat(F.lit("A-"), k)).alias("accessionNumber"), sorted_array("o_orderkey", form).alias("form"),
        sorted_array("o_orderkey", F.when(k % 10 == 9, "bad").otherwise(day)).alias("filingDate"),
        sorted_array("o_orderkey", F.date_format(F.date_sub("o_orderdate", 31), "yyyy-MM-dd")).alias("rd"),
        sorted_array("o_orderkey", F.when(k % 3 == 0, F.concat(F.lit("doc"), k, F.lit(".htm"))).otherwise("")).alias("primaryDocument"))
    recent = F.struct("accessionNumber", "form", "filingDate", F.slice("rd", 1, 30).alias("reportDate"), "primaryDocument")
    p = g.select(F.col("b").cast("string").alias("cik"), F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("payload"))
    return JP.filing_index(p).select("cik", "accession_number", "form_type", "filed_at", "period_of_report", "document_url")


# ---------------------------------------------------------------- SRC-01 SRC-02 STR-01
@reg("src_ticker_map", """SELECT 'T'||(c_custkey//2) AS ticker, lpad(max(c_custkey)::VARCHAR,10,'0') AS cik FROM customer GROUP BY 1""")
def src_ticker_map(spark, d):
    c = t(spark, d, "customer")
    entry = F.struct(F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("k"), F.struct(
        F.col("c_custkey").cast("string").alias("cik_str"), F.concat(F.lit(" t"), F.floor(F.col("c_custkey") / 2)).alias("ticker")).alias("v"))
    p = c.groupBy(F.floor(F.col("c_custkey") / 100)).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("m"))
    return JP.ticker_map(p.select(F.to_json("m").alias("payload")))


@reg("src_company_meta", """SELECT lpad(c_custkey::VARCHAR,10,'0') AS cik, CASE WHEN c_custkey%3=0 THEN lpad(c_custkey::VARCHAR,10,'0') ELSE 'T'||c_custkey END AS ticker,
 c_name AS name, c_nationkey::VARCHAR AS sic_code, c_mktsegment AS sic_description, CASE WHEN c_custkey%2=0 THEN 'NYSE' END AS exchange FROM customer""")
def src_company_meta(spark, d):
    c, k = t(spark, d, "customer"), F.col("c_custkey")
    p = c.select(k.cast("string").alias("cik"), F.to_json(F.struct(
        F.concat(F.lit(" "), "c_name").alias("name"), F.col("c_nationkey").cast("string").alias("sic"), F.col("c_mktsegment").alias("sicDescription"),
        F.when(k % 3 != 0, F.array(F.concat(F.lit("t"), k))).alias("tickers"), F.when(k % 2 == 0, F.array(F.lit("NYSE"), F.lit("B"))).alias("exchanges"))).alias("payload"))
    return JP.company_meta(p)


# ---------------------------------------------------------------- SRC-08
@reg("src_macro_series", """SELECT 'S'||(event_id//50) AS series_id, ts::DATE AS observation_date, value, 'Daily' AS frequency FROM events WHERE event_id%7<>0""")
def src_macro_series(spark, d):
    e = events(spark, d).withColumn("b", F.floor(F.col("event_id") / 50))
    sid = F.concat(F.lit("S"), F.col("b"))
    obs = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.when(F.col("event_id") % 7 == 0, ".").otherwise(F.col("value").cast("string")).alias("value"))
    o = e.groupBy("b").agg(sorted_array("event_id", obs).alias("observations"))
    o = o.select(sid.alias("series_id"), F.lit("x").alias("provider"), F.to_json(F.struct("observations")).alias("payload"))
    meta = e.select("b").distinct().select(sid.alias("series_id"), F.to_json(F.struct(F.array(F.struct(
        sid.alias("id"), F.lit("Daily ").alias("frequency"), F.lit(" ").alias("units"))).alias("seriess"))).alias("payload"))
    return JP.macro_series(meta, o).select("series_id", "observation_date", "value", "frequency")


# ---------------------------------------------------------------- SRC-04 JSN-01 AGG-21 JON-06 STR-21 DAT-10
_FJ = """SELECT l_orderkey AS company_id, l_returnflag AS concept, CASE WHEN l_linestatus='O' THEN 'USD' ELSE 'EUR' END AS unit, l_extendedprice AS value,
  date_trunc('month', l_shipdate)::DATE AS period_end, CASE WHEN l_linenumber%2=0 THEN (date_trunc('month', l_shipdate)::DATE - 90) END AS period_start,
  CASE WHEN l_linenumber%3=0 THEN '10-K' ELSE '10-Q' END AS form_type, CASE WHEN l_linenumber%4=0 THEN 'A'||lpad(l_orderkey::VARCHAR,10,'0') END AS accn, l_linenumber FROM lineitem"""


@reg("src_facts_json", sql("""SELECT company_id, concept, unit, period_start, period_end, form_type, value, filing_id FROM (
 SELECT x.*, coalesce(a.filing_id, p.filing_id) AS filing_id, row_number() OVER (PARTITION BY company_id, concept, unit, period_start, period_end, x.form_type
   ORDER BY (coalesce(a.filing_id, p.filing_id) IS NOT NULL) DESC, l_linenumber, value) AS rn
 FROM x LEFT JOIN f a ON a.filing_id=x.company_id AND a.accession_number=x.accn LEFT JOIN f p ON p.filing_id=x.company_id AND p.form_type=x.form_type AND p.period_of_report=x.period_end) WHERE rn=1""",
                           x=_FJ, f="SELECT o_orderkey AS filing_id, 'A'||lpad(o_orderkey::VARCHAR,10,'0') AS accession_number, CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN '10-K' ELSE '10-Q' END AS form_type, date_trunc('month', o_orderdate)::DATE AS period_of_report FROM orders"))
def src_facts_json(spark, d):
    li = t(spark, d, "lineitem").repartition("l_orderkey")  # an order's lines once together serve all three groupings
    n = F.col("l_linenumber")
    end = F.trunc("l_shipdate", "month")
    txt = lambda c: F.date_format(c, "yyyy-MM-dd")
    entry = F.struct(F.col("l_extendedprice").alias("val"), F.when(n % 2 == 0, txt(F.date_sub(end, 90))).alias("start"), txt(end).alias("end"),
                     F.lit("2001").alias("fy"), F.lit("q3").alias("fp"), F.when(n % 3 == 0, "10-K").otherwise("10-Q").alias("form"),
                     F.when(n % 4 == 0, F.concat(F.lit("A"), F.lpad(F.col("l_orderkey").cast("string"), 10, "0"))).alias("accn"))
    u = li.groupBy("l_orderkey", F.col("l_returnflag").alias("concept"), F.when(F.col("l_linestatus") == "O", "USD").otherwise("EUR").alias("unit")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), F.col("l_extendedprice").alias("p"), entry.alias("e")))), lambda x: x["e"]).alias("es"))
    c = u.groupBy("l_orderkey", "concept").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("unit", "es")))).alias("units"))
    p = c.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct(F.lit("L").alias("label"), "units")))).alias("m"))
    p = p.select(F.col("l_orderkey").alias("company_id"), F.to_json(F.struct(F.struct(F.col("m").alias("us-gaap")).alias("facts"))).alias("payload"))
    f = filing(spark, d).withColumn("company_id", F.col("filing_id")).withColumn("period_of_report", F.trunc("filed_at", "month"))
    return JP.company_facts(p, f).select("company_id", "concept", "unit", "period_start", "period_end", "form_type", "value", "filing_id")


# ---------------------------------------------------------------- SRC-06 JON-14 SET-01 PRJ-07 PRJ-10 STR-23 STR-14
@reg("src_form4_xml", """SELECT o_orderkey AS filing_id, 'Owner '||w.n AS insider_name, w.n=1 AS is_director, d.f AS is_derivative, o_orderdate::DATE AS transaction_date,
 CASE o_orderstatus WHEN 'F' THEN 'S' WHEN 'O' THEN 'P' ELSE 'X' END AS transaction_code, CASE o_orderstatus WHEN 'F' THEN 'open_market_sell' WHEN 'O' THEN 'open_market_buy'
  ELSE CASE WHEN d.f THEN 'derivative_other' ELSE 'other_acquisition' END END AS transaction_type_normalized, o_totalprice AS shares,
 CASE WHEN o_orderkey%3<>0 THEN 12.5::DOUBLE END AS price_per_share, CASE WHEN o_orderkey%2=0 THEN 'direct' ELSE 'indirect' END AS ownership_nature,
 lpad(o_custkey::VARCHAR,10,'0') AS cik FROM orders, (VALUES (1),(2)) w(n), (VALUES (false),(true)) d(f)""")
def src_form4_xml(spark, d):
    o, k = spread(t(spark, d, "orders"), "o_orderkey", rows=25_000), F.col("o_orderkey")
    code = F.when(F.col("o_orderstatus") == "F", "S").when(F.col("o_orderstatus") == "O", "p").otherwise("X")
    owner = lambda n: (f"<reportingOwner><reportingOwnerId><rptOwnerCik>{n}</rptOwnerCik><rptOwnerName>Owner {n}</rptOwnerName></reportingOwnerId>"
                       f"<reportingOwnerRelationship><isDirector>{'1' if n == 1 else '0'}</isDirector></reportingOwnerRelationship></reportingOwner>")
    price_x = F.when(k % 3 != 0, "<transactionPricePerShare><value>12.50</value></transactionPricePerShare>").otherwise("")
    tx = lambda tag: F.concat(F.lit(f"<{tag}><securityTitle><value>Common</value></securityTitle><transactionDate><value>"), F.date_format("o_orderdate", "yyyy-MM-dd"),
                              F.lit("</value></transactionDate><transactionCoding><transactionCode>"), code, F.lit("</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>"),
                              F.format_number("o_totalprice", 2), F.lit("</value></transactionShares>"), price_x,
                              F.lit("<transactionAcquiredDisposedCode><value>A</value></transactionAcquiredDisposedCode></transactionAmounts><ownershipNature><directOrIndirectOwnership><value>"),
                              F.when(k % 2 == 0, "D").otherwise("I"), F.lit(f"</value></directOrIndirectOwnership></ownershipNature></{tag}>"))
    xml = F.concat(F.lit('<?xml version="1.0"?><ownershipDocument><issuer><issuerCik>'), F.col("o_custkey").cast("string"), F.lit("</issuerCik></issuer>" + owner(1) + owner(2) + "<nonDerivativeTable>"),
                   tx("nonDerivativeTransaction"), F.lit("</nonDerivativeTable><derivativeTable>"), tx("derivativeTransaction"), F.lit("</derivativeTable></ownershipDocument>"))
    n = F.lit(None).cast("string")
    docs = o.select(k.alias("filing_id"), F.col("o_custkey").alias("company_id"), F.concat(F.lit("A"), k).alias("accession_number"), n.alias("cik"), n.alias("ticker"),
                    n.alias("issuer_name"), F.to_date("o_orderdate").alias("filed_at"), F.lit("4").alias("form_type"), n.alias("source_url"), xml.alias("xml"))
    return XP.insider_transactions(docs).select("filing_id", "insider_name", "is_director", "is_derivative", "transaction_date", "transaction_code",
                                                "transaction_type_normalized", "shares", "price_per_share", "ownership_nature", "cik")


# ---------------------------------------------------------------- SNK-01..03 SNK-06 SNK-07 SNK-14 WIN-10 JON-16 JON-17
def _price_rows(spark, d):
    return events(spark, d).select(F.col("user_id").alias("company_id"), F.to_date("ts").alias("trading_date"),
                                   F.col("event_type").alias("provider"), F.col("value").alias("close"), F.col("event_id").alias("position"), "ts")


_UP = dict(b1="SELECT user_id AS company_id, ts::DATE AS trading_date, event_type AS provider, arg_max(value, event_id) AS close FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1,2,3",
           b2="SELECT user_id AS company_id, ts::DATE AS trading_date, event_type AS provider, arg_max(value, event_id)*2 AS close FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1,2,3")


def _batches(spark, d):
    e = _price_rows(spark, d)
    key = U.KEYS["market_prices"]
    from ledgerlens.operators.dedupe import keep_last_in_batch
    old = keep_last_in_batch(e.where("ts < '2024-01-20'"), key, "position").select("company_id", "trading_date", "provider", "close")
    new = e.where("ts >= '2024-01-10'").withColumn("close", F.col("close") * 2)
    return old, new, key


@reg("upsert_latest", sql("SELECT company_id, trading_date, provider, coalesce(b2.close, b1.close) AS close FROM b1 FULL JOIN b2 USING (company_id, trading_date, provider)", **_UP))
def upsert_latest(spark, d):
    old, new, key = _batches(spark, d)
    return U.upsert(old, new, key, "position")


@reg("upsert_counts", sql("""SELECT (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-10') AS selected, (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-10') - count(*) AS deduped_in_batch,
 count(*) - count(b1.close) AS inserted, count(b1.close) AS updated, count(*) AS stored FROM b2 LEFT JOIN b1 USING (company_id, trading_date, provider)""", **_UP))
def upsert_counts(spark, d):
    old, new, key = _batches(spark, d)
    return U.upsert_summary(old, new, key, "position")


@reg("existing_in_range", sql("""SELECT b1.company_id, b1.trading_date, b1.provider FROM b1 JOIN (SELECT company_id, provider, min(trading_date) lo, max(trading_date) hi FROM b2 GROUP BY 1,2) r
 USING (company_id, provider) WHERE trading_date BETWEEN lo AND hi""", **_UP))
def existing_in_range(spark, d):
    old, new, key = _batches(spark, d)
    return U.existing_in_range(old, new, ["company_id", "provider"], "trading_date").select(*key)


# ---------------------------------------------------------------- SNK-04 SNK-05 STR-14 STR-22
@reg("upsert_nullsafe", sql("""SELECT accession_number, insider_cik, transaction_code, max(shares) AS shares, count(*) AS n FROM (
 SELECT accession_number, insider_cik, transaction_code, shares FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.accession_number=a.accession_number AND b.insider_cik IS NOT DISTINCT FROM a.insider_cik AND b.transaction_code=a.transaction_code)
 UNION ALL SELECT accession_number, insider_cik, transaction_code, shares FROM b) GROUP BY 1,2,3""", "v_trade",
    a="SELECT accession_number, insider_cik, transaction_code, arg_max(shares, transaction_id) AS shares FROM v_trade WHERE transaction_date < DATE '1999-01-01' GROUP BY 1,2,3",
    b="SELECT accession_number, insider_cik, transaction_code, arg_max(shares, transaction_id)+1 AS shares FROM v_trade WHERE transaction_date >= DATE '1998-01-01' GROUP BY 1,2,3"))
def upsert_nullsafe(spark, d):
    from ledgerlens.operators.dedupe import latest_per_key
    tr, key = trade(spark, d), ["accession_number", "insider_cik", "transaction_code"]
    cols = [*key, "shares"]
    old = latest_per_key(tr.where("transaction_date < DATE'1999-01-01'"), key, "transaction_id").select(*cols)
    new = tr.where("transaction_date >= DATE'1998-01-01'").withColumn("shares", F.col("shares") + 1)
    up = U.upsert(old, new, key, "transaction_id", null_safe=True)
    return up.groupBy(*key).agg(F.max("shares").alias("shares"), F.count(F.lit(1)).alias("n"))


@reg("upsert_insider", sql("""SELECT transaction_uid, transaction_id FROM (
 SELECT transaction_uid, transaction_id FROM a WHERE transaction_id NOT IN (SELECT transaction_id FROM b) UNION ALL SELECT transaction_uid, transaction_id FROM b)""", "v_trade",
    a="SELECT 'old'||transaction_id AS transaction_uid, transaction_id FROM v_trade WHERE transaction_date < DATE '1999-01-01'",
    b="SELECT CASE WHEN transaction_id%2=0 THEN 'old' ELSE 'new' END||transaction_id AS transaction_uid, transaction_id FROM v_trade WHERE transaction_date >= DATE '1998-01-01'"))
def upsert_insider(spark, d):
    tr, k = trade(spark, d), F.col("transaction_id")
    # the accession makes the business key of the stand-in unique
    tr = tr.withColumn("accession_number", F.concat("accession_number", F.lit("-"), k))
    old = tr.where("transaction_date < DATE'1999-01-01'").withColumn("transaction_uid", F.concat(F.lit("old"), k))
    new = tr.where("transaction_date >= DATE'1998-01-01'").withColumn(
        "transaction_uid", F.concat(F.when(k % 2 == 0, "old").otherwise("new"), k)).withColumn("position", k)
    return U.upsert_insider(old, new, "position").select("transaction_uid", "transaction_id")


@reg("transaction_uids", sql("SELECT transaction_id, sha1(accession_number||'|'||insider_name||'|'||coalesce(insider_cik,'')||'|'||transaction_date::VARCHAR||'|'||transaction_code) AS uid,"
                             " md5(accession_number||'|'||insider_name||'|'||coalesce(insider_cik,'')) AS legacy, transaction_date::VARCHAR||'|2' AS price_text FROM v_trade", "v_trade"))
def transaction_uids(spark, d):
    c = F.col
    return trade(spark, d).select("transaction_id", T.transaction_uid(T.UID_PARTS[:5]).alias("uid"),
                                  T.legacy_uid(c("accession_number"), c("insider_name"), c("insider_cik")).alias("legacy"),
                                  F.concat(c("transaction_date").cast("string"), F.lit("|"), T.number_text(F.lit(2.0))).alias("price_text"))


# ---------------------------------------------------------------- SNK-08 SNK-09 JON-15 DAT-04
@reg("upsert_company", sql("""SELECT cik, ticker, name, CASE WHEN is_active THEN 'new' ELSE sector END AS sic_description FROM v_company""", "v_company"))
def upsert_company(spark, d):
    c = company(spark, d)
    n = F.lit(None).cast("string")
    old = c.where(~F.col("is_active")).select("company_id", "cik", F.lit("OLD").alias("ticker"), F.lit("old").alias("name"), n.alias("sic_code"),
                                              F.col("sector").alias("sic_description"), n.alias("exchange"))
    meta = c.select("cik", F.lower("ticker").alias("ticker"), "name", n.alias("sic_code"), F.when(F.col("is_active"), "new").otherwise("").alias("sic_description"), n.alias("exchange"))
    return U.upsert_companies(old, meta).select("cik", "ticker", "name", "sic_description")


@reg("insert_filings", sql("""SELECT accession_number, min(filing_id) AS filing_id, any_value(y) AS fiscal_year, any_value(q) AS fiscal_quarter FROM (
 SELECT accession_number, filing_id, CASE WHEN filed_at >= DATE '1998-01-01' THEN year(period_of_report) END::INT AS y, CASE WHEN filed_at >= DATE '1998-01-01' THEN quarter(period_of_report) END::INT AS q FROM v_filing) GROUP BY 1""", "v_filing"))
def insert_filings(spark, d):
    f = filing(spark, d)
    cols = ["accession_number", "filing_id", "company_id", "filed_at", "period_of_report", "fiscal_year", "fiscal_quarter"]
    old = f.where("filed_at < DATE'1998-01-01'").select(*cols)
    new = f.withColumn("filing_id", F.col("filing_id"))
    return U.insert_filings_if_absent(old, new.select(*cols, F.col("filing_id").alias("position")), "position").select(
        "accession_number", "filing_id", "fiscal_year", "fiscal_quarter")


# ---------------------------------------------------------------- FIL-01 FIL-02 FIL-04 FIL-06 FIL-07 FIL-10 FIL-13 SRT-01 SRT-07
@reg("filters", sql("""SELECT company_id, filing_id FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY filed_at DESC, filing_id DESC) AS rn FROM v_filing
 JOIN v_company USING (company_id) WHERE form_type='10-K' AND filed_at <= DATE '2000-06-30' AND is_active AND NOT is_extracted AND name ILIKE '%customer%')""", "v_filing", "v_company"))
def filters(spark, d):
    f = filing(spark, d).where((F.col("filed_at") <= F.lit("2000-06-30").cast("date")) & ~F.col("is_extracted"))
    act = company(spark, d).where(F.col("is_active") & F.col("name").ilike("%customer%"))
    cols = [F.lit(False).alias(c) for c in ("is_xbrl_parsed", "is_embedded", "is_signal_scored")]
    f = f.join(act, "company_id", "left_semi").select("*", *cols)
    return R.filings(f, form_type="10-k").select("company_id", "filing_id")


@reg("pending", sql("SELECT filing_id FROM v_filing WHERE NOT is_extracted", "v_filing"))
def pending(spark, d):
    return R.pending(filing(spark, d), "is_extracted").select("filing_id")


# ---------------------------------------------------------------- PRJ-01..04 PRJ-08 PRJ-09 MTH-18 JSN-05 JSN-06
@reg("projections", sql("""SELECT filing_id, signal_name, CASE WHEN k=3 THEN 'watch' WHEN signal_value IS NULL THEN 'unknown' WHEN signal_value<.3 THEN 'low' WHEN signal_value<.5 THEN 'medium'
 WHEN signal_value<.75 THEN 'high' ELSE 'critical' END AS status, form_type, filed_at FROM v_signal JOIN v_filing USING (filing_id)""", "v_signal", "v_filing"))
def projections(spark, d):
    return R.signal_row(signal_table(spark, d), filing(spark, d)).select("filing_id", "signal_name", "status", "form_type", "filed_at")


@reg("detail_shapes", """SELECT event_id, CASE event_id%4 WHEN 0 THEN props WHEN 1 THEN '{"items":['||props||']}' ELSE '{}' END AS detail FROM events""")
def detail_shapes(spark, d):
    e = t(spark, d, "events")
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("["), "props", F.lit("]"))).when(k == 2, F.lit('"text"'))
    return e.select("event_id", J.detail_shape(raw).alias("detail"))


# ---------------------------------------------------------------- JON-05
@reg("update_from", sql("""SELECT t.transaction_id, coalesce(f.accession_number, t.accession_number) AS accession_number, c.name AS issuer_name FROM v_trade t
 LEFT JOIN v_filing f ON f.filing_id=t.transaction_id AND f.is_extracted LEFT JOIN v_company c ON c.company_id=t.company_id""", "v_trade", "v_filing", "v_company"))
def update_from(spark, d):
    f = filing(spark, d).where("is_extracted").select(F.col("filing_id").alias("transaction_id"), F.col("accession_number").alias("f_acc"))
    c = company(spark, d).select("company_id", F.col("name").alias("issuer_name"))
    return (trade(spark, d).join(f, "transaction_id", "left").join(c, "company_id", "left")
            .select("transaction_id", F.coalesce("f_acc", "accession_number").alias("accession_number"), "issuer_name"))


# ---------------------------------------------------------------- JON-01 JON-03 JON-04 QRY-06 QRY-07 SRT-02
@reg("signals_with_filings", sql("""SELECT company_id, filing_id, signal_name FROM (SELECT s.company_id, filing_id, signal_name, row_number() OVER (PARTITION BY s.company_id
 ORDER BY filed_at DESC, filing_id%1000 DESC, filing_id DESC, signal_name) AS rn FROM v_signal s JOIN v_filing f USING (filing_id) WHERE form_type='10-K')""", "v_signal", "v_filing"))
def signals_with_filings(spark, d):
    return R.signals(signal_table(spark, d), filing(spark, d), form_type="10-K").select("company_id", "filing_id", "signal_name")


@reg("signal_history", sql("""SELECT company_id, filing_id, accession_number, filed_at, round(signal_value,8)+0e0 AS signal_value FROM (SELECT s.company_id, filing_id, accession_number, filed_at, signal_value,
 row_number() OVER (PARTITION BY s.company_id ORDER BY filed_at, filing_id) AS rn FROM v_signal s JOIN v_filing f USING (filing_id) WHERE signal_name='rlds')""", "v_signal", "v_filing"))
def signal_history(spark, d):
    s = signal_table(spark, d).where("signal_name = 'rlds'").withColumn("signal_name", F.lit("composite_filing_risk"))
    return R.signal_history(s, filing(spark, d)).select("company_id", "filing_id", "accession_number", "filed_at", r8(F.col("signal_value")).alias("signal_value"))


# ---------------------------------------------------------------- JON-02 QRY-09 QRY-10 SRT-08
@reg("embedding_rows", sql("""SELECT filing_id, chunk_idx, 64 AS dimension FROM v_vec WHERE filing_id IN (SELECT arg_max(filing_id, (filing_id)) FROM (SELECT DISTINCT filing_id FROM v_vec) GROUP BY filing_id//4)""", "v_vec"))
def embedding_rows(spark, d):
    v = vectors(spark, d).select("filing_id", "chunk_idx", "embedding", F.col("filing_id").alias("filing_section_id"), (F.floor(F.col("filing_id") / 4)).alias("company_id"),
                                 F.lit("t").alias("text"), F.lit("p").alias("provider"), F.lit("m").alias("embedding_model"))
    ids = v.select("filing_id", "company_id").distinct()
    f = ids.select("filing_id", "company_id", F.lit("10-K").alias("form_type"), F.lit("2024-01-01").cast("date").alias("filed_at"), F.lit("A").alias("accession_number"))
    s = ids.select(F.col("filing_id").alias("section_id"), F.lit("mda").alias("section"), F.lit(0).alias("sequence_idx"))
    return R.latest_embeddings(v, f, s, include_vector=True).select("filing_id", "chunk_idx", "dimension")


# ---------------------------------------------------------------- JON-18 QRY-03 STR-01
_IDS = """SELECT c_custkey::VARCHAR AS identifier FROM customer UNION SELECT '  t'||c_custkey||' ' FROM customer UNION SELECT lower(c_name) FROM customer
 UNION SELECT substr(c_name, 12) FROM customer UNION SELECT 'zz'||c_custkey FROM customer UNION SELECT '#00000'||(c_custkey//10) FROM customer"""


@reg("resolve_identity", sql("""SELECT identifier, coalesce(exact_id, CASE WHEN n=1 THEN part_id END) AS company_id, CASE WHEN exact_id IS NOT NULL OR n=1 THEN 'ok' WHEN n>1 THEN 'ambiguous' ELSE 'not_found' END AS status,
 CASE WHEN exact_id IS NULL AND n>1 THEN array_to_string(list_sort(names[1:2]),'|') END AS candidates FROM (
 SELECT x.identifier, x.exact_id, count(c.company_id) AS n, min(c.company_id) AS part_id, list(c.name ORDER BY c.name) AS names FROM ex x LEFT JOIN v_company c ON x.exact_id IS NULL AND c.name ILIKE '%'||x.i||'%' GROUP BY 1,2)""",
    "v_company", ids=_IDS, ex="""SELECT identifier, i, coalesce(a.company_id, b.company_id, n.company_id) AS exact_id FROM (SELECT identifier, trim(identifier) AS i FROM ids) x
      LEFT JOIN v_company a ON regexp_full_match(i,'[0-9]+') AND a.cik=CASE WHEN length(i)>=10 THEN i ELSE lpad(i,10,'0') END LEFT JOIN v_company b ON b.ticker=upper(i) LEFT JOIN v_company n ON lower(n.name)=lower(i)"""))
def resolve_identity(spark, d):
    c = t(spark, d, "customer")
    k, n = F.col("c_custkey"), F.col("c_name")
    ids = c.select(F.explode(F.array(k.cast("string"), F.concat(F.lit("  t"), k, F.lit(" ")), F.lower(n), F.substr(n, F.lit(12)), F.concat(F.lit("zz"), k),
                                     F.concat(F.lit("#00000"), F.floor(k / 10)))).alias("identifier"))
    return R.resolve(ids, company(spark, d))


# ---------------------------------------------------------------- QRY-01 QRY-02 QRY-08
@reg("lookups", sql("""SELECT kind, value FROM (SELECT 'name' AS kind, name AS value FROM (SELECT name FROM v_company WHERE is_active)
 UNION ALL SELECT 'ticker', ticker FROM (SELECT ticker FROM v_company))""", "v_company"))
def lookups(spark, d):
    c = company(spark, d)
    a = R.companies(c, active_only=True).select(F.lit("name").alias("kind"), F.col("name").alias("value"))
    return a.unionByName(R.tickers(c).select(F.lit("ticker").alias("kind"), F.col("ticker").alias("value")))


# ---------------------------------------------------------------- QRY-04 QRY-05 DAT-09
_CPT = {"revenue": "R", "net_income": "N", "total_debt": "A"}


@reg("score_snapshot", sql("""SELECT c.company_id, an.id AS latest_annual_filing_id, qu.id AS latest_quarterly_filing_id, round(sc.v,8)+0e0 AS composite_risk_score,
 CASE WHEN sc.v IS NULL THEN 'UNKNOWN' WHEN sc.v<.3 THEN 'LOW' WHEN sc.v<.5 THEN 'MEDIUM' WHEN sc.v<.75 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_label,
 pr.price AS price_close, fx.revenue, coalesce(tr.n,0) AS total_transactions, greatest(DATE '2024-03-01' - greatest(an.d, qu.d), 0)::INT AS filings_days_old, nw.n5 AS news_count, round(nw.s1,8)+0e0 AS news_sentiment_score
FROM v_company c
LEFT JOIN (SELECT company_id, arg_max(filing_id,(filed_at,filing_id)) AS id, max(filed_at) AS d FROM v_filing WHERE form_type='10-K' GROUP BY 1) an USING (company_id)
LEFT JOIN (SELECT company_id, arg_max(filing_id,(filed_at,filing_id)) AS id, max(filed_at) AS d FROM v_filing WHERE form_type='10-Q' GROUP BY 1) qu USING (company_id)
LEFT JOIN (SELECT company_id, arg_max(coalesce(signal_value,-1),(filing_id%1000, filed_at, filing_id)) AS v0, nullif(arg_max(coalesce(signal_value,-1),(filing_id%1000, filed_at, filing_id)),-1) AS v FROM v_signal JOIN v_filing USING (filing_id, company_id) WHERE signal_name='rlds' GROUP BY 1) sc USING (company_id)
LEFT JOIN (SELECT company_id, arg_max(price,(trading_date,price_id)) AS price FROM v_price GROUP BY 1) pr USING (company_id)
LEFT JOIN (SELECT company_id, arg_min(value,(fact_id*-1)) FILTER (concept='R') AS revenue FROM (SELECT x.*, f.company_id, max(x.period_end) OVER (PARTITION BY f.company_id) AS mx FROM v_fact x JOIN v_filing f USING (filing_id)) WHERE period_end=mx GROUP BY 1) fx USING (company_id)
LEFT JOIN (SELECT company_id, count(*) AS n FROM v_trade GROUP BY 1) tr USING (company_id)
LEFT JOIN (SELECT company_id, least(count(*),5)::INT AS n5, nullif(arg_max(coalesce(raw_score,-99),(published_at,news_id)),-99) AS s1 FROM v_news GROUP BY 1) nw USING (company_id)""",
                           "v_company", "v_filing", "v_signal", "v_price", "v_fact", "v_trade", "v_news"))
def score_snapshot(spark, d):
    f = filing(spark, d)
    facts = fact(spark, d).join(f.select("filing_id", "company_id"), "filing_id").withColumn("created_at", F.timestamp_seconds(F.lit(0)))
    first = {v: P.FACT_ALIASES[P.SUMMARY_FACTS[k]][0] for k, v in _CPT.items()}  # stand-in concepts under their real names
    renamed = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])
    facts = facts.withColumn("concept", renamed[F.col("concept")])
    sig = signal_table(spark, d).withColumn("signal_name", F.when(F.col("signal_name") == "rlds", "nci_global").otherwise(F.col("signal_name")))
    px = price(spark, d).withColumn("close", F.col("price")).withColumn("volume", F.lit(None).cast("bigint"))
    nw = news(spark, d).withColumn("sentiment_score", J.number_at(J.variant(F.col("raw_json")), "$.sentiment_score"))
    s = R.score_snapshot(company(spark, d), f, sig, facts, trade(spark, d), px, nw, F.lit("2024-03-01").cast("date"))
    return s.select("company_id", "latest_annual_filing_id", "latest_quarterly_filing_id", r8(F.col("composite_risk_score")).alias("composite_risk_score"), "risk_label", "price_close",
                    "revenue", "total_transactions", "filings_days_old", F.when(F.col("recent_news").isNotNull(), F.size("recent_news")).alias("news_count"),
                    r8(F.col("news_sentiment_score")).alias("news_sentiment_score"))


# ---------------------------------------------------------------- STM-02 (the batch plan of the stream)
@reg("news_volume", """SELECT user_id AS company_id, (DATE '1970-01-01' + (d - o.i)::INT)::TIMESTAMP AS window_start, count(*) AS articles
 FROM (SELECT user_id, date_diff('day', DATE '1970-01-01', ts::DATE) AS d FROM events), (SELECT unnest(range(0,7)) AS i) o GROUP BY 1,2""")
def news_volume(spark, d):
    from ledgerlens.streaming.incremental import news_volume as volume
    v = volume(news(spark, d))
    return v.select("company_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "articles")


# ---------------------------------------------------------------- STR-10 STR-15 STR-16 STR-17 FIL-12 DAT-02
@reg("filing_scalars", """SELECT o_orderkey AS k,
 round(CASE WHEN o_orderkey%3=0 THEN -1 ELSE 1 END * CASE WHEN o_orderkey%5=0 THEN -1 ELSE 1 END * o_totalprice * CASE WHEN o_orderkey%2=0 THEN 1000 ELSE 1 END, 2)+0e0 AS figure,
 ['USD','shares','pure'][o_orderkey%3+1] AS unit, o_custkey||'/10-K_A/'||o_orderkey||'.txt' AS key_text, 'Order - '||o_orderkey AS head,
 CASE WHEN o_orderkey%2=0 THEN o_orderpriority ELSE 'Desk' END AS publisher, o_orderkey%4<2 AS is_xml,
 epoch(o_orderdate::DATE::TIMESTAMP)::BIGINT + (o_orderkey%86400) - CASE o_orderkey%3 WHEN 1 THEN 7200 ELSE 0 END AS published FROM orders""")
def filing_scalars(spark, d):
    k, price = F.col("o_orderkey"), F.format_number("o_totalprice", 2)
    text = F.when(k % 3 == 0, F.concat(F.lit("("), price, F.lit(")"))).otherwise(F.concat(F.lit(" $"), price))
    unit = F.element_at(F.array(F.lit("{http://fasb.org}USD"), F.lit("xbrli:shares"), F.lit(" pure ")), (k % 3 + 1).cast("int"))
    source = F.when(k % 2 == 0, F.col("o_orderpriority")).otherwise(F.lit(" "))
    head, publisher = T.headline_and_publisher(F.concat(F.lit("Order - "), k, F.when(k % 2 == 0, F.lit("")).otherwise(" - Desk")), source)
    xml = F.element_at(F.array(F.lit("\n <?xml version='1.0'?><a/>"), F.concat(F.lpad(k.cast("string"), 700, " "), F.lit("<ownershipDocument>")),
                               F.lit("<html>"), F.lit("a <?xml ?>")), (k % 4 + 1).cast("int"))
    at = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + k % 86400)
    stamp = (F.when(k % 3 == 0, F.concat(F.date_format(at, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT")))
             .when(k % 3 == 1, F.concat(F.date_format(at, "d MMM yyyy HH:mm:ss"), F.lit(" +0200"))).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")))
    return t(spark, d, "orders").select(
        k.alias("k"), F.round(T.tagged_number(text, F.when(k % 5 == 0, F.lit("-")), F.when(k % 2 == 0, F.lit("3"))), 2).alias("figure"),
        T.unit_token(unit).alias("unit"), T.storage_key(F.col("o_custkey").cast("string"), F.lit("10-K/A"), k.cast("string")).alias("key_text"),
        head.alias("head"), publisher.alias("publisher"), T.looks_like_ownership_xml(xml).alias("is_xml"),
        F.unix_timestamp(D.parse_timestamp(stamp)).alias("published"))


# ---------------------------------------------------------------- SIG-19 SRC-11 SNK-16
@reg("price_counts", sql("""SELECT company_id, price_id, count(price) OVER (PARTITION BY company_id ORDER BY trading_date, price_id) AS price_count FROM v_price WHERE price IS NOT NULL""", "v_price"))
def price_counts(spark, d):
    from ledgerlens.plans import market_signals as MS
    return MS.price_counts(price(spark, d)).select("company_id", "price_id", "price_count")


@reg("ranked_documents", """SELECT b::VARCHAR AS accession_number, i::INTEGER AS rank, doc AS document FROM (SELECT b, unnest(docs) AS doc, unnest(range(0, len(docs))) AS i FROM (
 SELECT b, list_concat(list_concat(CASE WHEN b%3=0 THEN ['p'||b||'.xml'] ELSE [] END, list_concat(list(n ORDER BY o_orderkey) FILTER (liked), list(n ORDER BY o_orderkey) FILTER (other))), CASE WHEN b%3=1 THEN ['p'||b||'.htm'] ELSE [] END) AS docs
 FROM (SELECT o_orderkey//20 AS b, o_orderkey, CASE o_orderkey%4 WHEN 0 THEN 'd/ownership'||o_orderkey||'.xml' WHEN 1 THEN 'x'||o_orderkey||'.XML' WHEN 2 THEN 'form4-'||o_orderkey||'.txt' ELSE 'doc4_'||o_orderkey||'.xml' END AS n,
  o_orderkey%4 IN (0,3) AS liked, o_orderkey%4=1 AS other FROM orders) GROUP BY b))""")
def ranked_documents(spark, d):
    k = F.col("o_orderkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("d/ownership"), k, F.lit(".xml"))).when(k % 4 == 1, F.concat(F.lit("x"), k, F.lit(".XML"))).when(
        k % 4 == 2, F.concat(F.lit("form4-"), k, F.lit(".txt"))).otherwise(F.concat(F.lit("doc4_"), k, F.lit(".xml")))
    b = F.floor(k / 20)
    g = t(spark, d, "orders").groupBy(b.alias("b")).agg(sorted_array("o_orderkey", F.struct(name.alias("name"))).alias("item"))
    primary = F.when(F.col("b") % 3 == 0, F.concat(F.lit("p"), "b", F.lit(".xml"))).when(F.col("b") % 3 == 1, F.concat(F.lit("p"), "b", F.lit(".htm")))
    p = g.select(F.col("b").cast("string").alias("accession_number"), primary.alias("primary_document"), F.to_json(F.struct(F.struct("item").alias("directory"))).alias("payload"))
    return JP.ranked_xml_documents(p).select("accession_number", "rank", "document")
