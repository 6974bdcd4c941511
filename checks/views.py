"""The reference tables seen through the driver's tables: the same mapping once for Spark
and once as SQL. Everything reads whole tables."""
from pyspark.sql import functions as F

from ledgerlens.session import spread

SIGNALS = ("rlds", "mda_drift", "forward_pessimism", "fundamental_deterioration", "balance_sheet_stress",
           "revenue_growth_deceleration", "earnings_quality", "numeric_anomaly", "insider_signal", "market_signal",
           "sentiment_signal")


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark, d):
    return spread(t(spark, d, "documents"), "doc_id")


def pages(spark, d):
    return spread(t(spark, d, "pages"), "page_id")


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


def r8(c):
    return F.round(c, 8) + F.lit(0.0)


def events(spark, d):
    return t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def company(spark, d):
    return t(spark, d, "customer").select(
        F.col("c_custkey").alias("company_id"), F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"),
        F.concat(F.lit("T"), F.col("c_custkey")).alias("ticker"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("sector"), (F.col("c_acctbal") >= 0).alias("is_active"))


def filing(spark, d):
    day = F.to_date("o_orderdate")
    return t(spark, d, "orders").select(
        F.col("o_orderkey").alias("filing_id"), F.col("o_custkey").alias("company_id"),
        F.concat(F.lit("A"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("accession_number"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "10-K").otherwise("10-Q").alias("form_type"),
        day.alias("filed_at"), F.date_sub(day, 31).alias("period_of_report"),
        F.lit(None).cast("int").alias("fiscal_year"), F.lit(None).cast("int").alias("fiscal_quarter"),
        (F.col("o_orderstatus") == "F").alias("is_extracted"), F.col("o_orderstatus").alias("processing_status"),
        F.col("o_totalprice").alias("amount"))


def fact(spark, d):
    f = t(spark, d, "lineitem")
    end = F.to_date("l_shipdate")
    return f.select(
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("fact_id"), F.col("l_orderkey").alias("filing_id"),
        F.col("l_returnflag").alias("concept"), F.when(F.col("l_linestatus") == "O", "USD").otherwise("EUR").alias("unit"),
        F.col("l_extendedprice").alias("value"), end.alias("period_end"),
        F.date_sub(end, (F.col("l_quantity") * 8).cast("int")).alias("period_start"))


def metric(spark, d):
    """Filings with raw canonical facts; filings without lines have none."""
    li = t(spark, d, "lineitem")
    p, x, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    g = li.groupBy(F.col("l_orderkey").alias("filing_id")).agg(
        F.sum(p).alias("revenue"), F.sum(p * (1 - x)).alias("gross_profit"),
        F.sum(p * (1 - x - tax)).alias("operating_income"), F.sum(p * tax).alias("long_term_debt"),
        F.sum(p * x).alias("cash"), F.sum("l_quantity").alias("shares_outstanding"), F.count(F.lit(1)).alias("lines"))
    j = filing(spark, d).join(g, "filing_id", "left")
    j = j.withColumn("net_income", F.col("gross_profit") - F.col("amount"))
    return (j.withColumn("assets", F.col("amount")).withColumn("liabilities", F.lit(None).cast("double"))
            .withColumn("equity", F.when(F.col("lines") != 3, F.col("amount") * 0.5))
            .withColumn("operating_cash_flow", F.when(F.col("lines") != 5, F.col("operating_income") - F.col("cash"))))


def trade(spark, d):
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    title = (F.when(F.col("c_mktsegment") == "AUTOMOBILE", "Chief Executive Officer")
             .when(F.col("c_mktsegment") == "BUILDING", "EVP and CFO")
             .when(F.col("c_mktsegment") == "FURNITURE", "President")
             .when(F.col("c_mktsegment") == "HOUSEHOLD", "Senior Vice President"))
    code = F.when(F.col("o_orderstatus") == "F", "S").when(F.col("o_orderstatus") == "O", "P").otherwise("A")
    return o.select(
        k.alias("transaction_id"), F.floor(F.col("o_custkey") / 10).alias("company_id"),
        F.concat(F.lit("A"), F.floor(k / 3)).alias("accession_number"),
        F.concat(F.lit("Insider "), F.col("o_custkey")).alias("insider_name"),
        F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("string")).alias("insider_cik"),
        title.alias("officer_title"), (F.col("c_mktsegment") == "MACHINERY").alias("is_director"),
        day.alias("transaction_date"), code.alias("transaction_code"),
        F.when(code == "S", "open_market_sell").when(code == "P", "open_market_buy").otherwise("equity_award")
        .alias("transaction_type_normalized"),
        F.col("o_totalprice").alias("shares"), F.when(k % 5 != 0, F.lit(2.0)).alias("price_per_share"),
        F.when(k % 4 != 0, F.col("o_totalprice") * 2).alias("transaction_value"),
        F.lit("direct").alias("ownership_nature"), F.when(code == "S", "D").otherwise("A").alias("acquired_disposed_code"),
        F.lit(False).alias("is_derivative"), F.lit("").alias("security_title"),
        F.when(k % 11 != 0, F.date_add(day, (k % 7).cast("int"))).alias("filed_at"))


def trade_filing(spark, d):
    """Filings of the same companies the trades belong to."""
    return filing(spark, d).withColumn("company_id", F.floor(F.col("company_id") / 10))


def price(spark, d):
    return events(spark, d).select(F.col("user_id").alias("company_id"), F.col("event_id").alias("price_id"),
                                   F.to_date("ts").alias("trading_date"), F.col("value").alias("price"))


def news(spark, d):
    e = F.col("event_id")
    label = (F.when(F.col("event_type") == "click", "positive").when(F.col("event_type") == "error", "Negative ")
             .when(F.col("event_type") == "view", "neutral").when(F.col("event_type") == "purchase", "bullish"))
    score = F.round((F.col("value") - 50) / 50, 4)
    return events(spark, d).select(
        F.col("user_id").alias("company_id"), e.alias("news_id"), F.col("ts").alias("published_at"),
        label.alias("sentiment_label"), F.concat(F.lit("Headline "), e).alias("headline"),
        F.lit(None).cast("string").alias("publisher"), F.col("event_type").alias("source_name"),
        F.when(e % 3 != 0, F.concat(F.lit('{"sentiment_score": '), score.cast("string"), F.lit("}"))).alias("raw_json"),
        F.col("value").alias("value"))


def event_filing(spark, d):
    """Filings dated inside the event month, of the companies that have events among others."""
    f = filing(spark, d)
    return f.withColumn("filed_at", F.expr("date_add(DATE'2024-01-03', cast(filing_id % 30 as int))"))


def signal(spark, d, keep=None):
    """Eleven signals per filing, a fifth of them missing. `keep` may join columns to the filings: one row each, not eleven."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("filing_id"), F.col("o_custkey").alias("company_id"))
    o = keep(o) if keep else o
    names = F.array(*[F.struct(F.lit(n).alias("signal_name"), F.lit(i + 1).alias("k")) for i, n in enumerate(SIGNALS)])
    s = o.select("*", F.explode(names).alias("s")).select(*o.columns, "s.*")
    k = F.col("k")
    return s.withColumn("signal_value", F.when((F.col("filing_id") + k) % 5 != 0, (F.col("filing_id") * k) % 97 / 96.7)
                        ).withColumn("confidence", ((F.col("filing_id") + k) % 10) / 10.0)


def signal_table(spark, d):
    s = signal(spark, d)
    return s.select("filing_id", "company_id", "signal_name", "signal_value",
                    F.to_json(F.struct("confidence", F.when(F.col("k") == 3, "watch").alias("label"))).alias("detail"),
                    F.timestamp_seconds(F.lit(1704067200) + F.col("filing_id") % 1000).alias("computed_at"))


def vectors(spark, d):
    """Twenty chunks per filing."""
    return t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("filing_id"),
                                            (F.col("vec_id") % 20).alias("chunk_idx"), "embedding")


SQL = {
    "v_company": """SELECT c_custkey AS company_id, lpad(c_custkey::VARCHAR,10,'0') AS cik, 'T'||c_custkey AS ticker,
        c_name AS name, c_mktsegment AS sector, c_acctbal >= 0 AS is_active FROM customer""",
    "v_filing": """SELECT o_orderkey AS filing_id, o_custkey AS company_id, 'A'||lpad(o_orderkey::VARCHAR,10,'0') AS accession_number,
        CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN '10-K' ELSE '10-Q' END AS form_type,
        o_orderdate::DATE AS filed_at, (o_orderdate::DATE - 31) AS period_of_report, NULL::INT AS fiscal_year,
        NULL::INT AS fiscal_quarter, o_orderstatus='F' AS is_extracted, o_orderstatus AS processing_status,
        o_totalprice AS amount FROM orders""",
    "v_fact": """SELECT round(l_extendedprice*100)::BIGINT AS fact_id, l_orderkey AS filing_id, l_returnflag AS concept,
        CASE WHEN l_linestatus='O' THEN 'USD' ELSE 'EUR' END AS unit, l_extendedprice AS value,
        l_shipdate::DATE AS period_end, l_shipdate::DATE - (l_quantity*8)::INT AS period_start FROM lineitem""",
    "v_lines": """SELECT l_orderkey AS filing_id, sum(l_extendedprice) AS revenue,
        sum(l_extendedprice*(1-l_discount)) AS gross_profit, sum(l_extendedprice*(1-l_discount-l_tax)) AS operating_income,
        sum(l_extendedprice*l_tax) AS long_term_debt, sum(l_extendedprice*l_discount) AS cash,
        sum(l_quantity) AS shares_outstanding, count(*) AS lines FROM lineitem GROUP BY 1""",
    "v_metric": """SELECT f.*, l.revenue, l.gross_profit, l.operating_income, l.long_term_debt, l.cash, l.shares_outstanding,
        l.lines, l.gross_profit - f.amount AS net_income, f.amount AS assets,
        CASE WHEN l.lines <> 3 THEN f.amount*0.5 END AS equity,
        CASE WHEN l.lines <> 5 THEN l.operating_income - l.cash END AS operating_cash_flow
        FROM v_filing f LEFT JOIN v_lines l USING (filing_id)""",
    "v_trade": """SELECT o_orderkey AS transaction_id, o_custkey//10 AS company_id, 'A'||(o_orderkey//3) AS accession_number,
        'Insider '||o_custkey AS insider_name, CASE WHEN o_custkey%2=0 THEN o_custkey::VARCHAR END AS insider_cik,
        CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Chief Executive Officer' WHEN 'BUILDING' THEN 'EVP and CFO'
          WHEN 'FURNITURE' THEN 'President' WHEN 'HOUSEHOLD' THEN 'Senior Vice President' END AS officer_title,
        c_mktsegment='MACHINERY' AS is_director, o_orderdate::DATE AS transaction_date,
        CASE o_orderstatus WHEN 'F' THEN 'S' WHEN 'O' THEN 'P' ELSE 'A' END AS transaction_code,
        CASE o_orderstatus WHEN 'F' THEN 'open_market_sell' WHEN 'O' THEN 'open_market_buy' ELSE 'equity_award' END
          AS transaction_type_normalized,
        o_totalprice AS shares, CASE WHEN o_orderkey%5<>0 THEN 2.0::DOUBLE END AS price_per_share,
        CASE WHEN o_orderkey%4<>0 THEN o_totalprice*2 END AS transaction_value, 'direct' AS ownership_nature,
        CASE o_orderstatus WHEN 'F' THEN 'D' ELSE 'A' END AS acquired_disposed_code, FALSE AS is_derivative,
        '' AS security_title,
        CASE WHEN o_orderkey%11<>0 THEN o_orderdate::DATE + (o_orderkey%7)::INT END AS filed_at
        FROM orders JOIN customer ON o_custkey=c_custkey""",
    "v_trade_filing": "SELECT * REPLACE (company_id//10 AS company_id) FROM v_filing",
    "v_price": """SELECT user_id AS company_id, event_id AS price_id, ts::DATE AS trading_date, value AS price FROM events""",
    "v_news": """SELECT user_id AS company_id, event_id AS news_id, ts AS published_at,
        CASE event_type WHEN 'click' THEN 'positive' WHEN 'error' THEN 'Negative ' WHEN 'view' THEN 'neutral'
          WHEN 'purchase' THEN 'bullish' END AS sentiment_label,
        'Headline '||event_id AS headline, NULL::VARCHAR AS publisher, event_type AS source_name,
        CASE WHEN event_id%3<>0 THEN round((value-50)/50,4) END AS raw_score, value,
        CASE WHEN event_id%3<>0 THEN greatest(-1.0,least(1.0,round((value-50)/50,4)))
          ELSE CASE event_type WHEN 'click' THEN 0.5 WHEN 'error' THEN -0.5 WHEN 'view' THEN 0.0 WHEN 'purchase' THEN 0.5 END
          END::DOUBLE AS score FROM events""",
    "v_event_filing": "SELECT * REPLACE (DATE '2024-01-03' + (filing_id%30)::INT AS filed_at) FROM v_filing",
    "v_signal": "SELECT o_orderkey AS filing_id, o_custkey AS company_id, n.signal_name, n.k,"
        " CASE WHEN (o_orderkey+k)%5<>0 THEN ((o_orderkey*k)%97)/96.7::DOUBLE END AS signal_value,"
        " ((o_orderkey+k)%10)/10.0::DOUBLE AS confidence FROM orders, (VALUES "
        + ",".join(f"('{n}',{i+1})" for i, n in enumerate(SIGNALS)) + ") n(signal_name,k)",
    "v_vec": "SELECT vec_id//20 AS filing_id, vec_id%20 AS chunk_idx, embedding FROM embeddings",
}
_NEEDS = {"v_metric": ("v_filing", "v_lines"), "v_trade_filing": ("v_filing",), "v_event_filing": ("v_filing",)}


def sql(body, *views, **extra):
    """WITH the named views (and extra CTEs, in order) in front of the body."""
    order = []

    def add(v):
        for n in _NEEDS.get(v, ()):
            add(n)
        if v not in order:
            order.append(v)
    for v in views:
        add(v)
    ctes = [f"{v} AS ({SQL[v]})" for v in order] + [f"{k} AS ({v})" for k, v in extra.items()]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
