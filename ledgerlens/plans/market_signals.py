"""Market layer: momentum, volatility and sector-relative valuation, per filing."""
from pyspark.sql import DataFrame, Window, functions as F

from ledgerlens import policies as P
from ledgerlens.functions import scoring as S
from ledgerlens.operators import aggregates as A, ordered as O
from ledgerlens.plans.rows import signal_rows

VERSION = "market_v1"


def row_price():
    return F.coalesce("adjusted_close", "close").cast("double")


def daily_prices(prices: DataFrame) -> DataFrame:
    """(company, day): price of the day's last row (highest id). One row per calendar day is the
    proven bound that lets the look-back windows below run per company unsegmented."""
    return (prices.where(F.col("price").isNotNull()).groupBy("company_id", "trading_date")
            .agg(F.max_by("price", "price_id").alias("price")))


def momentum(daily: DataFrame) -> DataFrame:
    """Per price day the look-back returns and the momentum risk."""
    w = Window.partitionBy("company_id").orderBy(F.unix_date("trading_date"))
    d = daily.withColumns({f"__p{n}": F.last("price").over(w.rangeBetween(Window.unboundedPreceding, -n))
                           for n, _, _ in P.MOMENTUM_WINDOWS})
    ret = {name: F.when(F.col(f"__p{n}") > 0, (F.col("price") - F.col(f"__p{n}")) / F.col(f"__p{n}"))
           for n, _, name in P.MOMENTUM_WINDOWS}
    d = d.withColumns(ret)
    neg = S.sum_cols([F.when(F.col(name) < 0, F.abs(name) * wgt).otherwise(F.lit(0.0))
                      for _, wgt, name in P.MOMENTUM_WINDOWS])
    some = F.coalesce(*[F.col(name) for _, _, name in P.MOMENTUM_WINDOWS]).isNotNull()
    return (d.withColumn("price_momentum_risk", F.when(some & (F.col("price") > 0), S.clip01(neg / 0.40)))
            .drop(*[f"__p{n}" for n, _, _ in P.MOMENTUM_WINDOWS]))


def daily_returns(prices: DataFrame, hot_rows=O.AUTO) -> DataFrame:
    """Row-to-row returns in (date, id) order; rows after a non-positive price have none."""
    order = O.Order.by_day("trading_date", "price_id")
    d = O.lagged(prices.where(F.col("price").isNotNull()), ["company_id"], order, {"__prev": ("price", 1)}, hot_rows)
    return (d.where(F.col("__prev") > 0)
            .withColumn("ret", (F.col("price") - F.col("__prev")) / F.col("__prev")).drop("__prev"))


def volatility(returns: DataFrame, hot_rows=O.AUTO) -> DataFrame:
    """Per return row the annualised deviation of the last 30 and the last 180 returns."""
    order = O.Order.by_day("trading_date", "price_id")
    year = F.sqrt(F.lit(252.0))

    def frames(w):
        recent, base = w.rowsBetween(1 - P.VOL_RECENT, 0), w.rowsBetween(1 - P.VOL_BASE, 0)
        return {"__n": F.count("ret").over(recent), "__v30": F.stddev_pop("ret").over(recent) * year,
                "__v180": F.stddev_pop("ret").over(base) * year}
    s = O.trailing(returns, ["company_id"], order, P.VOL_BASE - 1, frames, hot_rows)
    enough = F.col("__n") >= P.VOL_RECENT
    out = s.withColumns({"rolling_vol_30d": F.when(enough, F.col("__v30")),
                                 "rolling_vol_180d": F.when(enough, F.col("__v180"))})
    ratio = F.try_divide(F.col("rolling_vol_30d"), F.col("rolling_vol_180d"))
    return out.withColumn("volatility_spike", S.clip01((ratio - 1.0) / 1.5)).drop("__n", "__v30", "__v180")


def price_counts(prices, hot_rows=O.AUTO):
    """Price rows up to each row."""
    order = O.Order.by_day("trading_date", "price_id")
    d = O.running(prices.where(F.col("price").isNotNull()), ["company_id"], order, {"price_count": F.lit(1)}, inclusive=True, hot_rows=hot_rows)
    return d.withColumn("price_count", F.col("price_count").cast("bigint"))


def valuation(anchors: DataFrame, companies: DataFrame, filings_with_income: DataFrame, prices: DataFrame,
              hot_rows=O.AUTO) -> DataFrame:
    """Sector-relative price to earnings for each (company, filed_at) of `anchors`.

    Every company of a sector is valued once per anchor day of that sector (day x company
    rows, never company pairs): as-of price, as-of latest filing. The peers' median comes
    from middle order statistics, see `median_excluding_self`.
    anchors: company_id, filed_at, price (its own latest non-NULL price).
    filings_with_income: anchor-form filings with net_income (annualised), shares_outstanding.
    """
    sectors = companies.where(F.coalesce(F.col("sector"), F.lit("")) != "").select("company_id", "sector")
    own = anchors.join(sectors, "company_id")
    days = own.select("sector", "filed_at").distinct()
    grid = days.join(sectors, "sector")  # each sector day meets each company of the sector once
    fin = filings_with_income.where(F.col("form_type").isin(*P.ANCHOR_FORMS))
    latest = lambda df: O.asof(df, fin, ["company_id"], "filed_at", "filed_at", "filing_id",
                               ["net_income", "shares_outstanding"], hot_rows=hot_rows)
    grid = latest(grid).withColumnRenamed("asof", "fin")
    # the last price row counts even when it holds no price
    last_row = prices.groupBy("company_id", "trading_date").agg(
        F.max_by("price", "price_id").alias("price"))
    grid = O.asof(grid, last_row, ["company_id"], "filed_at", "trading_date", F.lit(0), ["price"], hot_rows=hot_rows)
    pe = S.price_earnings(F.col("asof.price"), F.col("fin.shares_outstanding"), F.col("fin.net_income"))
    grid = grid.select("sector", "filed_at", "company_id", pe.alias("pe"), "fin")
    # a sector day holds one row per company of the sector, so the company table tells whether any is hot
    peers = A.median_excluding_self(grid, ["sector", "filed_at"], "company_id", "pe",
                                    hot_rows=O.hot_limit(sectors, ["sector"]))
    j = own.join(peers, ["sector", "filed_at", "company_id"])
    cur = S.price_earnings(F.col("price"), F.col("fin.shares_outstanding"), F.col("fin.net_income"))
    ratio = F.when((F.col("peer_count") >= P.MIN_PEERS) & (F.col("peer_median") > 0), cur / F.col("peer_median"))
    return j.select("company_id", "filed_at", cur.alias("current_pe"), F.col("peer_median").alias("sector_median_pe"),
                    "peer_count", S.clip01((ratio - 1.0) / 2.0).alias("market_fundamental_divergence"))


def market_features(filings: DataFrame, prices: DataFrame, companies=None, filings_with_income=None,
                    hot_rows=O.AUTO) -> DataFrame:
    """prices: company_id, trading_date, price_id, price."""
    if hot_rows == O.AUTO:  # one check of the base tables for the whole chain
        hot_rows = O.hot_limit(prices, ["company_id"]) or O.hot_limit(filings, ["company_id"])
    anchors = filings.select("company_id", "filed_at").distinct()
    names = [n for _, _, n in P.MOMENTUM_WINDOWS]
    mom = momentum(daily_prices(prices))
    a = O.asof(anchors, mom, ["company_id"], "filed_at", "trading_date", F.lit(0),
               ["trading_date", "price", "price_momentum_risk", *names], hot_rows=hot_rows)
    a = a.select("company_id", "filed_at", "asof.*")
    vol = volatility(daily_returns(prices, hot_rows), hot_rows)
    a = O.asof(a, vol, ["company_id"], "filed_at", "trading_date", "price_id",
               ["rolling_vol_30d", "rolling_vol_180d", "volatility_spike"], hot_rows=hot_rows)
    a = a.select(*[c for c in a.columns if c != "asof"], "asof.*")
    a = O.asof(a, price_counts(prices, hot_rows), ["company_id"], "filed_at", "trading_date", "price_id",
               ["price_count"], hot_rows=hot_rows)
    a = a.select(*[c for c in a.columns if c != "asof"], "asof.*")
    if filings_with_income is not None:
        val = valuation(a.where(F.col("price").isNotNull()).select("company_id", "filed_at", "price"), companies,
                        filings_with_income, prices, hot_rows)
        a = a.join(val, ["company_id", "filed_at"], "left")
    else:
        a = a.withColumn("market_fundamental_divergence", F.lit(None).cast("double"))
    return filings.join(a, ["company_id", "filed_at"], "left")


def market_signals(features: DataFrame, computed_at) -> DataFrame:
    layers = {k: F.col(k) for k in P.MARKET_WEIGHTS}
    parts = {
        "price_momentum_risk": {n: F.col(n) for _, _, n in P.MOMENTUM_WINDOWS},
        "volatility_spike": {n: F.col(n) for n in ("rolling_vol_30d", "rolling_vol_180d")},
        "market_fundamental_divergence": {n: F.col(n) for n in ("current_pe", "sector_median_pe", "peer_count")
                                          if n in features.columns} or {"current_pe": F.lit(None).cast("double")},
        "market_signal": layers}
    features = features.withColumn("market_signal", S.weighted_average(layers, P.MARKET_WEIGHTS))
    values = {**layers, "market_signal": F.col("market_signal")}
    reason = F.when(F.col("price").isNull(), "missing_market_prices").otherwise("insufficient_market_history")
    specs = {}
    for name, value in values.items():
        cover = S.defined_ratio(parts[name].values())
        specs[name] = (value, {
            "anchor_date": F.col("trading_date"), "price_observation_count": F.col("price_count"),
            "coverage_ratio": cover, "confidence": S.market_confidence(F.col("price_count"), cover),
            "component_scores": F.struct(*[c.alias(k) for k, c in parts[name].items()]),
            "signal_category": F.lit("market"),
            "signal_role": F.lit("composite_layer" if name == "market_signal" else "base")}, reason)
    return signal_rows(features, specs, VERSION, computed_at)
