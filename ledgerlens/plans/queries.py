"""Read queries over the stored tables, whole; a limit, where one is given, is a page size."""
from pyspark.sql import DataFrame, functions as F

from ledgerlens import policies as P
from ledgerlens.functions import dates as D, jsonpath as J, scoring as S, strings as T
from ledgerlens.operators import aggregates as A
from ledgerlens.operators.dedupe import latest_per_key, top_per_key
from ledgerlens.plans.rows import union_all

FILING_SNAPSHOT = ("filing_id", "accession_number", "form_type", "filed_at", "period_of_report", "is_extracted",
                   "is_xbrl_parsed", "is_embedded", "is_signal_scored", "processing_status")


def page(limit):
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    return limit


def paged(df: DataFrame, order, limit) -> DataFrame:
    """df in order, the first `limit` rows if one is given."""
    page(limit)
    return df.orderBy(*order) if limit is None else df.orderBy(*order).limit(limit)


def paged_per_key(df: DataFrame, keys, order, limit) -> DataFrame:
    """The first `limit` rows of each key if one is given; else all, which need no order."""
    return df if page(limit) is None else top_per_key(df, keys, order, limit)


def companies(df: DataFrame, active_only=False, limit=None) -> DataFrame:
    d = df.where("is_active") if active_only else df
    return paged(d, ["name", "company_id"], limit).select("name", "ticker", "cik", "is_active")


def tickers(df: DataFrame, active_only=False, limit=None) -> DataFrame:
    d = df.where("is_active") if active_only else df
    return paged(d.select("ticker"), ["ticker"], limit).where(F.coalesce(F.col("ticker"), F.lit("")) != "")


def filings(df: DataFrame, company_id=None, form_type=None, limit=None) -> DataFrame:
    """Snapshots newest first; without a company, and with a limit, the newest so many of every company."""
    d = df.where(F.col("form_type") == form_type.upper()) if form_type else df
    order = [F.col("filed_at").desc(), F.col("filing_id").desc()]
    if company_id is None:
        return paged_per_key(d, ["company_id"], order, limit).select("company_id", *FILING_SNAPSHOT)
    return d.where(F.col("company_id") == company_id).transform(paged, order, limit).select(*FILING_SNAPSHOT)


def pending(df: DataFrame, flag, limit=None) -> DataFrame:
    """Work not done yet, newest first."""
    return paged(df.where(~F.coalesce(F.col(flag), F.lit(False))), [F.col("filed_at").desc(), F.col("filing_id").desc()], limit)


def signal_row(signals: DataFrame, filings: DataFrame) -> DataFrame:
    """Signals with their filing, status and normalised detail.

    Status and detail are made before the join, so that a raw detail nobody reads is not shuffled. Files say little of
    how many filings they hold, so these are never broadcast: each task hashes its share of them, and signals are not sorted."""
    v = J.variant(F.col("detail"))
    f = filings.select("filing_id", "form_type", "filed_at", "accession_number", "period_of_report")
    s = signals.withColumns({"signal_name": F.coalesce("signal_name", F.lit("unknown")),
                             "status": J.signal_status(v, S.risk_label(F.col("signal_value"))), "detail": J.detail_shape(F.col("detail"))})
    rest = [c for c in signals.columns if c != "filing_id"]
    return s.join(f.hint("shuffle_hash"), "filing_id").select("filing_id", *rest, *f.columns[1:], "status")


def signals(signals_df, filings_df, company_id=None, signal_name=None, form_type=None, limit=None) -> DataFrame:
    d = signal_row(signals_df, filings_df)
    if company_id is not None:
        d = d.where(F.col("company_id") == company_id)
    if signal_name:
        d = d.where(F.col("signal_name") == signal_name)
    if form_type:
        d = d.where(F.col("form_type") == form_type.upper())
    order = [F.col("filed_at").desc(), F.col("computed_at").desc(), F.col("filing_id").desc(), F.col("signal_name").asc()]
    if company_id is None:
        return paged_per_key(d, ["company_id"], order, limit)
    return paged(d, order, limit)


def signal_history(signals_df, filings_df, limit=None) -> DataFrame:
    """The fused score over time per company; with a limit, the newest so many."""
    d = signals_df.where(F.col("signal_name") == "composite_filing_risk").join(
        filings_df.select("filing_id", "accession_number", "form_type", "filed_at", "period_of_report"), "filing_id")
    return paged_per_key(d, ["company_id"], [F.col("filed_at").desc(), F.col("filing_id").desc(), F.col("computed_at").desc()],
                         limit).select(
        "company_id", "filing_id", "accession_number", "form_type", "filed_at", "period_of_report", "signal_value",
        "computed_at")


def latest_signals(signals_df, filings_df) -> DataFrame:
    """Newest row per (company, signal name)."""
    d = signal_row(signals_df, filings_df)
    return latest_per_key(d, ["company_id", "signal_name"], "computed_at", "filed_at", "filing_id")


def embeddings(emb, filings_df, sections, company_id=None, section=None, filing_id=None, chunk_idx=None,
               form_type=None, include_vector=False) -> DataFrame:
    """Chunks with filing and section columns; the vector only on request, so that it is not read."""
    d = emb.join(filings_df.select("filing_id", "accession_number", "form_type", "filed_at"), "filing_id").join(
        sections.select(F.col("section_id").alias("filing_section_id"), "section", "sequence_idx"), "filing_section_id")
    for cond, on in ((company_id, "company_id"), (section, "section"), (filing_id, "filing_id"), (chunk_idx, "chunk_idx"),
                     (form_type, "form_type")):
        if cond is not None:
            d = d.where(F.col(on) == cond)
    cols = ["company_id", "filing_id", "accession_number", "form_type", "filed_at", "section", "sequence_idx",
            "chunk_idx", "text", "provider", "embedding_model"]
    return d.select(*cols, F.size("embedding").alias("dimension"), "embedding") if include_vector else d.select(*cols)


def latest_embedded_filing(emb, filings_df) -> DataFrame:
    """Newest filing per company that has embeddings."""
    have = filings_df.join(emb.select("filing_id").distinct(), "filing_id", "left_semi")
    return latest_per_key(have, ["company_id"], "filed_at", "filing_id")


def latest_embeddings(emb, filings_df, sections, **kw) -> DataFrame:
    newest = latest_embedded_filing(emb, filings_df).select("filing_id")
    return embeddings(emb.join(newest, "filing_id", "left_semi"), filings_df, sections, **kw)


def pick_field(df: DataFrame, field, fields) -> DataFrame:
    """One named field; `fields` maps public names to columns."""
    if field not in fields:
        raise ValueError(f"unsupported field {field!r}; supported: {', '.join(fields)}")
    return df.select("company_id", F.col(fields[field]).alias("value"))


# ---------------------------------------------------------------- identity
def _grams(text, n):
    last = F.length(text) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                                         lambda i: F.substring(text, i + 1, F.lit(n))))


GRAM_SIZES = (1, 2, 3, 5, 8, 13)


def containing(identifiers: DataFrame, names: DataFrame, sizes=GRAM_SIZES) -> DataFrame:
    """(identifier, name) pairs where the name contains the identifier, ignoring case; `%` and `_`
    act as wildcards. identifiers: given, ident. A name is met only through its character n-grams: those
    of an identifier have the largest of `sizes` that its longest run without wildcards holds, the one with
    the fewest names is looked up and the hits are verified. Long n-grams keep the hits near the true ones
    as names grow in number. Grams are many times the names they come from, more than files tell a
    planner: they are shuffled, never broadcast, and no more of them than identifiers ask for travel on."""
    none = F.expr("cast(array() as array<string>)")
    runs = F.filter(F.split(F.lower("ident"), "[%_]"), lambda r: r != "")
    longest = F.array_max(F.transform(runs, F.length))
    want = F.greatest(*[F.when(longest >= n, F.lit(n)) for n in sizes])
    grams = F.flatten(F.transform(runs, lambda r: F.concat(*[F.when(want == n, F.coalesce(_grams(r, n), none)).otherwise(none) for n in sizes])))
    asked = identifiers.select("given", "ident", F.explode(F.array_distinct(grams)).alias("gram"))
    wanted = asked.select("gram").distinct()
    idx = (names.repartition("name").select("*", F.explode(F.array_distinct(F.concat(*[F.coalesce(_grams(F.lower("name"), n), none) for n in sizes]))).alias("gram"))
           .join(wanted.hint("shuffle_hash"), "gram", "left_semi"))
    freq = idx.groupBy("gram").agg(F.count(F.lit(1)).alias("freq"))
    pick = (asked.join(freq.hint("merge"), "gram", "left").groupBy("given", "ident")
            .agg(F.min_by("gram", F.struct(F.coalesce("freq", F.lit(0)), "gram")).alias("gram")))
    return pick.join(idx.hint("merge"), "gram").where(F.expr("name ILIKE concat('%', ident, '%')")).drop("gram")


def resolve(identifiers: DataFrame, companies_df: DataFrame, max_candidates=2) -> DataFrame:
    """identifier -> company: CIK (digits), ticker, exact name, then a name containing it if only one
    does. status ok / ambiguous (with the first candidates) / not_found.

    Every step is an equi-join: the exact ones on the value, the contains step on the rarest
    character triple of the identifier.
    """
    c = companies_df.select("company_id", "cik", "ticker", "name")
    ids = identifiers.select(F.col("identifier").alias("given")).distinct().withColumn("ident", T.collapse(F.col("given")))
    first = lambda df, key: top_per_key(df, [key], [F.col("company_id").asc()])
    by = [("cik", F.when(F.col("ident").rlike(r"^\d+$"), T.pad10(F.col("ident"))), F.col("cik")),
          ("ticker", F.upper("ident"), F.col("ticker")), ("name", F.lower("ident"), F.lower("name"))]
    d = ids
    for name, want, have in by:
        look = first(c.select(have.alias(f"__{name}"), F.col("company_id")).where(F.col(f"__{name}").isNotNull()), f"__{name}")
        d = d.withColumn(f"__{name}", want).join(
            look.withColumnRenamed("company_id", f"id_{name}"), f"__{name}", "left").drop(f"__{name}")
    exact = d.withColumn("exact_id", F.coalesce("id_cik", "id_ticker", "id_name"))
    open_ = exact.where(F.col("exact_id").isNull() & (F.col("ident") != "")).select("given", "ident")
    hits = containing(open_, c).select("given", "company_id", "name")
    counted = hits.groupBy("given").agg(F.count(F.lit(1)).alias("matches"), F.min("company_id").alias("part_id"))
    shown = (top_per_key(hits, ["given"], [F.col("name").asc(), F.col("company_id").asc()], max_candidates)
             .groupBy("given").agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("candidates")))
    j = exact.join(counted, "given", "left").join(shown, "given", "left")
    n = F.coalesce("matches", F.lit(0))
    return j.select(F.col("given").alias("identifier"),
                    F.coalesce("exact_id", F.when(n == 1, F.col("part_id"))).alias("company_id"),
                    F.when(F.col("exact_id").isNotNull() | (n == 1), "ok").when(n > 1, "ambiguous")
                    .otherwise("not_found").alias("status"),
                    F.when(n > 1, F.col("candidates")).alias("candidates"))


# ---------------------------------------------------------------- score snapshot
SCORE_FIELDS = {
    "companies.name": "company_name", "companies.ticker": "ticker", "companies.nci_global": "composite_risk_score",
    "filings.filed_at": "latest_filed_at", "filings.latest_annual_filed_at": "latest_annual_filed_at",
    "filings.latest_quarterly_filed_at": "latest_quarterly_filed_at", "market_prices.price_close": "price_close",
    "news_items.sentiment_score": "news_sentiment_score",
}


def recent_news(news: DataFrame, k=5) -> DataFrame:
    """The five newest articles per company as an array, newest first."""
    top = top_per_key(news, ["company_id"], [F.col("published_at").desc(), F.col("news_id").desc()], k)
    item = F.struct((-F.unix_micros("published_at")).alias("o"), (-F.col("news_id")).alias("i"), "headline",
                    F.coalesce("publisher", "source_name").alias("source"), "published_at", "sentiment_score")
    return top.groupBy("company_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(
        x["headline"].alias("headline"), x["source"].alias("source"), x["published_at"].alias("published_at"),
        x["sentiment_score"].alias("sentiment_score"))).alias("recent_news"))


def score_snapshot(companies_df, filings_df, signals_df, facts, trades, prices, news, as_of) -> DataFrame:
    """One row per company; `as_of` is a date Column for the ages (never the wall clock).

    Each part is reduced to one row per company before it joins, so all joins are one to one.
    news: company_id, news_id, headline, publisher, source_name, published_at, sentiment_score.
    """
    newest = lambda forms, name: latest_per_key(
        filings_df.where(F.col("form_type").isin(*forms)), ["company_id"], "filed_at", "filing_id").select(
        "company_id", F.col("filing_id").alias(f"latest_{name}_filing_id"), F.col("filed_at").alias(f"latest_{name}_filed_at"))
    sig = latest_signals(signals_df, filings_df)
    bundle = sig.groupBy("company_id").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("signal_name", "signal_value")))).alias("signals"))
    # of the score's two names the most recently computed counts; on a tie the later name
    comp = latest_per_key(sig.where(F.col("signal_name").isin("nci_global", "composite_filing_risk")), ["company_id"],
                          "computed_at", "signal_name").select(
        "company_id", F.col("signal_value").alias("composite_risk_score"), F.col("computed_at").alias("scored_at"))
    summary = A.latest_period_facts(facts, {k: P.FACT_ALIASES[v] for k, v in P.SUMMARY_FACTS.items()})
    price = prices.groupBy("company_id").agg(F.max_by(F.struct("close", "volume", "trading_date"),
                                                      F.struct("trading_date", "price_id")).alias("p")).select(
        "company_id", F.col("p.close").alias("price_close"), F.col("p.volume").alias("price_volume"),
        F.col("p.trading_date").alias("price_date"))
    d = companies_df.select("company_id", "ticker", F.col("name").alias("company_name"), "sector")
    for part in (newest(("10-K", "10-K/A"), "annual"), newest(("10-Q", "10-Q/A"), "quarterly"), bundle, comp,
                 summary.withColumnRenamed("period_end", "facts_period_end"), A.insider_summary(trades), price,
                 recent_news(news)):
        d = d.join(part, "company_id", "left")
    d = d.withColumn("latest_filed_at", F.greatest("latest_annual_filed_at", "latest_quarterly_filed_at"))
    d = d.withColumn("risk_label", S.risk_label(F.col("composite_risk_score")))
    top = F.get("recent_news", F.lit(0))
    d = d.withColumn("news_sentiment_score", top["sentiment_score"])
    ages = {"filings_days_old": F.col("latest_filed_at"), "xbrl_days_old": F.col("facts_period_end"),
            "market_days_old": F.col("price_date"), "news_days_old": F.to_date(top["published_at"]),
            "signals_days_old": F.to_date("scored_at")}
    zero = {"total_transactions": 0, "opportunistic_sells": 0, "total_sell_value": 0.0, "total_buy_value": 0.0}
    return d.na.fill(zero).withColumns({k: D.age_days(as_of, v) for k, v in ages.items()})


def score_field(snapshot: DataFrame, field: str) -> DataFrame:
    return pick_field(snapshot, field, SCORE_FIELDS)


def validation_records(snapshots: DataFrame, companies_df: DataFrame, filings_df: DataFrame, tickers=None) -> DataFrame:
    """Snapshots unpivoted to one row per signal, with the reporting year (NULL values kept)."""
    c = companies_df.select("company_id", "ticker")
    if tickers:
        c = c.where(F.col("ticker").isin(*[t.strip().upper() for t in tickers]))
    d = snapshots.join(c, "company_id").join(filings_df.select("filing_id", "filed_at"), "filing_id", "left")
    d = d.withColumn("year", D.reporting_year(F.col("fiscal_year"), F.col("filed_at")))
    cols = [s[0] for s in P.VALIDATION_SIGNALS]
    d = d.withColumn("seq", F.struct("computed_at", "filing_id"))
    ids = ["ticker", "filing_id", "filed_at", "year", "fiscal_quarter", "event_type", "confidence", "coverage_ratio", "seq"]
    # wide rows go where the yearly groups are made: those need no shuffle of the rows per signal
    long = d.repartition("ticker", "year").unpivot(ids, cols, "column_name", "signal_value")
    names = F.create_map(*[x for col, key, _ in P.VALIDATION_SIGNALS for x in (F.lit(col), F.lit(key))])
    labels = F.create_map(*[x for col, _, lab in P.VALIDATION_SIGNALS for x in (F.lit(col), F.lit(lab))])
    return long.withColumn("signal_key", names[F.col("column_name")]).withColumn(
        "signal_label", labels[F.col("column_name")]).drop("column_name")
