"""JSON payloads landed as text -> rows. Every reader takes a DataFrame with the payload in a
string column, so one file or a million take the same plan.

The *_outer explodes are deliberate: a plain explode infers a not-empty filter, which is pushed
to the scan and would parse every payload a second time. The rows they add hold NULLs and fall
to the completeness filters."""
from pyspark.sql import DataFrame, functions as F

from ledgerlens import policies as P
from ledgerlens.functions import dates as D, strings as T
from ledgerlens.operators.dedupe import keep_best_fact, top_per_key


def read_payloads(spark, path) -> DataFrame:
    """Whole files as rows: path, payload."""
    return (spark.read.text(path, wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload")))


def ticker_map(df: DataFrame, payload="payload") -> DataFrame:
    """Object of {cik_str, ticker} objects -> ticker, cik; the last entry of a ticker wins."""
    m = F.from_json(payload, "map<string,struct<cik_str:string,ticker:string>>")
    rows = (df.select(F.posexplode_outer(F.map_values(m)).alias("pos", "e"))
            .select("pos", F.upper(F.trim("e.ticker")).alias("ticker"), T.pad10(F.trim("e.cik_str")).alias("cik"))
            .where((F.col("ticker") != "") & (F.col("cik") != "0000000000") & F.col("cik").isNotNull()))
    return top_per_key(rows, ["ticker"], [F.col("pos").desc()]).select("ticker", "cik")


_SUBMISSION = ("cik string, name string, sic string, sicDescription string, tickers array<string>, "
               "exchanges array<string>, filings struct<recent:struct<accessionNumber:array<string>,form:array<string>,"
               "filingDate:array<string>,reportDate:array<string>,primaryDocument:array<string>,size:array<string>>>")


def _first_ticker(s):
    return T.blank_to_null(F.trim(F.get(s["tickers"], F.lit(0))))


def company_meta(df: DataFrame, payload="payload", cik="cik") -> DataFrame:
    """Submission JSON plus a known cik column -> company rows; no ticker: the cik stands in."""
    s = F.from_json(payload, _SUBMISSION)
    d = df.select(T.pad10(F.trim(F.col(cik))).alias("cik"), s.alias("s"))
    return d.select("cik", F.upper(F.trim(F.coalesce(_first_ticker(F.col("s")), "cik"))).alias("ticker"),
                    F.trim(F.coalesce("s.name", F.lit(""))).alias("name"), F.col("s.sic").alias("sic_code"),
                    F.col("s.sicDescription").alias("sic_description"),
                    F.get("s.exchanges", F.lit(0)).alias("exchange"))


def filing_index(df: DataFrame, payload="payload", cik="cik", forms=None, limit=None) -> DataFrame:
    """Parallel arrays -> the supported filings per company (with a `limit`, the first so many) in source order. The
    shortest mandatory array sets the length; optional ones may be shorter. The limit is applied
    inside the payload's own array, so no shuffle."""
    if limit is not None and limit <= 0:
        return filing_index(df, payload, cik, forms, 1).limit(0)
    s = F.from_json(payload, _SUBMISSION)
    d = df.select(T.pad10(F.trim(F.col(cik))).alias("cik"), s.alias("s")).select(
        "cik", F.coalesce(_first_ticker(F.col("s")), F.lit("")).alias("tk"), "s.filings.recent.*")
    n = F.least(F.size("accessionNumber"), F.size("form"), F.size("filingDate"))
    wanted = sorted({f.upper() for f in forms} & set(P.SUPPORTED_INDEX_FORMS)) if forms else P.SUPPORTED_INDEX_FORMS
    at = lambda c, i: F.get(F.col(c), i)
    rows = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(
        at("accessionNumber", i).alias("accession_number"), F.upper(F.trim(at("form", i))).alias("form_type"),
        D.iso_date(at("filingDate", i)).alias("filed_at"), D.iso_date(at("reportDate", i)).alias("period_of_report"),
        T.blank_to_null(F.trim(at("primaryDocument", i))).alias("primary_document"),
        at("size", i).try_cast("bigint").alias("file_size_bytes")))
    ok = F.filter(rows, lambda r: (F.coalesce(r["accession_number"], F.lit("")) != "") & r["filed_at"].isNotNull()
                  & r["form_type"].isin(*wanted))
    return (d.where(n > 0).select("cik", F.upper(F.trim("tk")).alias("ticker"),
                                  F.posexplode_outer(F.slice(ok, 1, limit) if limit else ok).alias("position", "r"))
            .select("cik", "ticker", "position", "r.*")
            .where(F.col("accession_number").isNotNull())
            .withColumn("document_url", T.document_url(F.col("cik"), F.col("accession_number"),
                                                       F.col("primary_document"))))


_FACTS = ("facts map<string,map<string,struct<label:string,units:map<string,array<struct<val:string,start:string,"
          "end:string,fy:string,fp:string,form:string,filed:string,accn:string,decimals:string>>>>>>")


def filing_lookups(filings: DataFrame):
    """By accession, and by (form, period end) where the oldest filing wins."""
    by_acc = filings.select("company_id", F.col("accession_number").alias("accn"), F.col("filing_id").alias("id_acc"))
    by_period = top_per_key(filings.where(F.col("period_of_report").isNotNull()),
                            ["company_id", "form_type", "period_of_report"],
                            [F.col("filed_at").asc(), F.col("filing_id").asc()])
    return by_acc, by_period.select("company_id", "form_type", F.col("period_of_report").alias("period_end"),
                                    F.col("filing_id").alias("id_period"))


def facts_fault(payload):
    """Why a facts payload can give no rows; NULL when it may."""
    return (F.when(F.trim(F.coalesce(payload, F.lit(""))) == "", "missing payload")
            .when(F.try_parse_json(payload).isNull(), "malformed JSON")
            .when(F.from_json(payload, "facts map<string,string>")["facts"].isNull(), "no facts"))


def company_facts(df: DataFrame, filings: DataFrame, payload="payload", company="company_id",
                  taxonomies=P.DEFAULT_TAXONOMIES, forms=P.ANCHOR_FORMS, concepts=None) -> DataFrame:
    """Taxonomy -> concept -> unit -> entries flattened to facts, attached to filings, best per key."""
    f = F.from_json(payload, _FACTS)
    d = (df.select(F.col(company).alias("company_id"), F.posexplode_outer(f["facts"]).alias("p1", "taxonomy", "cs"))
         .where(F.col("taxonomy").isin(*taxonomies))
         .select("company_id", "taxonomy", "p1", F.posexplode_outer("cs").alias("p2", "concept", "c")))
    if concepts is not None:
        d = d.where(F.col("concept").isin(*concepts))
    d = (d.select("company_id", "taxonomy", "concept", "p1", "p2", T.blank_to_null(F.trim("c.label")).alias("label"),
                  F.posexplode_outer("c.units").alias("p3", "unit", "es"))
         .select("*", F.posexplode_outer("es").alias("p4", "e")))
    text = lambda c: T.blank_to_null(F.trim(F.col(f"e.{c}")))
    v = F.col("e.val").try_cast("double")
    d = d.select("company_id", "taxonomy", "concept", "label",
                 F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v).alias("value"), "unit",
                 text("decimals").alias("decimals"), D.iso_date(F.col("e.start")).alias("period_start"),
                 D.iso_date(F.col("e.end")).alias("period_end"), F.col("e.fy").try_cast("int").alias("fiscal_year"),
                 D.quarter_token(F.col("e.fp")).alias("fiscal_quarter"), text("form").alias("form_type"),
                 text("accn").alias("accn"), F.struct("p1", "p2", "p3", "p4").alias("position"))
    d = d.where(F.col("form_type").isin(*forms) & F.col("period_end").isNotNull() & F.col("value").isNotNull())
    d = d.withColumn("period_type", F.when(F.col("period_start").isNotNull(), "duration").otherwise("instant"))
    by_acc, by_period = filing_lookups(filings)
    d = (d.join(by_acc, ["company_id", "accn"], "left")
         .join(by_period, ["company_id", "form_type", "period_end"], "left")
         .withColumn("filing_id", F.coalesce("id_acc", "id_period")))
    best = keep_best_fact(d, "position", P.ANNUAL_FORMS)
    return best.select("company_id", "filing_id", "taxonomy", "concept", "label", "value", "unit", "decimals",
                       "period_type", "period_start", "period_end", "fiscal_year", "fiscal_quarter", "form_type")


_CHART = ("chart struct<error:string,result:array<struct<timestamp:array<bigint>,indicators:struct<"
          "quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,"
          "volume:array<bigint>>>,adjclose:array<struct<adjclose:array<double>>>>>>>")


def _landed(df):
    """The sequence number a payload landed with; 0 where none is kept."""
    return (F.col("landed") if "landed" in df.columns else F.lit(0)).cast("bigint").alias("landed")


def price_chart(df: DataFrame, payload="payload", symbol="ticker", provider="provider", strict=True) -> DataFrame:
    """Daily rows from a chart payload. Errors in the payload fail the job when `strict`, else the
    payload gives no rows. `position` is the place of a row: its payload's `landed` number, if there
    is one, and its index in the payload."""
    c = F.from_json(payload, _CHART)["chart"]
    d = df.select(F.col(symbol).alias("ticker"), F.col(provider).alias("provider"), _landed(df), c.alias("c")).select(
        "ticker", "provider", "landed", F.col("c.error").alias("err"), F.get("c.result", F.lit(0)).alias("r"))
    q = F.get("r.indicators.quote", F.lit(0))
    adj = F.get("r.indicators.adjclose", F.lit(0))["adjclose"]
    empty = F.coalesce(F.size("r.timestamp") < 1, F.lit(True)) | q.isNull()
    if strict:
        bad = F.col("err").isNotNull() | (F.col("r").isNotNull() & empty)
        d = d.where(F.when(bad, F.raise_error(F.concat(F.lit("no price history for "), F.col("ticker"), F.lit(": "),
                                                       F.coalesce("err", F.lit("empty payload")))).cast("boolean"))
                    .otherwise(True))
    else:
        d = d.where(F.col("err").isNull())
    d = d.where(F.col("r").isNotNull() & ~empty)
    d = d.select("ticker", "provider", "landed", q.alias("q"), adj.alias("adj"),
                 F.posexplode_outer("r.timestamp").alias("i", "epoch")).where(F.col("epoch").isNotNull())
    at = lambda c: F.get(F.col(c), F.col("i"))
    rows = d.select("ticker", D.epoch_date(F.col("epoch")).alias("trading_date"), at("q.open").alias("open"),
                    at("q.high").alias("high"), at("q.low").alias("low"), at("q.close").alias("close"),
                    F.coalesce(at("adj"), at("q.close")).alias("adjusted_close"), at("q.volume").alias("volume"),
                    "provider", F.struct("landed", F.col("i").alias("index")).alias("position"))
    return rows.where(F.coalesce(*[F.col(c).cast("double") for c in ("open", "high", "low", "close", "volume")]).isNotNull())


def macro_series(meta: DataFrame, observations: DataFrame, payload="payload", series="series_id",
                 provider="provider") -> DataFrame:
    """Series metadata onto its observations; "." and unreadable values dropped. `position` as in `price_chart`."""
    m = F.get(F.from_json(payload, "seriess array<struct<id:string,title:string,frequency:string,units:string>>")["seriess"],
              F.lit(0))
    text = lambda c: T.blank_to_null(F.trim(c))
    head = meta.select(F.col(series).alias("__s"), m.alias("m")).select(
        "__s", F.coalesce("m.id", "__s").alias("series_id"), text(F.col("m.frequency")).alias("frequency"),
        text(F.col("m.units")).alias("units"), text(F.col("m.title")).alias("title"))
    o = F.from_json(payload, "observations array<struct<date:string,value:string>>")["observations"]
    obs = observations.select(F.col(series).alias("__s"), F.col(provider).alias("provider"), _landed(observations), F.posexplode_outer(o).alias("i", "o")).select(
        "__s", "provider", F.struct("landed", F.col("i").alias("index")).alias("position"), D.iso_date(F.col("o.date")).alias("observation_date"),
        T.plain_number(F.when(F.trim("o.value") != ".", F.col("o.value"))).alias("value"))
    return (obs.where(F.col("observation_date").isNotNull() & F.col("value").isNotNull()).join(head, "__s")
            .select("series_id", "observation_date", "value", "provider", "frequency", "units", "title", "position"))


def ranked_xml_documents(df: DataFrame, payload="payload", primary="primary_document", key="accession_number") -> DataFrame:
    """Candidate ownership documents in trial order: an XML primary document, then names with
    ownership/form4/doc4, then other XML files, then a non-XML primary document."""
    items = F.from_json(payload, "directory struct<item:array<struct<name:string>>>")["directory"]["item"]
    p = F.col(primary)
    d = df.select(key, p.alias("primary"), F.coalesce(F.transform(items, lambda x: x["name"]),
                                                      F.expr("cast(array() as array<string>)")).alias("names"))
    xml = F.filter("names", lambda n: F.lower(n).endswith(".xml") & (n != F.coalesce("primary", F.lit(""))))
    base = lambda n: F.lower(F.regexp_extract(n, r"([^/]*)$", 1))
    liked = lambda n: base(n).contains("ownership") | base(n).contains("form4") | base(n).startswith("doc4")
    first = F.when(F.lower("primary").endswith(".xml"), F.array("primary"))
    last = F.when(F.col("primary").isNotNull() & ~F.lower("primary").endswith(".xml"), F.array("primary"))
    none = F.expr("cast(array() as array<string>)")
    order = F.concat(F.coalesce(first, none), F.array_distinct(F.filter(xml, liked)),
                     F.array_distinct(F.filter(xml, lambda n: ~liked(n))), F.coalesce(last, none))
    return d.select(key, F.posexplode_outer(order).alias("rank", "document")).where(F.col("document").isNotNull())


def pick_ownership_document(ranked: DataFrame, texts: DataFrame, key="accession_number") -> DataFrame:
    """First ranked document whose text looks like ownership XML."""
    hits = ranked.join(texts, [key, "document"]).where(T.looks_like_ownership_xml(F.col("text")))
    return top_per_key(hits, [key], [F.col("rank").asc()])
