"""Payload files, sinks, jobs and streams on landed files."""
import json
import uuid
from datetime import date, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from ledgerlens.operators import buckets as BK, upsert as U
from ledgerlens.plans import jobs as J, queries as R
from ledgerlens.schemas import TABLES, conform
from ledgerlens.sources import files, json_payloads as JP, xml_payloads as XP
from ledgerlens.streaming import incremental as ST


def at():
    return F.lit("2026-02-01").cast("timestamp")


INLINE = """<?xml version="1.0"?>
<html xmlns:ix="http://www.xbrl.org/2013/inlineXBRL" xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:xbrldi="http://xbrl.org/2006/xbrldi"><body><div>
<xbrli:context id="d1"><xbrli:entity><xbrli:identifier scheme="x">1</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:startDate>2021-02-01</xbrli:startDate><xbrli:endDate>2022-01-31</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:context id="i1"><xbrli:entity><xbrli:identifier scheme="x">1</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:instant>2022-01-31</xbrli:instant></xbrli:period></xbrli:context>
<xbrli:context id="s1"><xbrli:entity><xbrli:identifier scheme="x">1</xbrli:identifier><xbrli:segment><xbrldi:explicitMember dimension="a">b</xbrldi:explicitMember></xbrli:segment></xbrli:entity><xbrli:period><xbrli:instant>2022-01-31</xbrli:instant></xbrli:period></xbrli:context>
<xbrli:unit id="u1"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit>
<xbrli:unit id="u2"><xbrli:divide><xbrli:unitNumerator><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unitNumerator><xbrli:unitDenominator><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:unitDenominator></xbrli:divide></xbrli:unit></div>
<p><ix:nonFraction name="us-gaap:Revenues" contextRef="d1" unitRef="u1" decimals="-6" scale="6">7,318.4</ix:nonFraction></p>
<p><ix:nonFraction name="us-gaap:NetIncomeLoss" contextRef="d1" unitRef="u1" decimals="-6" scale="6">(61.2)</ix:nonFraction></p>
<p><ix:nonFraction name="us-gaap:EarningsPerShareBasic" contextRef="d1" unitRef="u2" decimals="2">3.1</ix:nonFraction></p>
<p><ix:nonFraction name="us-gaap:Assets" contextRef="i1" unitRef="u1" scale="6">844</ix:nonFraction></p>
<p><ix:nonFraction name="us-gaap:Assets" contextRef="s1" unitRef="u1" scale="6">777</ix:nonFraction></p></body></html>"""


def test_inline_facts(spark, tmp_path):
    (tmp_path / "a.xml").write_text(INLINE)
    path = spark.read.text(str(tmp_path)).select("_metadata.file_path").first()[0]
    f = spark.createDataFrame([(path, 5, 1, "10-K", None, None)], "path string, filing_id long, company_id long, form_type string, fiscal_year int, fiscal_quarter int")
    rows = {r.concept: r for r in XP.inline_facts(spark, str(tmp_path), f).collect()}
    assert len(rows) == 4 and rows["NetIncomeLoss"].value == -61.2e6 and rows["Revenues"].value == 7318.4e6
    assert rows["Assets"].period_type == "instant" and rows["Assets"].value == 844e6 and rows["EarningsPerShareBasic"].unit == "USD/shares"
    assert rows["Revenues"].fiscal_year == 2022 and rows["Revenues"].period_start == date(2021, 2, 1)
    other = INLINE.replace("xmlns:xbrli=", "xmlns:i=").replace("xbrli:", "i:").replace("xmlns:ix=", "xmlns:fact-2=").replace("ix:", "fact-2:").replace(
        "xmlns:xbrldi=", "xmlns:m.d=").replace("xbrldi:", "m.d:")
    assert "<i:context" in other and "<fact-2:nonFraction" in other
    (tmp_path / "a.xml").write_text(other)  # the same facts under other prefixes
    assert {r.concept: r for r in XP.inline_facts(spark, str(tmp_path), f).collect()} == rows
    # a default namespace, a prefix bound anew where it is used, and a prefix that means something else elsewhere
    scoped = INLINE.replace("<xbrli:context", '<context xmlns="http://www.xbrl.org/2003/instance"').replace("<xbrli:unit ", '<unit xmlns="http://www.xbrl.org/2003/instance" ').replace(
        "</xbrli:unit>", "</unit>").replace("xbrli:context>", "context>").replace("</xbrli:", "</").replace("<xbrli:", "<").replace(
        "<body>", '<body><a xmlns:ix="urn:other"><ix:nonFraction name="us-gaap:Goodwill" contextRef="d1">5</ix:nonFraction></a>')
    (tmp_path / "a.xml").write_text(scoped)
    assert "<unitNumerator>" in scoped and {r.concept: r for r in XP.inline_facts(spark, str(tmp_path), f).collect()} == rows
    inner = INLINE.replace(">7,318.4<", '><ix:nonFraction name="us-gaap:SalesRevenueNet" contextRef="d1" unitRef="u1" scale="6">7,318.4</ix:nonFraction><')
    (tmp_path / "a.xml").write_text(inner)  # one figure under two names
    both = {r.concept: r for r in XP.inline_facts(spark, str(tmp_path), f).collect()}
    assert {c: r.value for c, r in both.items()} == {"SalesRevenueNet": 7318.4e6, **{c: r.value for c, r in rows.items()}}
    (tmp_path / "a.xml").write_text(INLINE.replace("<body>", "<body><br>&nbsp;"))  # not well-formed
    assert {r.concept: r for r in XP.inline_facts(spark, str(tmp_path), f).collect()} == rows
    (tmp_path / "a.xml").write_text(INLINE)
    none = XP.filings_without_inline_facts(f, XP.inline_facts(spark, str(tmp_path), f, taxonomies=("none",)))
    assert none.first().warning == "inline_xbrl_no_numeric_facts_found"


FORM4 = """<?xml version="1.0"?><ownershipDocument xmlns="urn:x"><issuer><issuerCik>455871</issuerCik><issuerName>Norvik</issuerName><issuerTradingSymbol>NVK</issuerTradingSymbol></issuer>
<reportingOwner><reportingOwnerId><rptOwnerCik>77</rptOwnerCik><rptOwnerName>Ida Brenner</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isOfficer>true</isOfficer><officerTitle>Treasurer</officerTitle></reportingOwnerRelationship></reportingOwner>
<nonDerivativeTable><nonDerivativeTransaction><securityTitle><value>Common</value></securityTitle><transactionDate><value>2022-06-07</value></transactionDate><transactionCoding><transactionCode>P</transactionCode></transactionCoding>
<transactionAmounts><transactionShares><value>1,340</value><footnoteId id="F1"/></transactionShares><transactionPricePerShare><value>41.5</value></transactionPricePerShare><transactionAcquiredDisposedCode><value>A</value></transactionAcquiredDisposedCode></transactionAmounts>
<ownershipNature><directOrIndirectOwnership><value>D</value></directOrIndirectOwnership></ownershipNature></nonDerivativeTransaction>
<nonDerivativeTransaction><transactionDate><value>2022-06-08</value></transactionDate><transactionCoding><transactionCode>S</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>620</value></transactionShares></transactionAmounts></nonDerivativeTransaction>
<nonDerivativeTransaction><transactionDate><value>bad</value></transactionDate><transactionCoding><transactionCode>S</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>5</value></transactionShares></transactionAmounts></nonDerivativeTransaction></nonDerivativeTable>
<derivativeTable><derivativeTransaction><transactionDate><value>2022-06-07</value></transactionDate><transactionCoding><transactionCode>P</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>1340</value></transactionShares><transactionPricePerShare><value>41.5</value></transactionPricePerShare></transactionAmounts></derivativeTransaction></derivativeTable></ownershipDocument>"""
DOC = "filing_id long, company_id long, accession_number string, cik string, ticker string, issuer_name string, filed_at date, form_type string, source_url string, xml string"


def insider_rows(spark, xml=FORM4):
    return XP.insider_transactions(spark.createDataFrame([(1, 1, "acc", "1", "T", "N", date(2022, 6, 9), "4", None, xml)], DOC))


def test_form4(spark):
    rows = insider_rows(spark).orderBy("is_derivative", "transaction_date").collect()
    assert [(r.transaction_code, r.shares, r.is_derivative) for r in rows] == [("P", 1340, False), ("S", 620, False), ("P", 1340, True)]
    a = rows[0]
    assert a.transaction_value == 55610 and a.cik == "0000455871" and a.is_officer and a.officer_title == "Treasurer" and json.loads(a.raw_detail)["footnote_ids"] == ["F1"]
    assert len({r.transaction_uid for r in rows}) == 3 and rows[1].price_per_share is None and rows[1].security_title == ""
    import re
    anon = insider_rows(spark, re.sub("<rptOwnerName>.*?</rptOwnerName>", "", FORM4))
    assert {r.insider_name for r in anon.collect()} == {"unknown"}


def test_rss_and_news(spark, tmp_path):
    (tmp_path / "nvk.xml").write_text("""<?xml version="1.0"?><rss><channel><title>feed</title>
<item><title>Norvik beats estimates - Wire</title><link>https://News.example.com/a?utm_source=x&amp;b=1</link><description>&lt;b&gt;Good&lt;/b&gt; &amp;amp; solid</description><guid>1</guid><pubDate>Mon, 17 Apr 2026 12:30:00 GMT</pubDate></item>
<item><title>Untitled</title><link>https://e.com/b</link><pubDate>Mon, 17 Apr 2026 12:30:00 GMT</pubDate></item>
<item><title>Norvik falls sharply today</title><link>https://e.com/c</link><source url="https://s.com">Src</source><pubDate>bad date</pubDate></item></channel></rss>""")
    raw = XP.news_rss(spark, str(tmp_path / "nvk.xml"))
    assert raw.count() == 3
    n = files.normalise_news(raw, at()).collect()
    assert len(n) == 1 and n[0].publisher == "Wire" and n[0].summary == "Good & solid" and n[0].url == "https://news.example.com/a?b=1"
    assert n[0].ticker == "NVK" and n[0].published_at == datetime(2026, 4, 17, 12, 30) and len(n[0].dedupe_hash) == 64
    assert json.loads(n[0].raw_json)["title"] == "Norvik beats estimates - Wire"


def test_raw_filings_and_document_choice(spark, tmp_path):
    p = tmp_path / "0000000001" / "10-K_A"
    p.mkdir(parents=True)
    (p / "acc-1.txt").write_text("line one\nline two")
    r = files.raw_filings(spark, str(tmp_path)).first()
    assert (r.cik, r.form_key, r.accession_number, r.raw_text) == ("0000000001", "10-K_A", "acc-1", "line one\nline two")
    idx = spark.createDataFrame([("a", "main.htm", json.dumps({"directory": {"item": [{"name": "x.xml"}, {"name": "Form4.xml"}, {"name": "y.txt"}, {"name": "x.xml"}]}})),
                                 ("b", "p.xml", "{}")], "accession_number string, primary_document string, payload string")
    ranked = JP.ranked_xml_documents(idx)
    got = [(r.accession_number, r.document) for r in ranked.orderBy("accession_number", "rank").collect()]
    assert got == [("a", "Form4.xml"), ("a", "x.xml"), ("a", "main.htm"), ("b", "p.xml")]
    texts = spark.createDataFrame([("a", "Form4.xml", "<html>"), ("a", "x.xml", "<?xml ?>"), ("a", "main.htm", "<?xml ?>")], "accession_number string, document string, text string")
    assert JP.pick_ownership_document(ranked, texts).first().document == "x.xml"


def test_price_chart_errors(spark):
    ok = {"chart": {"result": [{"timestamp": [1713398400, None], "indicators": {"quote": [{"open": [1.0], "close": [2.0], "volume": [5]}], "adjclose": [{"adjclose": []}]}}]}}
    df = lambda p: spark.createDataFrame([("T", "x", json.dumps(p))], "ticker string, provider string, payload string")
    r = JP.price_chart(df(ok)).collect()
    assert len(r) == 1 and r[0].trading_date == date(2024, 4, 18) and r[0].adjusted_close == 2.0
    bad = {"chart": {"error": "not found", "result": []}}
    with pytest.raises(Exception, match="no price history"):
        JP.price_chart(df(bad)).collect()
    assert JP.price_chart(df(bad), strict=False).count() == 0


# ---------------------------------------------------------------- sinks
def test_upserts_are_rerun_safe(spark, tmp_path):
    path, schema = str(tmp_path / "m"), TABLES["macro_observations"]
    rows = [("S", date(2024, 1, 1) , 1.0, "p", 0), ("S", date(2024, 1, 1), 2.0, "p", 1), ("S", date(2024, 1, 2), 3.0, "p", 2), ("S", None, 9.0, "p", 3)]
    b = spark.createDataFrame(rows, "series_id string, observation_date date, value double, provider string, position int")
    src = conform(b, schema).withColumn("position", F.monotonically_increasing_id())
    src = conform(b, schema).join(b.select("observation_date", F.col("value").cast("decimal(18,6)").alias("value"), "position"), ["observation_date", "value"])
    s1 = U.upsert_summary(U.read_table(spark, path, schema), src, U.KEYS["macro_observations"], "position").first()
    assert (s1.inserted, s1.updated) == (2, 0)
    for _ in range(2):
        U.write_upsert(spark, path, schema, src, U.KEYS["macro_observations"], "position")
    got = {r.observation_date: float(r.value) for r in U.read_table(spark, path, schema).collect()}
    assert got == {date(2024, 1, 1): 2.0, date(2024, 1, 2): 3.0}
    s2 = U.upsert_summary(U.read_table(spark, path, schema), src, U.KEYS["macro_observations"], "position").first()
    assert (s2.selected - s2.deduped_in_batch, s2.inserted, s2.updated) == (2, 0, 2)


def files_of(path):
    import glob
    return {f for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def test_upsert_touches_only_its_buckets(spark, tmp_path):
    path, schema = str(tmp_path / "p"), TABLES["market_prices"]
    mk = lambda rows: conform(spark.createDataFrame(rows, "company_id long, trading_date date, provider string, close double"), schema)
    write = lambda rows: U.write_upsert(spark, path, schema, mk(rows), U.KEYS["market_prices"], buckets=16)
    write([(k, date(2024, 1, 1), "y", float(k)) for k in range(200)])
    first, before = BK.manifest(spark, path), files_of(path)
    assert first["version"] == 1 and len(first["folders"]) == 16
    batch = [(3, date(2024, 1, 1), "y", 50.0), (900, date(2024, 1, 2), "y", 6.0)]
    second = write(batch)
    changed = {k for k in second["folders"] if second["folders"][k] != first["folders"].get(k)}
    want = {str(r[0]) for r in mk(batch).select(BK._bucket(U.KEYS["market_prices"], 16)).collect()}
    assert changed == want and len(files_of(path) - before) == len(want) <= 2 and before <= files_of(path)
    got = {r.company_id: float(r.close) for r in U.read_table(spark, path, schema).collect()}
    assert got == {**{k: float(k) for k in range(200)}, 3: 50.0, 900: 6.0}
    assert {float(r.close) for r in BK.read(spark, path, schema, 1).where("company_id = 3").collect()} == {3.0}
    assert write([])["version"] == 2  # nothing to do


def test_dead_writers_and_old_versions(spark, tmp_path):
    path, schema = str(tmp_path / "p"), TABLES["macro_observations"]
    mk = lambda v, n=20: conform(spark.createDataFrame([(f"S{k}", date(2024, 1, 1), float(v), "p") for k in range(n)], "series_id string, observation_date date, value double, provider string"), schema)
    keys = U.KEYS["macro_observations"]
    U.write_upsert(spark, path, schema, mk(1), keys, buckets=4)
    with pytest.raises(Exception, match="no luck"):  # dies while it writes
        U.write_change(spark, path, schema, mk(2), lambda old, new: new.where(F.raise_error(F.lit("no luck")).isNull()), keys)
    assert {float(r.value) for r in U.read_table(spark, path, schema).collect()} == {1.0}
    stale = BK.manifest(spark, path)
    U.write_upsert(spark, path, schema, mk(3), keys)
    with pytest.raises(RuntimeError, match="another job"):  # began from the version before
        BK._commit(spark, path, {**stale, "version": 2})
    for v in range(4, 9):
        U.write_upsert(spark, path, schema, mk(v, 1), keys)
    assert BK.versions(spark, path) == [5, 6, 7] and U.read_table(spark, path, schema).count() == 20
    BK.expire(spark, path, keep=1, orphan_hours=-1)
    named = set(BK.manifest(spark, path)["folders"].values())
    assert {"/".join(f.split("/data/")[1].split("/")[:2]) for f in files_of(path)} == {f.removeprefix("data/") for f in named}
    assert {float(r.value) for r in U.read_table(spark, path, schema).where("series_id = 'S0'").collect()} == {8.0}
    U.write_version(spark, U.read_table(spark, path, schema), path, keys, buckets=2)
    assert BK.manifest(spark, path)["buckets"] == 2 and U.read_table(spark, path, schema).count() == 20


def test_insider_upsert_by_uid_then_business_key(spark):
    src = insider_rows(spark).withColumn("position", F.monotonically_increasing_id())
    empty = src.limit(0).drop("position")
    first = U.upsert_insider(empty, src, "position")
    assert first.count() == 3
    again = U.upsert_insider(first, src.withColumn("transaction_uid", F.concat(F.lit("n"), "transaction_uid")), "position")
    assert again.count() == 3 and all(r.transaction_uid.startswith("n") for r in again.collect())


def test_owner_replace_stage_events_csv(spark, tmp_path):
    t = spark.createDataFrame([(1, "a", 10)], "filing_id long, signal_name string, company_id long")
    with pytest.raises(Exception, match="already belongs to company 10"):
        U.assert_owner(t, spark.createDataFrame([(1, "a", 11)], t.schema), ["filing_id", "signal_name"]).collect()
    assert U.assert_owner(t, t, ["filing_id", "signal_name"]).count() == 1
    new = spark.createDataFrame([(1, "b", 10), (1, "c", 10)], t.schema)
    assert sorted(r.signal_name for r in U.replace_rows(t, new, "filing_id").collect()) == ["b", "c"]
    ev = U.event_rows(t, "x", "processing", F.lit("{}"), filing="filing_id", at=at())
    for _ in range(2):
        U.append_events(ev, str(tmp_path / "ev"))
    assert spark.read.parquet(str(tmp_path / "ev")).count() == 2
    U.write_csv(spark.createDataFrame([("a", None)], "x string, y double").coalesce(1), str(tmp_path / "csv"))
    text = "".join(f.read_text() for f in (tmp_path / "csv").glob("*.csv"))
    assert text == "x,y\na,\n"


# ---------------------------------------------------------------- jobs
@pandas_udf(StructType([StructField(c, DoubleType()) for c in ("positive", "negative", "neutral")]))
def scorer(s: pd.Series) -> pd.DataFrame:
    bad = s.str.contains("loss").astype(float)
    return pd.DataFrame({"positive": 0.9 - 0.8 * bad, "negative": 0.05 + 0.8 * bad, "neutral": 0.05})


@pandas_udf(ArrayType(FloatType()))
def embedder(s: pd.Series) -> pd.Series:
    return s.map(lambda x: [float(len(x)), float(x.count("a")), 1.0])


def test_filing_job_end_to_end(spark, tmp_path):
    store = J.Store(spark, str(tmp_path / "db"))
    comp = spark.createDataFrame([(i, f"{i:010d}", f"T{i}", f"Name {i}", "tech", True) for i in (1, 2)], "company_id long, cik string, ticker string, name string, sector string, is_active boolean")
    store.replace("companies", comp)
    para = "We expect steady demand across all regions and plan to invest in new products this year. " * 6
    idx = []
    for c in (1, 2):
        for y in (2023, 2024, 2025):
            acc, d = f"acc-{c}-{y}", tmp_path / "raw" / f"{c:010d}" / "10-K"
            d.mkdir(parents=True, exist_ok=True)
            body = para if y < 2025 else para.replace("steady demand", "a loss of demand")
            (d / f"{acc}.txt").write_text(f"Item 1A. Risk Factors\n{body}\nItem 7. MD&A\n{body}\nItem 8. Statements\n{para}")
            idx.append((c, f"{c:010d}", acc, "10-K", date(y, 2, 1), date(y - 1, 12, 31), 100))
    index = spark.createDataFrame(idx, "company_id long, cik string, accession_number string, form_type string, filed_at date, period_of_report date, file_size_bytes long")
    entry = lambda v, y: {"val": v, "start": f"{y - 1}-01-01", "end": f"{y - 1}-12-31", "fy": y - 1, "fp": "FY", "form": "10-K", "accn": f"acc-{{c}}-{y}"}
    facts = [(c, json.dumps({"facts": {"us-gaap": {k: {"label": k, "units": {"USD": [entry(v * (1 + .1 * i), y) for i, y in enumerate((2023, 2024, 2025))]}}
                                                   for k, v in (("Revenues", 100.0), ("GrossProfit", 40.0), ("NetIncomeLoss", 10.0))}}}).replace("{c}", str(c))) for c in (1, 2)]
    payload = spark.createDataFrame(facts, "company_id long, payload string")
    summary = J.run_filing_job(store, index, str(tmp_path / "raw"), payload, at(), embedder, 3, scorer)
    got = {r.layer: r.signal_count for r in summary.collect()}
    assert got == {"text": 24, "numbers": 30, "behavior": 18, "market": 24, "sentiment": 18, "composite": 24}
    f = store.read("filings").collect()
    assert len(f) == 6 and all(r.is_extracted and r.is_embedded and r.is_xbrl_parsed and r.is_signal_scored for r in f)
    tone = store.read("signal_scores").where("signal_name = 'forward_pessimism'").join(store.read("filings").select("filing_id", F.year("filed_at").alias("y")), "filing_id")
    by = {r.y: r.v for r in tone.groupBy("y").agg(F.avg("signal_value").alias("v")).collect()}
    assert by[2025] > by[2024]
    n = store.read("signal_scores").count()
    J.run_signals(store, at(), company_ids=[1], scorer=scorer)  # rerun for one company: same rows
    assert store.read("signal_scores").count() == n
    assert J.rejected_filings(store.read("filings"), spark.createDataFrame([(1,)], "filing_id long")).first().error == "filing not found"
    assert store.events().count() == 3 + 6 + 6
    flags = J.run_validation_report(store, ["t1"], str(tmp_path / "report"))
    assert flags.count() in (0, 9)


def test_only_changed_companies_are_scored_again(spark, tmp_path):
    def trades(rows):
        return conform(spark.createDataFrame(rows, "company_id long, transaction_uid string, accession_number string, transaction_date date, filed_at date, insider_name string, "
                                                   "transaction_code string, transaction_value double, shares double, is_officer boolean"), TABLES["insider_transactions"])
    stages = [s for s in J.STAGES if s[0] in ("insider_signals", "sentiment_signals")]

    def filled(name):
        store = J.Store(spark, str(tmp_path / name))
        store.replace("companies", spark.createDataFrame([(1, "tech"), (2, "tech"), (3, "food")], "company_id long, sector string"))
        store.replace("filings", spark.createDataFrame([(10 * c + y, c, f"a-{c}-{y}", "10-K", date(2020 + y, 3, 1)) for c in (1, 2, 3) for y in (1, 2, 3)],
                                                       "filing_id long, company_id long, accession_number string, form_type string, filed_at date"))
        store.replace("insider_transactions", trades([(c, f"u{c}{k}", f"t-{c}-{k}", date(2023, 1, 1 + k), date(2023, 1, 3 + k), f"p{k}", "S", 1000.0 * k, 10.0, True) for c in (1, 2, 3) for k in range(1, 6)]))
        return store
    late = trades([(2, "late", "t-late", date(2023, 2, 20), date(2023, 2, 22), "p9", "S", 9e6, 10.0, True)])
    store, clock = filled("db"), [F.lit(datetime(2026, 1, d)) for d in (1, 2, 3, 4)]

    def stamped(day):
        return {r.company_id for r in store.read("signal_scores").where(F.col("computed_at") == clock[day]).collect()}
    J.run_signals(store, clock[0], stages=stages, changed_only=True)
    assert stamped(0) == {1, 2, 3}
    for _ in range(2):  # the flags that a run writes are no change
        J.run_signals(store, clock[1], stages=stages, changed_only=True)
    assert stamped(1) == set() and store.events().count() == len(stages)
    store.upsert("insider_transactions", late)
    for _ in range(3):  # versions that the comparison needs outlive others
        store.upsert("insider_transactions", late)
    J.run_signals(store, clock[2], stages=stages, changed_only=True)
    assert stamped(2) == {2} and stamped(0) == {1, 3}
    whole = filled("db2")
    whole.upsert("insider_transactions", late)
    J.run_signals(whole, clock[3], stages=stages)
    rows = lambda st: sorted(map(str, st.read("signal_scores").drop("computed_at").collect()))
    assert rows(store) == rows(whole)
    store.replace("companies", spark.createDataFrame([(1, "tech"), (2, "tech"), (3, "energy")], "company_id long, sector string"))
    store.upsert("market_prices", conform(spark.createDataFrame([(1, date(2023, 1, 1), "p", 4.0)], "company_id long, trading_date date, provider string, close double"), TABLES["market_prices"]))
    from ledgerlens.plans import changes
    assert changes.dirty_companies(store) is None  # a table that no run has read yet
    J.run_signals(store, clock[3], stages=stages, changed_only=True)
    store.upsert("market_prices", conform(spark.createDataFrame([(1, date(2023, 1, 2), "p", 5.0)], "company_id long, trading_date date, provider string, close double"), TABLES["market_prices"]))
    assert {r.company_id for r in changes.dirty_companies(store).collect()} == {1, 2}  # the sector


def test_source_jobs(spark, tmp_path):
    store = J.Store(spark, str(tmp_path / "db"))
    store.replace("companies", spark.createDataFrame([(1, "0000000001", "NVK", "Norvik")], "company_id long, cik string, ticker string, name string"))
    raw = spark.createDataFrame([("nvk", "Norvik reports a heavy loss", None, "https://e.com/1", None, "2026-01-05T10:00:00"), ("nvk", "Norvik opens a new plant", None, "https://e.com/2", None, "2026-01-06T10:00:00"),
                                 ("nvk", "Norvik opens a new plant", None, "https://e.com/2#x", None, "2026-01-06T10:00:00")],
                                "ticker string, headline string, summary string, url string, publisher string, published_at string")
    J.run_news(store, raw, at())
    assert store.read("news_items").count() == 2
    J.run_news_backfill(store, scorer, at())
    assert {r.sentiment_label for r in store.read("news_items").collect()} == {"negative", "positive"}
    chart = {"chart": {"result": [{"timestamp": [1713398400], "indicators": {"quote": [{"open": [1.0], "close": [2.0], "volume": [5]}], "adjclose": []}}]}}
    prices = spark.createDataFrame([("NVK", "y", json.dumps(chart))], "ticker string, provider string, payload string")
    for _ in range(2):
        J.run_prices(store, prices, at())
    assert store.read("market_prices").count() == 1
    with pytest.raises(ValueError):
        J.run_prices(store, prices, at(), start=date(2025, 1, 1), end=date(2025, 2, 1))
    same = [{"timestamp": [1713398400] * 6, "indicators": {"quote": [{"open": [1.0] * 6, "close": [float(k) for k in range(6)], "volume": [5] * 6}], "adjclose": []}}]
    batch = spark.createDataFrame([("NVK", "z", json.dumps({"chart": {"result": same}})), ("BAD", "z", json.dumps({"chart": {"result": None, "error": "gone"}}))],
                                  "ticker string, provider string, payload string")
    done = J.run_prices(store, batch, at())  # the last of a key wins, a bad payload costs its ticker only
    assert (done["selected"], done["stored"], done["failed"]) == (6, 1, ["BAD"])
    assert store.read("market_prices").where("provider = 'z'").first().close == 5
    meta = spark.createDataFrame([("UNRATE", json.dumps({"seriess": [{"id": "UNRATE", "title": "t"}]}))], "series_id string, payload string")
    obs = spark.createDataFrame([("UNRATE", "f", json.dumps({"observations": [{"date": "2024-01-01", "value": "3.7"}, {"date": "2024-02-01", "value": "."}]}))], "series_id string, provider string, payload string")
    assert J.run_macro(store, meta, obs, at()).first().fetched == 1 and store.read("macro_observations").count() == 1
    f = spark.createDataFrame([(9, 1, "acc", "4", date(2022, 6, 9), False)], "filing_id long, company_id long, accession_number string, form_type string, filed_at date, is_form4_parsed boolean")
    store.replace("filings", f)
    docs = spark.createDataFrame([(9, FORM4)], "filing_id long, xml string")
    for _ in range(2):
        J.run_insiders(store, docs, at())
    assert store.read("insider_transactions").count() == 3 and store.read("filings").first().is_form4_parsed
    order = []
    assert J.run_backfill([(n, lambda n=n: order.append(n)) for n in ("10-K", "10-Q", "4", "news")], store, at()) == order == ["10-K", "10-Q", "4", "news"]
    assert J.price_range(date(2024, 12, 31))[0] == date(2024, 1, 1) and J.market_symbol(" nvk ") == "NVK"
    for bad in (lambda: J.price_range(date(2024, 1, 1), date(2024, 2, 1)), lambda: J.market_symbol("123"), lambda: R.page(0), lambda: R.pick_field(f, "x", {"a": "b"})):
        with pytest.raises(ValueError):
            bad()


# ---------------------------------------------------------------- streams
def test_streams(spark, tmp_path):
    schema = TABLES["macro_observations"]
    src = tmp_path / "in"
    tag = uuid.uuid4().hex  # the checkpoint folder outlives the test run
    rows = lambda v: conform(spark.createDataFrame([("S", date(2024, 1, d), v + d, "p", datetime(2024, 1, d)) for d in (1, 2, 3)],
                                                   "series_id string, observation_date date, value double, provider string, retrieved_at timestamp"), schema)
    rows(0.0).coalesce(1).write.parquet(str(src))
    run = lambda name: ST.start_upsert(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "t"), schema, U.KEYS["macro_observations"], name + tag, "retrieved_at").awaitTermination(120)
    run("a")
    assert U.read_table(spark, str(tmp_path / "t"), schema).count() == 3
    rows(10.0).coalesce(1).write.mode("append").parquet(str(src))
    run("b")  # a fresh query over both files: repeats inside the delay are dropped, keys stay unique
    assert U.read_table(spark, str(tmp_path / "t"), schema).count() == 3
    log = spark.readStream.schema(schema).parquet(str(src))
    ST.append_log(log, str(tmp_path / "log"), tag).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6
    ev = spark.createDataFrame([(1, datetime(2024, 1, d, 5)) for d in (1, 2, 9)], "company_id long, published_at timestamp")
    ev.coalesce(1).write.parquet(str(tmp_path / "news"))
    q = (ST.news_volume(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "news"))).writeStream.format("memory").queryName("vol").outputMode("complete")
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("vol").collect())) == sorted(map(tuple, ST.news_volume(ev).collect()))


# ---------------------------------------------------------------- faults
def quarantined(store):
    return sorted((r.step, r.subject, r.company_id, r.reason, r.attempts) for r in store.read("quarantine").collect())


def test_bad_payloads_are_set_apart(spark, tmp_path):
    store = J.Store(spark, str(tmp_path / "db"))
    store.replace("companies", spark.createDataFrame([(c, f"{c:010d}", f"T{c}", "n") for c in (1, 2, 3)], "company_id long, cik string, ticker string, name string"))
    store.replace("filings", spark.createDataFrame([(k, 1, f"a{k}", "4", date(2022, 6, 9), False) for k in (7, 8, 9, 10)],
                                                   "filing_id long, company_id long, accession_number string, form_type string, filed_at date, is_form4_parsed boolean"))
    documents = lambda *rows: spark.createDataFrame(rows, "filing_id long, xml string")
    empty = FORM4[:FORM4.index("<nonDerivativeTable>")] + "</ownershipDocument>" if "<nonDerivativeTable>" in FORM4 else "<ownershipDocument></ownershipDocument>"
    batch = documents((7, "<ownershipDocument><issuer>"), (8, None), (9, FORM4), (10, empty))
    for n in (1, 2, 3, 4):  # after three failures the same input is left alone
        J.run_insiders(store, batch, at())
        k = min(n, 3)
        assert quarantined(store) == [("form4_parser", "10", 1, "no transactions", k), ("form4_parser", "7", 1, "malformed XML", k), ("form4_parser", "8", 1, "missing payload", n)]
    assert {r.filing_id: r.last_error_message for r in store.read("filings").collect()} == {7: "malformed XML", 8: "missing payload", 9: None, 10: "no transactions"}
    failed = store.events().where("event_type = 'form4_failed'").collect()
    assert len(failed) == 10 and all(r.filing_id and r.company_id == 1 and r.duration_ms > 0 and json.loads(r.detail)["attempt"] for r in failed)
    J.run_insiders(store, documents((7, "<ownershipDocument>")), at())  # another payload starts anew
    assert ("form4_parser", "7", 1, "malformed XML", 1) in quarantined(store)
    J.run_insiders(store, documents((7, FORM4), (8, FORM4)), at())
    assert [x[1] for x in quarantined(store)] == ["10"]
    assert {r.filing_id for r in store.read("filings").where("is_form4_parsed").collect()} == {7, 8, 9}
    entry = {"val": 5.0, "end": "2024-12-31", "form": "10-K", "accn": "x", "fp": "FY", "fy": 2024}
    good = json.dumps({"facts": {"us-gaap": {"Assets": {"label": "a", "units": {"USD": [entry]}}}}})
    J.run_facts(store, spark.createDataFrame([(1, good), (2, '{"facts": {'), (3, "{}")], "company_id long, payload string"), at())
    assert store.read("xbrl_facts").count() == 1 and quarantined(store)[:2] == [("facts", "2", 2, "malformed JSON", 1), ("facts", "3", 3, "no facts", 1)]
    (tmp_path / "raw" / "0000000001" / "4").mkdir(parents=True)
    (tmp_path / "raw" / "0000000001" / "4" / "a9.txt").write_text("nothing to split")
    J.run_sections(store, str(tmp_path / "raw"), at())
    assert quarantined(store)[2] == ("filing_splitter", "9", 1, "no_sections_found", 1)


def test_a_company_that_fails_a_stage_is_set_apart(spark, tmp_path):
    def stage(bad):
        @pandas_udf("double")
        def value(company: pd.Series) -> pd.Series:
            if company.isin(bad).any():
                raise ValueError("cannot score this company")
            return company / 10.0
        return (("sentiment_signals", lambda store, filings, at, **_: filings.select(
            "filing_id", "company_id", F.lit("sentiment_signal").alias("signal_name"), value("company_id").alias("signal_value"), at.alias("computed_at")),
            "is_text_signal_scored", "sentiment_signal_scored"),)

    store = J.Store(spark, str(tmp_path / "db"))
    store.replace("companies", spark.createDataFrame([(c, "tech") for c in range(1, 6)], "company_id long, sector string"))
    store.replace("filings", spark.createDataFrame([(10 * c + y, c, f"a-{c}-{y}", "10-K", date(2020 + y, 3, 1)) for c in range(1, 6) for y in (1, 2)],
                                                   "filing_id long, company_id long, accession_number string, form_type string, filed_at date"))
    scored = lambda: {r.company_id for r in store.read("signal_scores").collect()}
    with pytest.raises(Exception, match="cannot score this company"):  # all companies: the stage's fault
        J.run_signals(store, at(), stages=stage([1, 2, 3, 4, 5]))
    assert not quarantined(store) and not scored()
    J.run_signals(store, at(), stages=stage([2, 4]), changed_only=True)
    assert [x[:3] + x[4:] for x in quarantined(store)] == [("sentiment_signals", str(10 * c + y), c, 1) for c in (2, 4) for y in (1, 2)]
    assert all("cannot score this company" in x[3] for x in quarantined(store)) and scored() == {1, 3, 5}
    assert {r.company_id for r in store.read("filings").where("last_error_message like '%cannot score%'").collect()} == {2, 4}
    assert {r.filing_id for r in store.events().where("event_type = 'signal_failed' and filing_id is not null").collect()} == {21, 22, 41, 42}
    J.run_signals(store, at(), stages=stage([]), changed_only=True)  # no input changed, but two companies wait
    assert not quarantined(store) and scored() == {1, 2, 3, 4, 5}
