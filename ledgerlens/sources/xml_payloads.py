"""XML payloads -> rows with Spark's own XML reader; tagged facts, whose names are scoped, with the standard library's."""
import json
import re
from xml.parsers import expat

from pyspark.sql import DataFrame, functions as F

from ledgerlens import policies as P
from ledgerlens.functions import dates as D, strings as T
from ledgerlens.operators.dedupe import keep_best_fact

# The *_outer explodes below are deliberate: a plain explode infers a not-empty filter, which is
# pushed to the scan and would parse every document a second time.

# ---------------------------------------------------------------- insider reports
_V = "struct<value:string>"
_VF = "struct<value:string,footnoteId:array<struct<_id:string>>>"
_TX = (f"array<struct<securityTitle:{_V},transactionDate:{_V},deemedExecutionDate:{_V},conversionOrExercisePrice:{_V},"
       f"transactionCoding:struct<transactionCode:string,equitySwapInvolved:string,transactionTimeliness:{_V}>,"
       f"transactionAmounts:struct<transactionShares:{_VF},transactionPricePerShare:{_VF},"
       f"transactionAcquiredDisposedCode:{_V}>,"
       f"postTransactionAmounts:struct<sharesOwnedFollowingTransaction:{_VF}>,"
       f"ownershipNature:struct<directOrIndirectOwnership:{_V}>>>")
FORM4_SCHEMA = (
    "issuer struct<issuerCik:string,issuerName:string,issuerTradingSymbol:string>, "
    "reportingOwner array<struct<reportingOwnerId:struct<rptOwnerCik:string,rptOwnerName:string>,"
    "reportingOwnerRelationship:struct<isDirector:string,isOfficer:string,isTenPercentOwner:string,isOther:string,"
    "officerTitle:string>>>, "
    f"nonDerivativeTable struct<nonDerivativeTransaction:{_TX}>, derivativeTable struct<derivativeTransaction:{_TX}>")


def _t(c):
    return T.blank_to_null(F.trim(c))


def report_fault(xml):
    """Why an insider report gave no rows."""
    clean = F.regexp_replace(xml, r"<(/?)[A-Za-z_][\w.\-]*:(?=[A-Za-z])", "<$1")
    doc = F.from_xml(clean, f"{FORM4_SCHEMA}, _corrupt_record string", {"ignoreNamespace": "true"})
    return (F.when(F.trim(F.coalesce(xml, F.lit(""))) == "", "missing payload")
            .when(doc.isNull() | doc["_corrupt_record"].isNotNull(), "malformed XML").otherwise("no transactions"))


def insider_transactions(df: DataFrame, xml="xml") -> DataFrame:
    """One row per (transaction, reporting owner). `df` also carries filing_id, company_id,
    accession_number, cik, ticker, issuer_name, filed_at, form_type, source_url.
    Rows without date, shares or code are dropped; a report without a named owner gets "unknown"."""
    text = F.col(xml)
    clean = F.when(text.contains(":"), F.regexp_replace(text, r"<(/?)[A-Za-z_][\w.\-]*:(?=[A-Za-z])", "<$1")).otherwise(text)
    doc = F.from_xml(clean, FORM4_SCHEMA, {"ignoreNamespace": "true"})
    base = ["filing_id", "company_id", "accession_number", "cik", "ticker", "issuer_name", "filed_at", "form_type",
            "source_url"]
    d = df.select(*base, doc.alias("x"))
    owner = lambda o: F.struct(
        _t(o["reportingOwnerId"]["rptOwnerName"]).alias("insider_name"),
        _t(o["reportingOwnerId"]["rptOwnerCik"]).alias("insider_cik"),
        *[T.flag(o["reportingOwnerRelationship"][a]).alias(b) for a, b in (
            ("isDirector", "is_director"), ("isOfficer", "is_officer"), ("isTenPercentOwner", "is_ten_percent_owner"),
            ("isOther", "is_other"))],
        _t(o["reportingOwnerRelationship"]["officerTitle"]).alias("officer_title"))
    named = F.filter(F.transform("x.reportingOwner", owner), lambda o: o["insider_name"].isNotNull())
    unknown = F.array(F.struct(
        F.lit("unknown").alias("insider_name"), _t(F.get("x.reportingOwner", F.lit(0))["reportingOwnerId"]["rptOwnerCik"])
        .alias("insider_cik"), *[F.lit(False).alias(b) for b in ("is_director", "is_officer", "is_ten_percent_owner",
                                                                 "is_other")],
        F.lit(None).cast("string").alias("officer_title")))
    d = d.withColumn("__named", named).select(*[c for c in base if c not in ("cik", "ticker", "issuer_name")],
                 F.coalesce(_t(F.col("x.issuer.issuerCik")), "cik").alias("cik"),
                 F.coalesce(_t(F.col("x.issuer.issuerTradingSymbol")), "ticker").alias("ticker"),
                 F.coalesce(_t(F.col("x.issuer.issuerName")), "issuer_name").alias("issuer_name"),
                 F.when(F.coalesce(F.size("__named"), F.lit(0)) > 0, F.col("__named")).otherwise(unknown).alias("owners"),
                 # both tables in one array, so that a document is parsed once
                 F.concat(*[F.coalesce(F.transform(F.col(f"x.{tag}Table.{tag}Transaction"), lambda t: F.struct(
                     F.lit(flag).alias("is_derivative"), t.alias("t"))), F.expr(f"cast(array() as array<struct<"
                     f"is_derivative:boolean,t:{_TX[6:-1]}>>)")) for flag, tag in ((False, "nonDerivative"), (True, "derivative"))])
                 .alias("rows"))
    keep = [c for c in d.columns if c not in ("rows", "owners")]
    t = d.select(*keep, "owners", F.posexplode_outer("rows").alias("tx_idx", "r")).select(
        *keep, "owners", "tx_idx", "r.is_derivative", "r.t")
    amounts = "t.transactionAmounts"
    notes = [f"{amounts}.transactionShares.footnoteId", f"{amounts}.transactionPricePerShare.footnoteId",
             "t.postTransactionAmounts.sharesOwnedFollowingTransaction.footnoteId"]
    none = F.expr("cast(array() as array<string>)")
    t = t.select(
        *keep, "owners", "is_derivative", "tx_idx",
        D.iso_date(_t(F.col("t.transactionDate.value"))).alias("transaction_date"),
        F.upper(F.coalesce(_t(F.col("t.transactionCoding.transactionCode")), F.lit(""))).alias("transaction_code"),
        T.plain_number(F.col(f"{amounts}.transactionShares.value")).alias("shares"),
        T.plain_number(F.col(f"{amounts}.transactionPricePerShare.value")).alias("price_per_share"),
        T.plain_number(F.col("t.postTransactionAmounts.sharesOwnedFollowingTransaction.value")).alias("shares_owned_after"),
        T.ownership_nature(_t(F.col("t.ownershipNature.directOrIndirectOwnership.value"))).alias("ownership_nature"),
        _t(F.col(f"{amounts}.transactionAcquiredDisposedCode.value")).alias("acquired_disposed_code"),
        _t(F.col("t.securityTitle.value")).alias("__title"),
        T.plain_number(F.col("t.conversionOrExercisePrice.value")).alias("__exercise"),
        _t(F.col("t.transactionCoding.transactionTimeliness.value")).alias("__timeliness"),
        T.flag(F.col("t.transactionCoding.equitySwapInvolved")).alias("__swap"),
        _t(F.col("t.deemedExecutionDate.value")).alias("__deemed"),
        F.concat(*[F.coalesce(F.transform(F.col(n), lambda x: x["_id"]), none) for n in notes]).alias("__notes"))
    t = t.where(F.col("transaction_date").isNotNull() & F.col("shares").isNotNull() & (F.col("transaction_code") != ""))
    t = t.select("*", F.explode_outer("owners").alias("o")).select(*[c for c in t.columns if c != "owners"], "o.*")
    detail = F.to_json(F.struct(
        F.col("__title").alias("security_title"), F.col("__timeliness").alias("transaction_timeliness"),
        F.col("__swap").alias("equity_swap_involved"), F.col("__notes").alias("footnote_ids"),
        F.col("__deemed").alias("deemed_execution_date"), F.col("__exercise").alias("conversion_or_exercise_price"),
        "shares_owned_after", "ownership_nature", "is_derivative",
        F.when(F.col("is_derivative"), "derivative").otherwise("non_derivative").alias("source_table_type")))
    t = (t.withColumn("transaction_type_normalized", T.transaction_type(
            F.col("transaction_code"), F.col("acquired_disposed_code"), F.col("is_derivative")))
         .withColumn("transaction_value", F.col("shares") * F.col("price_per_share"))
         .withColumn("security_title", F.coalesce("__title", F.lit("")))
         .withColumn("cik", T.pad10(F.trim("cik"))).withColumn("raw_detail", detail))
    return t.withColumn("transaction_uid", T.transaction_uid()).drop(
        "__title", "__exercise", "__timeliness", "__swap", "__deemed", "__notes", "tx_idx")


# ---------------------------------------------------------------- tagged facts inside a filing
#: What the namespaces of tagged facts have in common, and the prefixes they usually have.
_NAMESPACES = {"ix": r"http://www\.xbrl\.org/20\d\d/inlineXBRL", "xbrli": r"http://www\.xbrl\.org/2003/instance", "xbrldi": r"http://xbrl\.org/2006/xbrldi"}
_FACT = "_VALUE string, _name string, _contextRef string, _unitRef string, _decimals string, _scale string, _sign string"
_CONTEXT = ("_id string, xbrli_entity struct<xbrli_segment: string>, xbrli_scenario string, xbrldi_explicitMember string, xbrldi_typedMember string, "
            "xbrli_period struct<xbrli_instant: string, xbrli_startDate: string, xbrli_endDate: string>")
_UNIT = ("_id string, xbrli_measure string, xbrli_divide struct<xbrli_unitNumerator: struct<xbrli_measure: string>, "
         "xbrli_unitDenominator: struct<xbrli_measure: string>>")


def _plain_prefixes(x):
    """Element names of the fact namespaces as ix_, xbrli_ and xbrldi_, whatever prefixes a document declares for them."""
    for plain, uri in _NAMESPACES.items():
        declared = F.regexp_extract_all(x, F.lit(rf"""xmlns:([A-Za-z_][\w.-]*)\s*=\s*["']{uri}"""), F.lit(1))
        names = F.array_join(F.transform(F.array_distinct(F.concat(declared, F.array(F.lit(plain)))), lambda n: F.regexp_replace(n, r"([.])", r"\\$1")), "|")
        x = F.regexp_replace(x, F.concat(F.lit("<(/?)(?:"), names, F.lit("):")), F.lit(f"<$1{plain}_"))
    return x


def _elements(x, tag, schema):
    """All elements of a name, parsed."""
    return F.transform(F.regexp_extract_all(x, F.lit(rf"(?s)<{tag}\b(?:[^>]*/>|.*?</{tag}\s*>)"), F.lit(0)), lambda e: F.from_xml(e, schema))


#: What a document holds of them.
_TAGGED = f"facts array<struct<{_FACT}>>, contexts array<struct<{_CONTEXT}>>, units array<struct<{_UNIT}>>"


def tagged(text: str) -> str | None:
    """Facts, contexts and units of a well-formed document as JSON, None for any other. Element names are resolved in
    the scope they stand in: default namespaces, prefixes bound anew further in. A fact inside a fact counts by itself
    and as text of the outer one."""
    found = {"facts": [], "contexts": [], "units": []}
    path, facts, holder = [], [], None  # open elements; open facts with their text; the open context or unit

    def plain(name):
        uri, _, local = name.rpartition(" ")
        return next((f"{p}_{local}" for p, known in _NAMESPACES.items() if re.fullmatch(known, uri)), local)

    def start(name, attributes):
        nonlocal holder
        tag = plain(name)
        path.append(tag)
        if tag == "ix_nonFraction":
            fact = {"_" + k: v for k, v in attributes.items()}
            found["facts"].append(fact)
            facts.append((fact, []))
        elif tag in ("xbrli_context", "xbrli_unit"):
            holder = {"_id": attributes.get("id")}
            found["contexts" if tag == "xbrli_context" else "units"].append(holder)
        elif holder is not None and ("xbrli_segment" in path[:-1] or "xbrli_scenario" in path[:-1]):
            holder["xbrli_scenario"] = tag  # any dimension will do

    def data(text):
        for _, parts in facts:
            parts.append(text)
        if holder is None or not text.strip():
            return
        into, keys = holder, path[max(k for k, t in enumerate(path) if t in ("xbrli_context", "xbrli_unit")) + 1:]
        if not keys:
            return
        for key in keys[:-1]:
            into = into.setdefault(key, {})
            if not isinstance(into, dict):
                return
        if not isinstance(into.get(keys[-1]), dict):
            into[keys[-1]] = into.get(keys[-1], "") + text

    def end(name):
        nonlocal holder
        tag = path.pop()
        if tag == "ix_nonFraction":
            fact, parts = facts.pop()
            fact["_VALUE"] = "".join(parts)
        elif tag in ("xbrli_context", "xbrli_unit"):
            holder = None

    reader = expat.ParserCreate("utf-8", " ")
    reader.buffer_text = True
    reader.StartElementHandler, reader.CharacterDataHandler, reader.EndElementHandler = start, data, end
    try:
        reader.Parse((text or "").encode("utf-8", "replace"), True)
    except expat.ExpatError:
        return None
    return json.dumps(found)


def inline_facts(spark, path, filings: DataFrame, taxonomies=P.DEFAULT_TAXONOMIES, concepts=None) -> DataFrame:
    """filings: path (as stored), filing_id, company_id, form_type, fiscal_year, fiscal_quarter.
    Facts whose context has a segment, scenario or member are dropped; best fact per key.

    A document is read once and stays one row until its facts have met their contexts and units, by
    look-up in maps of the same row. Names are matched by namespace, not by prefix: in well-formed documents
    in the scope they stand in, in others by the prefixes declared anywhere, nested facts as far as they end."""
    read = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value", F.udf(tagged, "string", useArrow=False)("value").alias("found"))
    x, well = _plain_prefixes(F.col("value")), F.col("found").isNotNull()
    parsed = read.select("path", well.alias("well"), F.from_json("found", _TAGGED).alias("found"), F.when(~well, x).alias("x"))
    docs = parsed.select("path", *[
        F.when(F.col("well"), F.col(f"found.{name}")).otherwise(_elements(F.col("x"), tag, schema)).alias(name)
        for name, tag, schema in (("facts", "ix_nonFraction", _FACT), ("contexts", "xbrli_context", _CONTEXT), ("units", "xbrli_unit", _UNIT))])

    def last_day(p):
        return D.iso_date(F.trim(F.coalesce(p["xbrli_instant"], p["xbrli_endDate"])))

    def period(p):
        inst = p["xbrli_instant"]
        return F.struct(F.when(inst.isNotNull(), "instant").otherwise("duration").alias("period_type"),
                        F.when(inst.isNull(), D.iso_date(F.trim(p["xbrli_startDate"]))).alias("period_start"), last_day(p).alias("period_end"))

    def whole(c):  # without dimensions
        return F.coalesce(c["xbrli_entity"]["xbrli_segment"], c["xbrli_scenario"], c["xbrldi_explicitMember"], c["xbrldi_typedMember"]).isNull()

    def unit_name(u):
        ratio = u["xbrli_divide"]
        return F.coalesce(T.unit_token(u["xbrli_measure"]), F.concat(
            T.unit_token(ratio["xbrli_unitNumerator"]["xbrli_measure"]), F.lit("/"), T.unit_token(ratio["xbrli_unitDenominator"]["xbrli_measure"])))

    contexts = F.transform(F.filter("contexts", lambda c: whole(c) & last_day(c["xbrli_period"]).isNotNull()),
                           lambda c: F.struct(F.trim(c["_id"]).alias("id"), period(c["xbrli_period"]).alias("p")))
    units = F.transform("units", lambda u: F.struct(F.trim(u["_id"]).alias("id"), unit_name(u).alias("name")))
    facts = (docs.select("path", "facts", contexts.alias("contexts"), units.alias("units"))
             .select("path", "contexts", "units", F.posexplode_outer("facts").alias("i", "f")).where(F.col("f").isNotNull()))
    named = lambda entries, key: F.get(F.filter(entries, lambda e: e["id"] == F.trim(key)), F.lit(0))
    facts = facts.select("path", "i", "f.*", named("contexts", F.col("f._contextRef"))["p"].alias("p"), named("units", F.col("f._unitRef"))["name"].alias("unit_name"))
    facts = facts.where(F.col("p").isNotNull())
    raw = F.trim("_VALUE")
    value = F.when(~F.regexp_replace(raw, r"[,$% \s]", "").isin("-", "—", "–"),
                   T.tagged_number(raw, F.col("_sign"), F.col("_scale")))
    f = facts.select("path", F.struct("path", "i").alias("position"), "p.*", "unit_name",
                     F.regexp_extract("_name", r"^([^:]+):", 1).alias("taxonomy"),
                     F.regexp_extract("_name", r"^[^:]+:(.+)$", 1).alias("concept"), value.alias("value"),
                     T.blank_to_null(F.trim("_unitRef")).alias("__unit"), T.blank_to_null(F.trim("_decimals")).alias("decimals"))
    f = f.where((F.col("concept") != "") & F.col("value").isNotNull())
    if taxonomies:
        f = f.where(F.col("taxonomy").isin(*taxonomies))
    if concepts is not None:
        f = f.where(F.col("concept").isin(*concepts))
    j = (f.join(filings, "path")
         .withColumn("unit", F.coalesce("unit_name", "__unit"))
         .withColumn("fiscal_year", F.coalesce("fiscal_year", F.year("period_end")))
         .withColumn("label", F.lit(None).cast("string")))
    best = keep_best_fact(j, "position", P.ANNUAL_FORMS)
    return best.select("company_id", "filing_id", "taxonomy", "concept", "label", "value", "unit", "decimals",
                       "period_type", "period_start", "period_end", "fiscal_year", "fiscal_quarter", "form_type")


def filings_without_inline_facts(filings: DataFrame, facts: DataFrame) -> DataFrame:
    return filings.join(facts, "filing_id", "left_anti").select(
        "filing_id", F.lit("inline_xbrl_no_numeric_facts_found").alias("warning"))


# ---------------------------------------------------------------- news feed
RSS_ITEM = ("title string, link string, description string, guid string, pubDate string, "
            "source struct<_VALUE:string,_url:string>")


def news_rss(spark, path, ticker_from_path=r"([^/]+)\.xml$", query=None) -> DataFrame:
    """Feed items -> raw article rows; the ticker is the file name, the original item is kept as JSON."""
    items = spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM).load(path)
    d = items.withColumn("path", F.col("_metadata.file_path"))
    src = T.blank_to_null(F.trim("source._VALUE"))
    head, pub = T.headline_and_publisher(F.col("title"), F.col("source._VALUE"))
    ticker = F.upper(F.regexp_extract("path", ticker_from_path, 1))
    text = lambda c: T.blank_to_null(F.trim(F.col(c)))
    raw = F.to_json(F.struct(
        (F.lit(query) if query else F.concat(F.lit('"'), ticker, F.lit('"'))).alias("query"), text("title").alias("title"),
        text("link").alias("link"), text("description").alias("description"), text("guid").alias("guid"),
        text("pubDate").alias("pubDate"), F.struct(src.alias("name"), F.col("source._url").alias("url")).alias("source")))
    return d.select(ticker.alias("ticker"), head.alias("headline"), text("description").alias("summary"),
                    text("link").alias("url"), pub.alias("publisher"), text("pubDate").alias("published_at"),
                    F.lit("google_news_rss").alias("source_name"), raw.alias("raw_json"))
