"""Jobs: compositions of the operators that read stored tables and write new versions.

A job keeps its tables under one `root` folder. Stages hand over through written tables, not
through long lineage, so a lost executor or a failed stage repeats one stage only.
"""
import json
import time
from datetime import date, timedelta

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from ledgerlens import policies as P
from ledgerlens.operators import aggregates as A, news as N, text as X, upsert as U
from ledgerlens.plans import (behavior_signals as B, changes as G, composite as C, market_signals as M, numeric_signals as Q,
                              quarantine as H, queries as R, sentiment_signals as E, text_signals as T)
from ledgerlens.schemas import TABLES, conform
from ledgerlens.session import cut
from ledgerlens.sources import files, json_payloads, xml_payloads


class Store:
    """Stored tables under a root folder."""

    def __init__(self, spark, root):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table):
        return f"{self.root}/{table}"

    def read(self, table) -> DataFrame:
        return U.read_table(self.spark, self.path(table), TABLES[table])

    def replace(self, table, df):
        """The whole table anew."""
        return U.write_version(self.spark, conform(df, TABLES[table]), self.path(table), U.BUCKETS_BY[table])

    def change(self, table, source, apply):
        """The buckets that source touches hold apply(their rows, source) afterwards."""
        return U.write_change(self.spark, self.path(table), TABLES[table], source, apply, U.BUCKETS_BY[table])

    def upsert(self, table, source, position=None, null_safe=False, keys=None):
        return self.change(table, source, lambda old, new: U.upsert(old, new, keys or U.KEYS[table], position, null_safe))

    def replace_rows(self, table, source, key):
        """All rows of the keys in source are replaced."""
        return self.change(table, conform(source, TABLES[table]), lambda old, new: U.replace_rows(old, new, key))

    def event(self, event_type, layer, detail, at, since=None):
        """since: `time.monotonic()` at the start of what the event tells of."""
        row = self.spark.range(1).select(F.lit(None).cast("bigint").alias("filing_id"))
        U.append_events(U.event_rows(row, event_type, layer, detail, duration_ms=elapsed(since), at=at), self.path("pipeline_events"))

    def events(self):
        return self.spark.read.schema(TABLES["pipeline_events"]).parquet(self.path("pipeline_events"))


def elapsed(since):
    """Milliseconds since a `time.monotonic()`."""
    return None if since is None else int(1000 * (time.monotonic() - since))


def _landed(df):
    """Batch rows with the number they landed with: the caller's `landed`, else the order in which they are read."""
    return df if "landed" in df.columns else df.withColumn("landed", F.monotonically_increasing_id())


def _batch(rows, table):
    """Rows in the table's columns, with their position in the batch; the last of a key wins."""
    return conform(rows, StructType([*TABLES[table].fields, StructField("position", rows.schema["position"].dataType)]))


def _take(store, table, rows, event, layer, step, at, failed=None):
    """Upserts a batch and writes its summary, with what failed, into the event. Returns the summary."""
    src = _batch(rows, table)
    keys = U.KEYS[table]
    summary = U.upsert_summary(store.read(table), src, keys, "position").first().asDict()
    store.upsert(table, src, "position")
    detail = {"step": step, **summary, "failed": failed or []}
    store.event(event, layer, F.lit(json.dumps(detail)), at)
    return detail


# ---------------------------------------------------------------- signals
def text_stage(store, filings, computed_at, tone_scores=None, scorer=None):
    sections = store.read("filing_sections").join(filings.select("filing_id"), "filing_id", "left_semi")  # before a scorer sees them
    emb = store.read("embeddings").join(sections.select(F.col("section_id").alias("filing_section_id"), "section",
                                                        "sequence_idx"), "filing_section_id")
    if tone_scores is None:
        p = T.tone_paragraphs(sections)
        tone_scores = (N.apply_scorer(p, "model_text", scorer) if scorer is not None else p.withColumns(
            {c: F.lit(None).cast("double") for c in ("positive", "negative", "neutral")}))
    return T.text_signals(filings, sections, emb, tone_scores, computed_at)


def numeric_stage(store, filings, computed_at, **_):
    facts = store.read("xbrl_facts")
    return Q.numeric_signals(Q.numeric_features(Q.canonical_facts(filings, facts)), computed_at)


def behavior_stage(store, filings, computed_at, **_):
    f = B.behavior_features(filings, store.read("insider_transactions"))
    return B.behavior_signals(f, store.read("signal_scores"), computed_at)


def market_stage(store, filings, computed_at, **_):
    prices = store.read("market_prices").select("company_id", "trading_date", M.row_price().alias("price"),
                                                F.xxhash64("provider").alias("price_id"))
    raw = Q.canonical_facts(filings, store.read("xbrl_facts"))
    from ledgerlens.functions.scoring import annualise
    fin = raw.select("company_id", "filing_id", "form_type", "filed_at", "shares_outstanding",
                     annualise(F.col("net_income"), F.col("form_type")).alias("net_income"))
    return M.market_signals(M.market_features(filings, prices, store.read("companies"), fin), computed_at)


def sentiment_stage(store, filings, computed_at, **_):
    return E.sentiment_signals(filings, store.read("news_items"), computed_at)


def composite_stage(store, filings, computed_at, **_):
    wide = C.composite_wide(filings, store.read("signal_scores"))
    store.upsert("nci_scores", conform(C.snapshot_rows(wide, computed_at), TABLES["nci_scores"]))
    return C.composite_signals(wide, computed_at)


STAGES = (  # order matters: insiders read tone, the fusion reads everything
    ("text_signals", text_stage, "is_text_signal_scored", "text_signal_scored"),
    ("numeric_signals", numeric_stage, "is_numeric_signal_scored", "numeric_signal_scored"),
    ("insider_signals", behavior_stage, "is_insider_signal_scored", "insider_signal_scored"),
    ("market_signals", market_stage, None, "market_signal_scored"),
    ("sentiment_signals", sentiment_stage, None, "sentiment_signal_scored"),
    ("composite_engine", composite_stage, "is_composite_signal_scored", "composite_scored"),
)


#: Stages whose rows for a filing follow from its own company alone; the others compare companies.
OWN_COMPANY = ("text_signals", "numeric_signals", "insider_signals", "sentiment_signals", "composite_engine")


def run_signals(store: Store, computed_at, company_ids=None, stages=STAGES, changed_only=False, **inputs) -> DataFrame:
    """All stages over all eligible filings, or those of some companies, which then are all that most layers read:
    the companies named, or with `changed_only` those whose inputs changed since the last such run. Each stage writes the scores of its filings; the filings' flags are written once, with the stages that are done,
    also when a stage fails: its event then says so, and the error goes on. In stages that look at one company at a time,
    a company that makes the stage fail is set apart (`quarantine`), with its filings, and left out of the later ones;
    with `changed_only` it is tried again by the next run. Returns the per-stage summary."""
    filings = store.read("filings")
    mine = filings if company_ids is None else filings.where(F.col("company_id").isin(*company_ids))
    read = G.seen(store) if changed_only else {}
    dirty = G.dirty_companies(store) if changed_only else None
    if dirty is not None:
        dirty = dirty.unionByName(H.waiting(store, [name for name, *_ in stages])).distinct()
        mine = cut(mine.join(dirty, "company_id", "left_semi"))
        if mine.isEmpty():
            stages = ()
    scope = mine.where(F.col("form_type").isin(*P.SIGNAL_JOB_FORMS))
    done, bad = [], {}
    try:
        for name, stage, flag, status in stages:
            since = time.monotonic()

            def score(part):
                rows = stage(store, part, computed_at, **inputs).join(_without(scope, bad).select("filing_id"), "filing_id", "left_semi")
                rows = U.assert_owner(store.read("signal_scores"), conform(rows, TABLES["signal_scores"]), U.KEYS["signal_scores"])
                store.upsert("signal_scores", rows)
            try:
                taken = _without(scope, bad)
                failed = H.isolated(score, _without(mine, bad)) if name in OWN_COMPANY else score(filings) or []
            except Exception as error:
                store.event("signal_failed", "processing", F.lit(json.dumps({"step": name, "error": str(error)[:2000]})), computed_at, since)
                raise
            bad.update(failed)
            if failed or not store.read(H.TABLE).where(F.col("step") == name).isEmpty():
                reasons = store.spark.createDataFrame(failed, "company_id long, reason string")  # a few companies, see `isolated`
                tried = taken.join(F.broadcast(reasons), taken["company_id"].eqNullSafe(reasons["company_id"]), "left").select(
                    F.col("filing_id").alias("subject"), "filing_id", taken["company_id"], F.lit(None).cast("string").alias("input_hash"), "reason")
                H.record(store, name, tried, "signal_failed", "processing", computed_at, elapsed(since))
            done.append((flag, status, dict(bad)))
            store.event("composite_scored" if name == "composite_engine" else "signal_scored", "processing",
                        F.to_json(F.struct(F.lit(name).alias("step"))), computed_at, since)
    finally:
        if done:
            marked = scope
            for flag, status, lost in done:
                marked = U.mark_stage(marked, _without(scope, lost), flag, status)
            for company, reason in bad.items():
                marked = marked.withColumn("last_error_message", F.when(F.col("company_id").eqNullSafe(F.lit(company)), F.lit(reason)).otherwise(F.col("last_error_message")))
            store.upsert("filings", marked)
    G.settle(store, read)
    from ledgerlens.plans.rows import with_catalogue
    return A.run_summary(with_catalogue(store.read("signal_scores")))


def _without(filings, companies):
    """filings but those of some few companies."""
    for c in companies:
        filings = filings.where(~F.col("company_id").eqNullSafe(F.lit(c)))
    return filings


def rejected_filings(filings: DataFrame, ids: DataFrame) -> DataFrame:
    """Requested filings the signal job does not take, with the reason."""
    j = ids.join(filings.select("filing_id", "form_type"), "filing_id", "left")
    return j.where(~F.coalesce(F.col("form_type").isin(*P.SIGNAL_JOB_FORMS), F.lit(False))).withColumn(
        "error", F.when(F.col("form_type").isNull(), "filing not found").otherwise(
            F.concat(F.lit("form not supported: "), F.col("form_type"))))


# ---------------------------------------------------------------- ingestion
def run_sections(store: Store, raw_root, at, force=False):
    """Splits filings not extracted yet (all when `force`); failures become a status and a quarantine row, not an
    abort. A text that failed `quarantine.ATTEMPTS` times is left alone unless `force`."""
    since, filings = time.monotonic(), store.read("filings")
    todo = filings if force else filings.where(~F.coalesce("is_extracted", F.lit(False)))
    docs = files.raw_filings(store.spark, raw_root).select("accession_number", "raw_text")
    if not force:
        docs = H.due(store, "filing_splitter", docs.join(todo.select("accession_number", "filing_id"), "accession_number"), "filing_id", "raw_text").drop("filing_id")
    split = X.split_sections(todo.join(docs, "accession_number"))
    rows = X.section_rows(split)
    rows = rows.withColumn("section_id", F.xxhash64("filing_id", "section", "sequence_idx"))
    store.replace_rows("filing_sections", rows, "filing_id")
    found = store.read("filing_sections").select("filing_id").distinct().withColumn("__ok", F.lit(True))
    tried = todo.join(docs.select("accession_number"), "accession_number", "left_semi").select(
        "filing_id", F.lit(True).alias("__tried"))
    j = filings.join(found, "filing_id", "left").join(tried, "filing_id")
    ok, t = F.col("__ok").isNotNull(), F.col("__tried").isNotNull()
    j = (j.withColumn("is_extracted", F.when(t, ok).otherwise(F.col("is_extracted")))
         .withColumn("processing_status", F.when(t & ok, "extracted").when(t, "failed").otherwise(F.col("processing_status")))
         .withColumn("last_error_message", F.when(t & ~ok, "no_sections_found").when(~t, F.col("last_error_message"))))
    held = docs.select("accession_number", H.input_hash(F.col("raw_text")).alias("input_hash"))
    H.record(store, "filing_splitter", todo.join(held, "accession_number").join(found, "filing_id", "left").select(
        F.col("filing_id").alias("subject"), "filing_id", "company_id", "input_hash",
        F.when(F.col("__ok").isNull(), "no_sections_found").alias("reason")), "extraction_failed", "processing", at, elapsed(since))
    store.upsert("filings", conform(j, TABLES["filings"]))
    store.event("extracted", "processing", F.lit('{"step":"filing_splitter"}'), at, since)


def run_embeddings(store: Store, embedder, dimension, provider, model, at, force=False):
    """Chunks and embeds the sections of filings not embedded yet; a filing's rows are replaced."""
    filings = store.read("filings")
    todo = filings if force else filings.where(~F.coalesce("is_embedded", F.lit(False)))
    sections = store.read("filing_sections").join(todo.select("filing_id"), "filing_id", "left_semi")
    chunks = X.chunk_sections(sections)
    rows = N.apply_embedder(chunks, embedder, dimension).select(
        F.col("section_id").alias("filing_section_id"), "company_id", "filing_id", "chunk_idx", "text", "embedding",
        F.lit(provider).alias("provider"), F.lit(model).alias("embedding_model"))
    store.replace_rows("embeddings", rows, "filing_id")
    done = store.read("embeddings").select("filing_id").distinct()
    new = todo.join(done, "filing_id", "left_semi").withColumn("is_embedded", F.lit(True))
    store.upsert("filings", conform(new, TABLES["filings"]))
    store.event("embedded", "processing", F.lit('{"step":"embeddings"}'), at)


def run_facts(store: Store, payloads: DataFrame, at):
    """payloads: company_id, payload. A payload that cannot be read costs its company only."""
    since = time.monotonic()
    payloads = H.due(store, "facts", payloads, "company_id", "payload")
    facts = json_payloads.company_facts(payloads, store.read("filings"))
    facts = facts.withColumn("fact_id", F.xxhash64(*U.KEYS["xbrl_facts"])).withColumn("created_at", at)
    store.upsert("xbrl_facts", conform(facts, TABLES["xbrl_facts"]), null_safe=True)
    hit = facts.where(F.col("filing_id").isNotNull()).select("filing_id")
    new = store.read("filings").where(~F.coalesce("is_xbrl_parsed", F.lit(False))).join(hit, "filing_id", "left_semi")
    store.upsert("filings", conform(new.withColumn("is_xbrl_parsed", F.lit(True)), TABLES["filings"]))
    H.record(store, "facts", payloads.select(
        F.col("company_id").alias("subject"), F.lit(None).cast("bigint").alias("filing_id"), "company_id",
        H.input_hash(F.col("payload")).alias("input_hash"), json_payloads.facts_fault(F.col("payload")).alias("reason")), "xbrl_failed", "processing", at, elapsed(since))
    store.event("xbrl_parsed", "processing", F.lit('{"step":"facts"}'), at, since)


def run_insiders(store: Store, documents: DataFrame, at):
    """documents: filing_id, xml. Parses reports not parsed yet. One that gives no row is left pending, with the reason
    in its filing, an event and the quarantine, and tried again until it has failed `quarantine.ATTEMPTS` times."""
    since = time.monotonic()
    f = store.read("filings").where(F.col("form_type").isin(*P.INSIDER_FORMS)
                                    & ~F.coalesce("is_form4_parsed", F.lit(False)))
    c = store.read("companies").select("company_id", "cik", "ticker", F.col("name").alias("issuer_name"))
    docs = (f.join(H.due(store, "form4_parser", _landed(documents), "filing_id", "xml"), "filing_id").join(c, "company_id").withColumn("source_url", F.lit(None).cast("string")))
    rows = xml_payloads.insider_transactions(docs)
    rows = rows.withColumn("transaction_id", F.xxhash64("transaction_uid")).join(docs.select("filing_id", "landed"), "filing_id")
    src = _batch(rows.withColumn("position", F.struct("landed", "transaction_uid")), "insider_transactions")
    store.change("insider_transactions", src, lambda old, new: U.upsert_insider(old, new, "position"))
    given = store.read("insider_transactions").select("filing_id").distinct().withColumn("__ok", F.lit(True))
    ok = F.col("__ok").isNotNull()
    H.record(store, "form4_parser", docs.join(given, "filing_id", "left").select(
        F.col("filing_id").alias("subject"), "filing_id", "company_id", H.input_hash(F.col("xml")).alias("input_hash"),
        F.when(~ok, xml_payloads.report_fault(F.col("xml"))).alias("reason")), "form4_failed", "processing", at, elapsed(since))
    why = store.read(H.TABLE).where(F.col("step") == "form4_parser").select("filing_id", F.col("reason").alias("__why"))
    new = f.join(given, "filing_id", "left").join(why, "filing_id", "left").where(ok | F.col("__why").isNotNull())
    new = new.withColumns({"is_form4_parsed": ok, "processing_status": F.when(ok, "form4_parsed").otherwise("failed"),
                           "last_error_message": F.when(~ok, F.col("__why"))})
    store.upsert("filings", conform(new, TABLES["filings"]))
    store.event("form4_parsed", "processing", F.lit('{"step":"form4_parser"}'), at, since)


def run_news(store: Store, raw: DataFrame, at, scorer=None):
    """Returns selected, deduped_in_batch, inserted, updated and stored."""
    news = files.normalise_news(_landed(raw), at)
    c = store.read("companies").select("company_id", "ticker")
    news = N.model_text(news.join(c, "ticker"))
    if scorer is not None:
        news = N.score_news(N.apply_scorer(news, "model_text", scorer))
    return _take(store, "news_items", news.withColumn("position", F.col("landed")), "news_ingested", "polling", "news", at)


def run_news_backfill(store: Store, scorer, at):
    """Scores stored articles that have no score."""
    todo = N.model_text(N.needs_score(store.read("news_items")))
    store.upsert("news_items", conform(N.score_news(N.apply_scorer(todo, "model_text", scorer)), TABLES["news_items"]))
    store.event("news_sentiment_backfilled", "polling", F.lit('{"step":"news_backfill"}'), at)


def price_range(end=None, start=None, today=None):
    """Default range: the 365 days up to the end."""
    end = end or today or date.today()
    start = start or end - timedelta(days=365)
    if start > end:
        raise ValueError("start date must be on or before end date")
    return start, end


def market_symbol(ticker, symbol=None):
    if symbol:
        return symbol.strip().upper()
    t = (ticker or "").strip().upper()
    if t and not t.isdigit():
        return t
    raise ValueError("no market symbol: pass one")


def run_prices(store: Store, payloads: DataFrame, at, start=None, end=None):
    """payloads: ticker, provider, payload. A payload with an error costs its ticker only, which the summary
    names as failed. Fails when the range holds no row at all."""
    rows = json_payloads.price_chart(_landed(payloads), strict=False)
    failed = payloads.select("ticker").distinct().join(rows.select("ticker").distinct(), "ticker", "left_anti")
    if start or end:
        lo, hi = price_range(end, start)
        rows = rows.where(F.col("trading_date").between(F.lit(lo), F.lit(hi)))
    rows = rows.join(store.read("companies").select("company_id", "ticker"), "ticker").withColumn("retrieved_at", at)
    if rows.isEmpty():
        raise ValueError("no market price rows in the payloads")
    lost = sorted(r.ticker for r in failed.where("ticker is not null").collect())  # one name a payload, of one request batch
    return _take(store, "market_prices", rows, "market_prices_ingested", "polling", "prices", at, lost)


def run_macro(store: Store, meta: DataFrame, observations: DataFrame, at, series=P.DEFAULT_MACRO_SERIES) -> DataFrame:
    """Returns fetched rows per series."""
    wanted = [s.strip().upper() for s in series if s.strip()]
    if not wanted:
        raise ValueError("give at least one series")
    rows = json_payloads.macro_series(meta, _landed(observations)).where(F.col("series_id").isin(*wanted)).withColumn("retrieved_at", at)
    _take(store, "macro_observations", rows, "macro_observations_ingested", "polling", "macro", at)
    return rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("fetched"))


def run_filing_job(store: Store, index: DataFrame, raw_root, facts, at, embedder, dimension, scorer=None):
    """Index -> filings -> sections -> facts -> embeddings -> signals.

    index: rows of `filing_index` plus company_id. Oldest-first order of the single-filing form is
    not needed: each layer sees the whole history at once."""
    from ledgerlens.functions.strings import storage_key
    f = index.withColumn("raw_key", storage_key(F.col("cik"), F.col("form_type"), F.col("accession_number"))).withColumn(
        "raw_size_bytes", F.col("file_size_bytes"))
    f = f.withColumn("filing_id", F.xxhash64("accession_number"))
    for flag in ("is_extracted", "is_xbrl_parsed", "is_embedded", "is_form4_parsed", "is_signal_scored",
                 "is_text_signal_scored", "is_numeric_signal_scored", "is_insider_signal_scored",
                 "is_composite_signal_scored"):
        f = f.withColumn(flag, F.lit(False))
    src = conform(f, TABLES["filings"]).withColumn("position", F.col("accession_number"))
    store.change("filings", src, lambda old, new: U.insert_filings_if_absent(old, new, "position"))
    run_sections(store, raw_root, at)
    run_facts(store, facts, at)
    run_embeddings(store, embedder, dimension, "local", "model", at)
    return run_signals(store, at, scorer=scorer)


def run_text_job(store: Store, raw_root, at, embedder, dimension):
    run_sections(store, raw_root, at)
    run_embeddings(store, embedder, dimension, "local", "model", at)


def run_backfill(steps, store: Store, at):
    """Named steps in order (annual filings, quarterly filings, insiders, news, prices, macro), then
    one event. steps: ordered (name, callable without arguments)."""
    done = []
    for name, step in steps:
        step()
        done.append(name)
    store.event("company_backfilled", "pipeline", F.to_json(F.struct(F.array(*[F.lit(n) for n in done]).alias("steps"))), at)
    return done


def run_validation_report(store: Store, tickers, out) -> DataFrame:
    """Raw, yearly and flag CSVs and the summary text; returns the flags."""
    names = [t.strip().upper() for t in tickers if t and t.strip()]
    if not names:
        raise ValueError("give at least one ticker")
    raw = R.validation_records(store.read("nci_scores"), store.read("companies"), store.read("filings"), names)
    yearly = A.yearly_signals(raw)
    flags = A.signal_flags(yearly)
    U.write_csv(raw.drop("seq"), f"{out}/raw")
    U.write_csv(yearly, f"{out}/yearly")
    U.write_csv(flags, f"{out}/flags")
    U.write_validation_summary(flags, f"{out}/summary")
    return flags
