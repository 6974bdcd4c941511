"""Rerun-safe writes by natural key.

`upsert` and its kin return the new table state as a plan. `write_upsert`, `write_replace` and
`write_change` apply them to a stored table, of which they rewrite only the buckets the batch
touches (see `buckets`).
"""
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ledgerlens.functions import strings as T
from ledgerlens.operators import buckets as B
from ledgerlens.operators.dedupe import keep_last_in_batch, top_per_key

KEYS = {  # natural keys
    "companies": ("cik",),
    "filings": ("accession_number",),
    "filing_sections": ("filing_id", "section", "sequence_idx"),
    "xbrl_facts": ("company_id", "taxonomy", "concept", "period_type", "period_start", "period_end",
                   "unit", "form_type"),
    "embeddings": ("filing_section_id", "chunk_idx"),
    "insider_transactions": ("transaction_uid",),
    "signal_scores": ("filing_id", "signal_name"),
    "nci_scores": ("company_id", "filing_id", "event_type"),
    "news_items": ("company_id", "dedupe_hash"),
    "market_prices": ("company_id", "trading_date", "provider"),
    "macro_observations": ("series_id", "observation_date", "provider"),
    "quarantine": ("step", "subject"),
}
#: Columns whose hash gives a row's bucket: rows that may replace each other share them.
BUCKETS_BY = {**KEYS, "filing_sections": ("filing_id",), "embeddings": ("filing_id",), "insider_transactions": ("accession_number",),
              "signal_scores": ("filing_id",), "nci_scores": ("company_id",)}
INSIDER_BUSINESS_KEY = ("accession_number", "insider_name", "transaction_date", "transaction_code", "shares",
                        "price_per_share", "security_title", "ownership_nature", "acquired_disposed_code",
                        "is_derivative")


def _same_key(keys, null_safe):
    """Condition on the aliases t and s; NULL equals NULL when `null_safe`."""
    return reduce(lambda a, b: a & b, [
        F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) if null_safe else F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys])


def upsert(target: DataFrame, source: DataFrame, keys, position=None, null_safe=False) -> DataFrame:
    """Target rows whose key the batch does not bring, plus the batch (last row per key)."""
    if position:
        source = (top_per_key(source, keys, [F.col(position).desc()]) if null_safe
                  else keep_last_in_batch(source, keys, position))
    source = source.select(*target.columns)
    t, s = target.alias("t"), source.select(*keys).alias("s")
    return t.join(s, _same_key(keys, null_safe), "left_anti").select("t.*").unionByName(source)


def upsert_summary(target: DataFrame, source: DataFrame, keys, position, null_safe=False) -> DataFrame:
    """One row: selected, deduped_in_batch, inserted, updated, stored."""
    unique = (top_per_key(source, keys, [F.col(position).desc()]) if null_safe
              else keep_last_in_batch(source, keys, position))
    have = target.select(*keys, F.lit(1).alias("__have")).alias("t")
    u = unique.select(*keys).alias("s")
    j = u.join(have, _same_key(keys, null_safe), "left").agg(F.count(F.lit(1)).alias("stored"), F.count("__have").alias("updated"))
    n = source.agg(F.count(F.lit(1)).alias("selected"))
    # two single-row results side by side
    return (n.withColumn("__k", F.lit(1)).join(j.withColumn("__k", F.lit(1)), "__k")
            .select("selected", (F.col("selected") - F.col("stored")).alias("deduped_in_batch"),
                    (F.col("stored") - F.col("updated")).alias("inserted"), "updated", "stored"))


def upsert_insider(target: DataFrame, source: DataFrame, position) -> DataFrame:
    """Match by uid, else by the business key; the batch row (with its uid) replaces either."""
    src = top_per_key(source, ["transaction_uid"], [F.col(position).desc()])
    src = _with_business_key(src)
    src = top_per_key(src, ["__bk"], [F.col(position).desc()])
    tgt = _with_business_key(target)
    by_uid = tgt.join(src.select("transaction_uid"), "transaction_uid", "left_anti")
    # a batch row already matched by uid does not also take over a second row by business key
    free = src.join(target.select("transaction_uid"), "transaction_uid", "left_anti").select("__bk")
    kept = by_uid.join(free, "__bk", "left_anti")
    return kept.select(*target.columns).unionByName(src.select(*target.columns))


def _with_business_key(df):
    nums = ("shares", "price_per_share")
    part = lambda k: F.coalesce(
        T.number_text(F.col(k)) if k in nums
        else F.trim(F.coalesce(F.col(k).cast("string"), F.lit(""))) if k == "security_title"
        else F.col(k).cast("string"), F.lit("\u0000"))
    return df.withColumn("__bk", F.concat_ws("\u0001", *[part(k) for k in INSIDER_BUSINESS_KEY]))


def upsert_companies(target: DataFrame, meta: DataFrame) -> DataFrame:
    """Key cik; industry code, description and exchange keep the old value when the new one is empty."""
    t, m = target.alias("t"), meta.alias("m")
    j = t.join(m, F.col("t.cik") == F.col("m.cik"), "full_outer")
    new = F.col("m.cik").isNotNull()
    fill = lambda c: F.coalesce(T.blank_to_null(F.col(f"m.{c}")), F.col(f"t.{c}"))
    out = {"cik": F.coalesce("m.cik", "t.cik"), "ticker": F.when(new, F.upper("m.ticker")).otherwise(F.col("t.ticker")),
           "name": F.when(new, F.col("m.name")).otherwise(F.col("t.name")), "sic_code": fill("sic_code"),
           "sic_description": fill("sic_description"), "exchange": fill("exchange")}
    rest = [c for c in target.columns if c not in out]
    return j.select(*[v.alias(k) for k, v in out.items()], *[F.col(f"t.{c}") for c in rest])


def insert_filings_if_absent(target: DataFrame, filings: DataFrame, position) -> DataFrame:
    """The first write per accession wins; fiscal year and quarter follow from the period."""
    new = (filings.withColumn("fiscal_year", F.year("period_of_report"))
           .withColumn("fiscal_quarter", F.quarter("period_of_report")))
    new = top_per_key(new, ["accession_number"], [F.col(position).asc()])
    fresh = new.join(target.select("accession_number"), "accession_number", "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def replace_rows(target: DataFrame, source: DataFrame, key) -> DataFrame:
    """All rows of the keys present in the batch are replaced (sections, embeddings of a filing)."""
    return target.join(source.select(key).distinct(), key, "left_anti").unionByName(source.select(*target.columns))


def existing(target: DataFrame, batch: DataFrame, keys) -> DataFrame:
    return target.join(batch.select(*keys).distinct(), list(keys), "left_semi")


def existing_in_range(target: DataFrame, batch: DataFrame, series, day) -> DataFrame:
    """Target rows between the batch's first and last day per series."""
    lim = batch.groupBy(*series).agg(F.min(day).alias("__lo"), F.max(day).alias("__hi"))
    return (target.join(lim, list(series)).where(F.col(day).between(F.col("__lo"), F.col("__hi")))
            .drop("__lo", "__hi"))


def assert_owner(target: DataFrame, source: DataFrame, keys, owner="company_id") -> DataFrame:
    """The batch unchanged; the job fails when a key already belongs to another owner."""
    have = target.select(*keys, F.col(owner).alias("__owner"))
    bad = F.col("__owner").isNotNull() & (F.col("__owner") != F.col(owner))
    check = F.when(bad, F.raise_error(F.concat(F.lit("key already belongs to company "),
                                               F.col("__owner").cast("string"))).cast("boolean")).otherwise(True)
    return source.join(have, list(keys), "left").where(check).drop("__owner")


def mark_stage(filings: DataFrame, done: DataFrame, stage: str | None, status: str) -> DataFrame:
    """Sets one stage flag, the overall flag (all four stages) and the status of the filings in `done`."""
    stages = ["is_text_signal_scored", "is_numeric_signal_scored", "is_insider_signal_scored",
              "is_composite_signal_scored"]
    j = filings.join(done.select("filing_id", F.lit(True).alias("__done")).distinct(), "filing_id", "left")
    hit = F.col("__done").isNotNull()
    if stage:
        j = j.withColumn(stage, F.col(stage) | hit)
    overall = reduce(lambda a, b: a & b, [F.col(s) for s in stages])
    return (j.withColumn("is_signal_scored", F.when(hit, overall).otherwise(F.col("is_signal_scored")))
            .withColumn("processing_status", F.when(hit, F.lit(status)).otherwise(F.col("processing_status")))
            .withColumn("last_error_message", F.when(~hit, F.col("last_error_message")))
            .select(*filings.columns))


def event_rows(df: DataFrame, event_type, layer, detail, filing=None, company=None, duration_ms=None, at=None):
    """Audit rows in the event-log shape; `detail` is a JSON Column."""
    n = F.lit(None)
    return df.select((F.col(filing) if filing else n).cast("bigint").alias("filing_id"),
                     (F.col(company) if company else n).cast("bigint").alias("company_id"),
                     F.lit(event_type).alias("event_type"), F.lit(layer).alias("layer"),
                     (F.lit(duration_ms) if duration_ms is not None else n).cast("int").alias("duration_ms"),
                     detail.alias("detail"), (at if at is not None else F.current_timestamp()).alias("occurred_at"))


def append_events(events: DataFrame, path):
    events.write.mode("append").parquet(path)


# ---------------------------------------------------------------- stored tables
def read_table(spark, path, schema):
    """Current version of a table, empty when none was written."""
    return B.read(spark, path, schema)


def write_version(spark, df: DataFrame, path, by, buckets=None):
    """The whole table anew, by buckets of the columns `by`."""
    return B.write(spark, df, path, by, buckets)


def write_change(spark, path, schema, source, apply, by, buckets=None):
    """The buckets of the batch hold apply(their rows, batch) afterwards, all others keep their files."""
    return B.change(spark, path, schema, source, apply, by, buckets)


def write_upsert(spark, path, schema, source, keys, position=None, null_safe=False, by=None, buckets=None):
    """by: columns of the key, all of it by default."""
    return B.change(spark, path, schema, source, lambda old, new: upsert(old, new, keys, position, null_safe), by or keys, buckets)


def write_replace(spark, path, schema, source, key, buckets=None):
    """All rows of the keys in the batch are replaced, in the buckets of those keys."""
    return B.change(spark, path, schema, source, lambda old, new: replace_rows(old, new, key), (key,), buckets)


def write_csv(df: DataFrame, path):
    """Header row, NULL as empty; one folder of part files."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_validation_summary(flags: DataFrame, path):
    """Per ticker a verdict table as text lines, in ticker and signal order."""
    line = F.concat(F.lit("| "), F.col("signal_label"), F.lit(" | "), F.col("verdict"), F.lit(" | "),
                    F.coalesce(F.format_string("%.3f", F.col("range_value")), F.lit("")), F.lit(" | "),
                    F.col("recommendation"), F.lit(" |"))
    heads = flags.select("ticker").distinct().select("ticker", F.lit("").alias("signal_key"), F.explode(F.array(
        F.struct(F.lit(0).alias("i"), F.concat(F.lit("## "), F.col("ticker")).alias("value")),
        F.struct(F.lit(1).alias("i"), F.lit("").alias("value")),
        F.struct(F.lit(2).alias("i"), F.lit("| Signal | Verdict | Range | Recommendation |").alias("value")),
        F.struct(F.lit(3).alias("i"), F.lit("| --- | --- | --- | --- |").alias("value")))).alias("x"))
    rows = heads.select("ticker", "signal_key", "x.i", "x.value").unionByName(
        flags.select("ticker", "signal_key", F.lit(9).alias("i"), line.alias("value")))
    rows.orderBy("ticker", "signal_key", "i").select("value").write.mode("overwrite").text(path)
