"""Which companies a signal run has to score again.

A run pins the version it read of each input table. The next one compares those with the last versions,
bucket by bucket, and takes the companies of the rows that differ. All layers look at one company's rows,
however far back; only valuation compares the companies of a sector, so a change of what it reads spreads
to the sector.
"""
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ledgerlens.operators import buckets as B
from ledgerlens.schemas import TABLES

READER = "signals"
#: Inputs of the layers, and the columns whose change is none: written by the jobs themselves, or clocks.
INPUTS = ("companies", "filings", "filing_sections", "embeddings", "xbrl_facts", "insider_transactions", "market_prices", "news_items")
SECTOR_INPUTS = ("companies", "filings", "xbrl_facts", "market_prices")
_OWN = ("processing_status", "last_error_message", "created_at", "updated_at", "retrieved_at")


def compared(table):
    return [f.name for f in TABLES[table].fields if f.name not in _OWN and not (table == "filings" and f.name.startswith("is_"))]


def seen(store) -> dict[str, int]:
    """The last version of each input that has one; kept for this run until `settle`."""
    out = {t: v[-1] for t in INPUTS if (v := B.versions(store.spark, store.path(t)))}
    for t, version in out.items():
        B.pin(store.spark, store.path(t), f"{READER}.running", version)
    return out


def settle(store, read: dict[str, int]) -> None:
    """What a finished run has read is what the next one compares with."""
    for t, version in read.items():
        B.pin(store.spark, store.path(t), READER, version)
        B.pin(store.spark, store.path(t), f"{READER}.running", None)


def dirty_companies(store) -> DataFrame | None:
    """company_id of the companies to score again; None for all of them, when some input was never compared."""
    spark, found = store.spark, {}
    for t in INPUTS:
        path = store.path(t)
        if not B.versions(spark, path):
            continue
        since = B.pinned(spark, path).get(READER)
        rows = None if since is None else B.difference(spark, path, TABLES[t], since, compared(t))
        if rows is None:
            return None
        found[t] = rows.where("company_id is not null").select("company_id").distinct()
    if not found:
        return None
    own = reduce(DataFrame.unionByName, found.values())
    spreading = [found[t] for t in SECTOR_INPUTS if t in found]
    if spreading:
        companies = store.read("companies").where(F.coalesce("sector", F.lit("")) != "").select("company_id", "sector")
        sectors = companies.join(reduce(DataFrame.unionByName, spreading), "company_id", "left_semi").select("sector").distinct()
        own = own.unionByName(companies.join(sectors, "sector", "left_semi").select("company_id"))
    return own.distinct()
