"""One row per key. `row_number() <= k` plans a per-task WindowGroupLimit ahead of the
shuffle, so a hot key ships at most k rows per map task."""
from pyspark.sql import DataFrame, Window, functions as F


def top_per_key(df: DataFrame, keys, order, k=1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")


def latest_per_key(df, keys, *order):
    return top_per_key(df, keys, [F.col(c).desc() for c in order])


def keep_first(df, keys, *order):
    return top_per_key(df, keys, [F.col(c).asc() for c in order])


def keep_last_in_batch(df, keys, position, drop_keyless=True):
    """Last occurrence per key in batch order; rows with a NULL key part are dropped."""
    if drop_keyless:
        df = df.na.drop(subset=list(keys))
    return latest_per_key(df, keys, position)


FACT_KEY = ("company_id", "taxonomy", "concept", "period_type", "period_start", "period_end",
            "unit", "form_type")


def keep_best_fact(facts, position, annual_forms, keys=FACT_KEY):
    """A filing beats none, an annual form beats others, then the longer duration;
    remaining ties keep the earliest in source order."""
    from ledgerlens.functions.dates import duration_days
    return top_per_key(facts, keys, [
        F.col("filing_id").isNotNull().desc(),
        F.col("form_type").isin(*annual_forms).desc_nulls_last(),
        duration_days(F.col("period_start"), F.col("period_end")).desc(),
        F.col(position).asc()])


# which transactions count as one economic event (the storage key also has the security title)
ECONOMIC_KEY = ("accession_number", "insider_name", "transaction_date", "transaction_code", "shares",
                "price_per_share", "ownership_nature", "acquired_disposed_code", "is_derivative")


def economic_transactions(trades):
    """Earliest row per (company and) economic key."""
    return keep_first(trades, ("company_id",) + ECONOMIC_KEY, "transaction_id")
