"""Date and time scalars as Column expressions (session time zone UTC)."""
from pyspark.sql import functions as F


def iso_date(x):
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(x, "yyyy-MM-dd"))


def parse_timestamp(x):
    """RFC-822 or ISO text to a UTC timestamp; no zone means UTC. The weekday is not checked."""
    t = F.trim(F.regexp_replace(F.trim(x), r"^[A-Za-z]{3},\s*", ""))
    named = F.regexp_replace(t, r"(?i)\s(UT|UTC|GMT|Z)$", " +0000")
    return F.coalesce(
        F.try_to_timestamp(named, F.lit("d MMM yyyy HH:mm:ss xx")),
        F.try_to_timestamp(named, F.lit("d MMM yyyy HH:mm:ss z")),
        F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss")),
        t.try_cast("timestamp"))


def epoch_date(seconds):
    return F.to_date(F.timestamp_seconds(seconds))


def fiscal_quarter(stored, period):
    return F.coalesce(stored, F.quarter(period))


def gap_days(cur, prev):
    return F.when(prev.isNotNull(), F.greatest(F.datediff(cur, prev), F.lit(1)))


def end_of_day(d):
    return d.cast("timestamp") + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")


def business_days(start, end):
    """Monday to Friday in (start, end], 0 when end <= start. Closed form, no day list."""
    def upto(d):  # weekdays since Monday 1969-12-29, d included
        n = F.unix_date(d) + 4
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))
    return F.when(end > start, upto(end) - upto(start)).when(
        start.isNotNull() & end.isNotNull(), F.lit(0)).cast("int")


def age_days(as_of, d):
    return F.when(d.isNotNull(), F.greatest(F.datediff(as_of, d), F.lit(0)))


def duration_days(start, end):
    return F.when(start.isNull(), F.lit(0)).otherwise(F.greatest(F.datediff(end, start), F.lit(0)))


def reporting_year(fiscal_year, filed_at):
    return F.coalesce(fiscal_year, F.year(filed_at))


def whole_days_ago(anchor_ts, ts):
    return F.greatest(F.floor((F.unix_micros(anchor_ts) - F.unix_micros(ts)) / 86400000000), F.lit(0)).cast("int")


def quarter_token(x):
    return F.regexp_extract(F.upper(F.trim(x)), r"^Q(\d)", 1).try_cast("int")
