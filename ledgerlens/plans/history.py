"""Comparable filings: bounded history per filing, previous filing per section."""
from pyspark.sql import DataFrame, functions as F

from ledgerlens import policies as P
from ledgerlens.functions import dates as D
from ledgerlens.operators import ordered as O


def form_class(form):
    return (F.when(form.isin(*P.ANNUAL_FORMS), "annual").when(form.isin(*P.QUARTERLY_FORMS), "quarterly")
            .otherwise(F.concat(F.lit("form:"), form)))


def with_history(filings: DataFrame, payload, limit=P.HISTORY_LIMIT, hot_rows=O.AUTO) -> DataFrame:
    """Adds `history`: the comparable filings up to and including the row itself, oldest first.

    Annual and other forms: the last `limit` of the class. Quarterly: of the last
    max(4*limit, 24) those of the same fiscal quarter if at least two, else simply the last
    `limit`. `payload` names the columns each entry carries (always filing_id, quarter).
    """
    span = max(limit * 4, 24)
    d = (filings.withColumn("__class", form_class(F.col("form_type")))
         .withColumn("__quarter", D.fiscal_quarter(F.col("fiscal_quarter"), F.col("period_of_report"))))
    entry = F.struct("filing_id", F.col("__quarter").alias("quarter"), *payload)
    d = O.trailing(d, ["company_id", "__class"], O.Order.by_day("filed_at", "filing_id"), span - 1,
                   lambda w: {"__all": F.collect_list(entry).over(w.rowsBetween(1 - span, 0))}, hot_rows)
    last = lambda a: F.slice(a, F.greatest(F.size(a) - limit + 1, F.lit(1)), F.lit(limit))
    same = F.filter("__all", lambda h: h["quarter"] == F.col("__quarter"))
    hist = F.when((F.col("__class") == "quarterly") & (F.size(same) >= 2), last(same)).otherwise(last(F.col("__all")))
    return d.withColumn("history", hist).drop("__all")


def comparison_filings(filings: DataFrame, section, hot_rows=O.AUTO) -> DataFrame:
    """Previous filing each section is compared with: strictly earlier day, highest id of that day.
    Quarterly risk text looks at the latest annual filing, quarterly discussion at the previous
    quarterly one; annual and other forms at the previous annual filing."""
    quarterly = F.col("form_type").isin(*P.QUARTERLY_FORMS)
    want = F.when(quarterly & F.lit(section == "mda"), "quarterly").otherwise("annual")
    left = filings.withColumn("__want", want)
    right = (filings.select("company_id", form_class(F.col("form_type")).alias("__want"), "filed_at", "filing_id",
                            "accession_number")
             .where(F.col("__want").isin("annual", "quarterly")))
    out = O.asof(left, right, ["company_id", "__want"], "filed_at", "filed_at", "filing_id",
                 ["filing_id", "filed_at", "accession_number"], strict=True, hot_rows=hot_rows)
    return out.select(*filings.columns, F.col("asof.filing_id").alias("previous_filing_id"),
                      F.col("asof.filed_at").alias("previous_filed_at"),
                      F.col("asof.accession_number").alias("previous_accession_number"),
                      D.gap_days(F.col("filed_at"), F.col("asof.filed_at")).alias("days_between_filings"),
                      F.when(quarterly & F.lit(section == "mda"), "prior_quarter_mda")
                      .when(quarterly, "most_recent_annual_risk_baseline")
                      .otherwise("prior_annual_same_section").alias("comparison_basis"))
