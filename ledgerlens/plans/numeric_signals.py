"""Numeric layer: facts -> metrics -> comparable history -> five signals."""
from pyspark.sql import DataFrame, functions as F

from ledgerlens import policies as P
from ledgerlens.functions import scoring as S
from ledgerlens.operators import aggregates as A, ordered as O
from ledgerlens.plans.history import with_history
from ledgerlens.plans.rows import signal_rows

VERSION = "numeric_v4"
METRICS = ("revenue", "gross_margin", "operating_margin", "net_margin", "debt_to_equity", "cash_ratio", "cf_quality",
           "cash_conversion_ratio", "accruals_ratio", "operating_cash_flow", "net_income", "assets",
           "shares_outstanding")


def canonical_facts(filings, facts):
    """Filings with one column per canonical fact (NULL when no candidate)."""
    return filings.join(A.best_facts(filings, facts), "filing_id", "left")


def numeric_features(raw: DataFrame, growth_basis="reference", hot_rows=O.AUTO) -> DataFrame:
    """raw: filings with the canonical fact columns -> one row per filing with current, prior and
    two-back metrics and anomaly z-scores, all taken inside the filing's own history.

    growth_basis "reference" compares the unscaled revenue of the period with the annualised
    revenue before it (quarterly growth is biased low); "annualised" compares like with like.
    """
    facts = {k: F.col(k).cast("double") for k in P.FACT_ALIASES}
    d = raw.withColumns({f"m_{k}": v for k, v in S.period_metrics(facts, F.col("form_type")).items()})
    d = d.withColumn("raw_revenue", facts["revenue"] if growth_basis == "reference" else F.col("m_revenue"))
    d = with_history(d, [*[f"m_{k}" for k in METRICS], "raw_revenue"], hot_rows=hot_rows)
    with_growth = F.transform("history", lambda h, i: F.struct(
        h["filing_id"].alias("filing_id"), h["quarter"].alias("quarter"),
        *[h[f"m_{k}"].alias(k) for k in METRICS],
        F.when(i > 0, S.growth(h["raw_revenue"], F.get("history", i - 1)[f"m_revenue"])).alias("revenue_growth")))
    d = d.withColumn("h", with_growth).withColumn("n", F.size("h"))
    back = lambda j, k: F.get("h", F.col("n") - 1 - j)[k]
    cols = {}
    for k in (*METRICS, "revenue_growth"):
        cols[f"{k}_current"], cols[f"{k}_prior"] = back(0, k), back(1, k)
    for k in ("gross_margin", "operating_margin", "net_margin"):
        cols[f"{k}_delta"] = back(0, k) - back(1, k)
    cols["revenue_growth_two_back"] = back(2, "revenue_growth")
    cols["comparison_filing_id"] = back(1, "filing_id")
    cols["history_depth"] = F.col("n") - 1
    cols["no_facts"] = F.coalesce(*facts.values()).isNull()
    # anomaly history: earlier entries; for quarterly filings of the same quarter only
    earlier = F.slice("h", 1, F.greatest(F.col("n") - 1, F.lit(0)))
    cols["base"] = F.when(F.col("__class") == "quarterly",
                          F.filter(earlier, lambda h: h["quarter"] == F.col("__quarter"))).otherwise(earlier)
    d = d.withColumns(cols)
    stats = {}
    for m in P.ANOMALY_METRICS:
        vals = F.filter(F.transform("base", lambda h: h[m]), lambda x: x.isNotNull())
        d = d.withColumn(f"v_{m}", vals).withColumn(f"n_{m}", F.size(f"v_{m}"))
        total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x))
        d = d.withColumn(f"mean_{m}", F.try_divide(total(F.col(f"v_{m}"), lambda x: x), F.col(f"n_{m}")))
        mean = F.col(f"mean_{m}")
        d = d.withColumn(f"std_{m}", F.sqrt(F.try_divide(
            total(F.col(f"v_{m}"), lambda x: (x - mean) * (x - mean)), F.col(f"n_{m}"))))
        stats[m] = (F.col(f"n_{m}"), mean, F.col(f"std_{m}"))
    zs = A.z_scores({m: F.col(f"{m}_current") for m in P.ANOMALY_METRICS}, stats, F.size("base"))
    d = d.withColumn("anomaly_history_count", F.size("base"))
    d = d.withColumns({f"{m}_zscore": z for m, z in zs.items()})
    z = {m: F.col(f"{m}_zscore") for m in P.ANOMALY_METRICS}
    d = d.withColumn("numeric_anomaly_distance", A.rms(z)).withColumn(
        "anomaly_metric_count", S.sum_cols([S.defined(c) for c in z.values()]))
    helper = [c for c in d.columns if c.startswith(("v_", "n_", "mean_", "std_", "m_", "__"))]
    return d.drop("history", "h", "n", "base", "raw_revenue", *helper)


def score_components():
    """{signal: {component: Column}} over the feature columns."""
    c = F.col
    consistency = S.weighted_average({
        "cash_conversion_shift": S.absolute_shift_score(
            c("cash_conversion_ratio_current") - c("cash_conversion_ratio_prior"), 1.0),
        "accruals_shift": S.absolute_shift_score(c("accruals_ratio_current") - c("accruals_ratio_prior"), 0.10),
    }, P.CONSISTENCY_WEIGHTS)
    return {
        "fundamental_deterioration": {
            k: S.negative_delta_score(c(f"{k}_delta"), 0.20) for k in P.MARGIN_WEIGHTS},
        "revenue_growth_deceleration": {"deceleration": c("revenue_growth_prior") - c("revenue_growth_current")},
        "balance_sheet_stress": {
            "leverage_score": S.positive_shift_score(c("debt_to_equity_current") - c("debt_to_equity_prior"), 1.0),
            "cash_score": S.positive_shift_score(c("cash_ratio_prior") - c("cash_ratio_current"), 0.10),
            "cf_quality_score": S.cash_flow_quality_score(c("cf_quality_current"))},
        "earnings_quality": {
            "accruals_score": S.positive_shift_score(c("accruals_ratio_current"), 0.10),
            "cash_conversion_score": S.conversion_weakness_score(c("cash_conversion_ratio_current")),
            "consistency_score": consistency},
        "numeric_anomaly": {"anomaly_distance": c("numeric_anomaly_distance"),
                            **{f"{m}_zscore": c(f"{m}_zscore") for m in P.ANOMALY_METRICS}},
    }


def signal_values(parts=None):
    p = parts or score_components()
    return {
        "fundamental_deterioration": S.weighted_average(p["fundamental_deterioration"], P.MARGIN_WEIGHTS),
        "revenue_growth_deceleration": S.positive_shift_score(
            p["revenue_growth_deceleration"]["deceleration"], 0.30),
        "balance_sheet_stress": S.weighted_average(p["balance_sheet_stress"], P.BALANCE_WEIGHTS),
        "earnings_quality": S.weighted_average(p["earnings_quality"], P.EARNINGS_WEIGHTS),
        "numeric_anomaly": S.clip01(p["numeric_anomaly"]["anomaly_distance"] / 3.0),
    }


def scored(features: DataFrame):
    """Components and values as columns of their own (c_*, s_*), computed once per row."""
    parts = score_components()
    cols = {f"c_{sig}_{k}": c for sig, comps in parts.items() for k, c in comps.items()}
    d = features.withColumns(cols)
    parts = {sig: {k: F.col(f"c_{sig}_{k}") for k in comps} for sig, comps in parts.items()}
    d = d.withColumns({f"s_{n}": F.when(~F.col("no_facts"), v) for n, v in signal_values(parts).items()})
    return d, parts


def numeric_signals(features: DataFrame, computed_at) -> DataFrame:
    d, parts = scored(features)
    specs = {}
    for name, comps in parts.items():
        cover = S.defined_ratio(comps.values())
        specs[name] = (F.col(f"s_{name}"), {
            "coverage_ratio": cover, "confidence": S.numeric_confidence(F.col("history_depth"), cover),
            "history_depth": F.col("history_depth"), "comparison_filing_id": F.col("comparison_filing_id"),
            "component_scores": F.struct(*[v.alias(k) for k, v in comps.items()]),
            "signal_category": F.lit("numbers"), "signal_role": F.lit("base")},
            F.when(F.col("no_facts"), "no_xbrl_facts").otherwise("insufficient_numeric_history"))
    return signal_rows(d, specs, VERSION, computed_at)
