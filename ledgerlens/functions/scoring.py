"""Score arithmetic as Column expressions. NULL means "could not be computed"
and always propagates; 0.0 means "computed and neutral"."""
from functools import reduce

from pyspark.sql import Column, functions as F

from ledgerlens import policies as P


def _c(x):
    return x if isinstance(x, Column) else F.col(x)


def lit_d(v):
    return F.lit(float(v))


def clip(x, lo, hi):
    # least/greatest skip NULL arguments, hence the guard
    return F.when(x.isNotNull(), F.least(lit_d(hi), F.greatest(lit_d(lo), x)))


def clip01(x):
    return clip(x, 0.0, 1.0)


def safe_divide(a, b):
    return F.try_divide(a, b)


def growth(cur, prev):
    return F.try_divide(cur - prev, prev)


def annualise(value, form_type):
    return F.when(form_type.isin(*P.QUARTERLY_FORMS), value * 4.0).otherwise(value * 1.0)


def negative_delta_score(delta, cap):
    return F.when(delta >= 0, lit_d(0)).when(delta < 0, clip01(F.abs(delta) / cap))


def positive_shift_score(value, cap):
    return F.when(value.isNotNull(), clip01(F.greatest(lit_d(0), value) / cap))


def absolute_shift_score(value, cap):
    return clip01(F.abs(value) / cap)


def cash_flow_quality_score(q):
    return clip01((1.0 - q) / 1.5)


def conversion_weakness_score(r):
    return F.when(r.isNotNull(), clip01(F.greatest(lit_d(0), 1.0 - r)))


def rescale(x, floor=P.DRIFT_FLOOR, cap=P.DRIFT_CAP):
    return (F.when(x <= floor, lit_d(0)).when(x >= cap, lit_d(1))
            .when(x.isNotNull(), clip01((x - floor) / (cap - floor))))


def fixed_range(x):
    return clip01((x - P.RAW_MIN) / (P.RAW_MAX - P.RAW_MIN))


def top_k_count(n):
    return F.when(n <= 0, F.lit(0)).otherwise(
        F.least(n, F.greatest(F.lit(P.TOPK_MIN), F.ceil(n * P.TOPK_RATIO)))).cast("int")


def concentration_step(n):
    return F.least(n, F.lit(4)) / 4.0


def safe_float(x):
    """Text or number to a finite double, else NULL."""
    v = F.expr("null") if x is None else x.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def token_estimate(text):
    return F.greatest(F.lit(1), F.bround(F.length(text) / 4.0, 0).cast("int"))


def sum_cols(cols):
    return reduce(lambda a, b: a + b, cols)


def defined(x):
    return x.isNotNull().cast("int")


def weighted_average(components, weights):
    """Weighted mean over the components that are defined, clipped; NULL if none is."""
    num = sum_cols([F.coalesce(components[k] * float(w), lit_d(0)) for k, w in weights.items()])
    den = sum_cols([F.when(components[k].isNotNull(), lit_d(w)).otherwise(lit_d(0))
                    for k, w in weights.items()])
    return clip01(F.try_divide(num, den))


def coverage_ratio(components, expected):
    if expected <= 0:
        return lit_d(0)
    return clip01(sum_cols([defined(c) for c in components]) / float(expected))


def defined_ratio(components):
    """Components that enter the ratio are the defined ones only: 1 if any, else 0."""
    n = sum_cols([defined(c) for c in components])
    return F.when(n > 0, lit_d(1)).otherwise(lit_d(0))


def mean_of_defined(cols):
    return F.try_divide(sum_cols([F.coalesce(c, lit_d(0)) for c in cols]),
                        sum_cols([defined(c) for c in cols]).cast("double"))


def greatest_defined(cols):
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def risk_label(x):
    return (F.when(x.isNull(), "UNKNOWN").when(x < 0.3, "LOW").when(x < 0.5, "MEDIUM")
            .when(x < 0.75, "HIGH").otherwise("CRITICAL"))


def coverage_label(cov):
    return (F.when(cov >= P.COVERAGE_HIGH, "high").when(cov >= P.COVERAGE_MEDIUM, "medium")
            .otherwise("low"))


def downgrade_label(label, missing_critical):
    return (F.when(~missing_critical, label).when(label == "high", "medium").otherwise("low"))


def numeric_confidence(history_depth, component_ratio):
    return clip01(0.6 * clip01(history_depth / 4.0) + 0.4 * component_ratio)


def market_confidence(price_count, component_ratio):
    return clip01(0.70 * clip01(price_count / 252.0) + 0.30 * component_ratio)


def sentiment_confidence(article_count, component_ratio):
    return clip01(0.65 * clip01(article_count / 15.0) + 0.35 * component_ratio)


def behavior_confidence(history_depth, active_insiders, component_ratio):
    return clip01(0.35 * clip01(history_depth / 4.0) + 0.35 * clip01(active_insiders / 3.0)
                  + 0.30 * component_ratio)


def text_confidence(scored, coverage):
    return clip01(0.7 * clip01(scored / float(P.TEXT_CONFIDENCE_TARGET)) + 0.3 * coverage)


def price_earnings(price, shares, income):
    ok = (price > 0) & (shares > 0) & (income > 0)
    return F.when(ok, price * shares / income)


def period_metrics(f, form_type):
    """Raw canonical facts (name -> Column) to ratio metrics (name -> Column)."""
    rev, gross, op, net, ocf = (annualise(f[k], form_type) for k in (
        "revenue", "gross_profit", "operating_income", "net_income", "operating_cash_flow"))
    return {
        "revenue": rev,
        "gross_margin": safe_divide(gross, rev),
        "operating_margin": safe_divide(op, rev),
        "net_margin": safe_divide(net, rev),
        "debt_to_equity": safe_divide(f["long_term_debt"], f["equity"]),
        "cash_ratio": safe_divide(f["cash"], f["assets"]),
        "cf_quality": F.when(net > 0, safe_divide(ocf, net)),
        "cash_conversion_ratio": safe_divide(ocf, F.abs(net)),
        "accruals_ratio": safe_divide(net - ocf, f["assets"]),
        "operating_cash_flow": ocf,
        "net_income": net,
        "assets": f["assets"] * 1.0,
        "shares_outstanding": f["shares_outstanding"] * 1.0,
    }
