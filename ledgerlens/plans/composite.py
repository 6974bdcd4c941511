"""Fusion: carry-forward, coverage gate, convergence boost, normalised score, snapshot row."""
from pyspark.sql import DataFrame, functions as F

from ledgerlens import policies as P
from ledgerlens.functions import jsonpath as J, scoring as S
from ledgerlens.operators import ordered as O
from ledgerlens.plans.rows import pivot_signals, signal_rows

VERSION = "composite_v4"
INPUTS = tuple(P.COMPOSITE_WEIGHTS)
SCORING = tuple(n for n, w in P.COMPOSITE_WEIGHTS.items() if w > 0)
TOTAL_WEIGHT = float(sum(P.COMPOSITE_WEIGHTS.values()))


def resolved_inputs(filings: DataFrame, signals: DataFrame, confidence=None, hot_rows=O.AUTO) -> DataFrame:
    """Per filing and input: own value, else the value of one of the two previous anchor filings,
    penalised; with source filing, source day and penalised confidence.

    signals hold one row per (filing, signal). `confidence` is read from the JSON detail unless
    given as a Column.
    """
    if hot_rows == O.AUTO:
        hot_rows = O.hot_limit(filings, ["company_id"])
    conf = J.number_at(J.variant(F.col("detail")), "$.confidence") if confidence is None else confidence
    wide = pivot_signals(signals, INPUTS, extra={"__c": conf})
    base = filings.where(F.col("form_type").isin(*P.ANCHOR_FORMS)).join(
        wide.drop("company_id"), "filing_id", "left")
    entry = F.struct("filing_id", "filed_at", *INPUTS, *[f"{n}__c" for n in INPUTS])
    d = O.lagged(base, ["company_id"], O.Order.by_day("filed_at", "filing_id"),
                 {f"__p{k}": (entry, k) for k in range(1, P.CARRY_FORWARD_FILINGS + 1)}, hot_rows)
    steps = range(1, P.CARRY_FORWARD_FILINGS + 1)

    def first_of(n, own, earlier):
        """The own entry if the input is there, else that of the nearest filing which has it."""
        return (f"CASE WHEN {n} IS NOT NULL THEN {own} "
                + " ".join(f"WHEN __p{k}.{n} IS NOT NULL THEN {earlier(k)}" for k in steps) + " END")
    faded = lambda c: lambda k: f"least(1D, greatest(0D, __p{k}.{c} * {P.CARRY_FORWARD_PENALTY}D))"
    faded_conf = lambda c: lambda k: f"CASE WHEN __p{k}.{c} IS NOT NULL THEN {faded(c)(k)} END"
    cols = {f"in_{n}": F.expr(
        f"struct({first_of(n, n, faded(n))} AS value, {first_of(n, n + '__c', faded_conf(n + '__c'))} AS confidence, "
        f"{first_of(n, 'filing_id', lambda k: f'__p{k}.filing_id')} AS source_filing_id, "
        f"{first_of(n, 'filed_at', lambda k: f'__p{k}.filed_at')} AS source_filed_at, "
        f"{first_of(n, '0', str)} AS filings_back)") for n in INPUTS}
    keep = [c for c in filings.columns]
    return d.select(*keep, *[c.alias(k) for k, c in cols.items()])


def _clip01(x):
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(1D, greatest(0D, {x})) END"


def _names(conditions):
    """{name: condition} -> array of the names that hold."""
    return "filter(array(" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in conditions.items()) + "), x -> x IS NOT NULL)"


def _count(conditions):
    return "(" + " + ".join(f"cast(coalesce({c}, false) AS int)" for c in conditions) + ")"


def _coalesce(names):
    return f"coalesce({', '.join(names)})"


def composite_features(resolved: DataFrame) -> DataFrame:
    """Layer scores, convergence, coverage gate, fused score and confidence, in steps: every step's
    columns are read by the next, so no expression is repeated in a later one."""
    d = resolved.withColumns({n: F.col(f"in_{n}.value") for n in INPUTS})
    layer = {k: names[0] if len(names) == 1 else f"greatest({', '.join(names)})" for k, names in P.CONVERGENCE_LAYERS.items()}
    weight = {n: f"{P.COMPOSITE_WEIGHTS[n]}D" for n in SCORING}
    there = {n: f"{n} IS NOT NULL" for n in SCORING}
    text, numeric = P.CRITICAL_LAYERS["text"], P.CRITICAL_LAYERS["numeric"]
    gap = lambda n: f"coalesce(datediff(filed_at, in_{n}.source_filed_at), 0)"
    source = lambda names: f"coalesce(greatest({', '.join(f'in_{n}.source_filing_id' for n in names)}), filing_id)"
    conf = [f"CASE WHEN {n} IS NOT NULL THEN in_{n}.confidence END" for n in SCORING]
    step1 = {
        "narrative_numeric_divergence": _clip01(
            f"abs(({_clip01('forward_pessimism')}) - ({_clip01('fundamental_deterioration')}))"),
        "layer_scores": "struct(" + ", ".join(f"{v} AS {k}" for k, v in layer.items()) + ")",
        "available_signal_count": _count(there.values()),
        "available_signal_names": _names(there),
        "missing_signal_names": _names({n: f"{n} IS NULL" for n in SCORING}),
        "missing_critical_layers": _names({k: f"{_coalesce(v)} IS NULL" for k, v in P.CRITICAL_LAYERS.items()}),
        "__weight": " + ".join(f"CASE WHEN {n} IS NOT NULL THEN {w} ELSE 0D END" for n, w in weight.items()),
        "__total": " + ".join(f"coalesce({n} * {w}, 0D)" for n, w in weight.items()),
        "__confs": f"filter(array({', '.join(conf)}), x -> x IS NOT NULL)",
        "text_source_filing": source(text), "xbrl_source_filing": source(numeric),
        "text_staleness_days": f"greatest({', '.join(gap(n) for n in text)})",
        "carried_forward": _names({n: f"in_{n}.filings_back > 0" for n in INPUTS}),
    }
    up = {k: f"layer_scores.{k} >= {t}D" for k, t in P.CONVERGENCE_THRESHOLDS.items()}
    step2 = {
        "elevated_layers": _names(up), "layers_elevated": _count(up.values()),
        "layer_ratio": _count(f"layer_scores.{k} IS NOT NULL" for k in layer) + f" / {len(layer)}D",
        "coverage_ratio": f"available_signal_count / {len(SCORING)}D",
    }
    tier = lambda i: " ".join(f"WHEN {n} THEN {t[i]!r}" for n, t in P.CONVERGENCE_TIERS.items())
    step3 = {
        "convergence_tier": f"CASE layers_elevated {tier(0)} ELSE 'none' END",
        "convergence_boost": f"cast(CASE layers_elevated {tier(1)} ELSE 0 END AS double)",
        "__gate": f"__weight > 0 AND coverage_ratio >= {P.MIN_COVERAGE}D",
    }
    # every scoring input present: the plain weighted sum, no division by a rounded total
    step4 = {"raw_score": f"CASE WHEN NOT __gate THEN NULL WHEN available_signal_count = {len(SCORING)} THEN __total "
                          f"ELSE __total / __weight * {TOTAL_WEIGHT}D END",
             "confidence": "CASE WHEN __gate AND size(__confs) > 0 THEN aggregate(__confs, 0D, (a, x) -> a + x) / size(__confs) END",
             "availability_reason": "CASE WHEN __weight = 0 THEN 'missing_all_component_inputs' "
                                    "WHEN NOT __gate THEN 'insufficient_signal_coverage' END"}
    for step in (step1, step2, step3, step4):
        d = d.withColumns({k: F.expr(v) for k, v in step.items()})
    d = d.withColumn("raw_total", F.col("raw_score") + F.col("convergence_boost"))
    label = S.downgrade_label(S.coverage_label(F.col("coverage_ratio")), F.size("missing_critical_layers") > 0)
    return d.withColumns({"nci_global": S.fixed_range(F.col("raw_total")),
                          "confidence_label": F.when(F.col("__gate"), label).otherwise("low")}).drop(
        "__weight", "__total", "__confs", "__gate")


def composite_wide(filings, signals, confidence=None, forms=None, hot_rows=O.AUTO) -> DataFrame:
    """All fused columns, one row per filing. `forms` limits which filings are scored; the history
    they draw on always covers all anchor forms."""
    d = resolved_inputs(filings, signals, confidence, hot_rows)
    if forms:
        d = d.where(F.col("form_type").isin(*forms))
    return composite_features(d)


def composite_signals(wide: DataFrame, computed_at) -> DataFrame:
    """Four rows per filing: divergence, convergence, the score, and its second name."""
    one = F.lit(1.0)
    cat = {"signal_category": F.lit("composite")}
    inputs = F.struct(*[F.col(n) for n in INPUTS])
    names = ["available_signal_count", "available_signal_names", "missing_signal_names", "missing_critical_layers",
             "raw_score", "convergence_boost", "convergence_tier", "layers_elevated", "confidence_label",
             "text_source_filing", "xbrl_source_filing", "text_staleness_days", "carried_forward"]
    score = {k: F.col(k) for k in names}
    score.update(inputs=inputs, raw_total_before_normalization=F.col("raw_total"), confidence=F.col("confidence"),
                 normalization_method=F.lit("fixed_range"), signal_role=F.lit("final"), **cat)
    # the coverage of a gated score is kept: it is why the score is missing
    reason = F.col("availability_reason")
    d = wide.withColumn("__cov", F.when(reason == "missing_all_component_inputs", F.lit(0.0)).otherwise(
        F.col("coverage_ratio")))
    rows = signal_rows(d, {
        "narrative_numeric_divergence": (F.col("narrative_numeric_divergence"), {
            "forward_pessimism": F.col("forward_pessimism"), "numeric_risk": F.col("fundamental_deterioration"),
            "coverage_ratio": one, "confidence": one, "signal_role": F.lit("diagnostic"), **cat},
            "missing_required_inputs"),
        "convergence_signal": (F.col("convergence_boost"), {
            "layer_scores": F.col("layer_scores"), "elevated_layers": F.col("elevated_layers"),
            "layers_elevated": F.col("layers_elevated"), "tier": F.col("convergence_tier"),
            "boost": F.col("convergence_boost"), "coverage_ratio": F.col("layer_ratio"),
            "confidence": F.col("layer_ratio"), "signal_role": F.lit("derived"), **cat}, F.lit(None).cast("string")),
        "nci_global": (F.col("nci_global"), {**score, "coverage_ratio": F.col("__cov")}, reason),
        "composite_filing_risk": (F.col("nci_global"), {
            "alias_of": F.lit("nci_global"), "signal_role": F.lit("final_alias"), **cat}, F.lit(None).cast("string")),
    }, VERSION, computed_at, keep_coverage=("nci_global",))
    return rows


def snapshot_rows(wide: DataFrame, computed_at) -> DataFrame:
    """Wide snapshot row per scored filing."""
    fresh = F.col("confidence_label") != "low"
    stale = F.when(~fresh, "low_signal_coverage").when(F.size("carried_forward") > 0, "carried_forward_inputs")
    return wide.where(F.col("nci_global").isNotNull()).select(
        "company_id", "filing_id",
        F.when(F.col("form_type").isin(*P.ANNUAL_FORMS), "annual_anchor").otherwise("quarterly_update").alias("event_type"),
        "fiscal_year", "fiscal_quarter", "nci_global", "convergence_tier", "layers_elevated",
        F.col("confidence_label").alias("confidence"), "coverage_ratio",
        *[F.col(n).alias(c) for n, c in P.SNAPSHOT_COLUMNS.items()],
        "text_source_filing", "xbrl_source_filing", "text_staleness_days", fresh.alias("data_fresh"),
        stale.alias("staleness_reason"), computed_at.alias("computed_at"))
