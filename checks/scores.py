"""Driver queries: carry-forward, fusion, layer signals, score arithmetic."""
from pyspark.sql import functions as F

from checks.timeline import _c01, _pos, _wavg
from checks.views import (SIGNALS, company, event_filing, filing, metric, news, price, r8, signal, signal_table, sql, t,
                          trade, trade_filing)
from ledgerlens import policies as P
from ledgerlens.functions import jsonpath as J, scoring as S, strings as T
from ledgerlens.operators import aggregates as A
from ledgerlens.plans import (behavior_signals as B, composite as C, market_signals as M, queries as QR, rows as R,
                              sentiment_signals as E)

Q_, S_ = {}, {}
NOW = F.timestamp_seconds


def reg(name, oracle=None):
    def deco(fn):
        Q_[name] = fn
        if oracle:
            S_[name] = oracle
        return fn
    return deco


def at():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def wide_signals(spark, d):
    return R.pivot_signals(signal(spark, d), SIGNALS)


_WIDE = "SELECT filing_id, company_id, " + ", ".join(
    f"max(signal_value) FILTER (signal_name='{n}') AS {n}, max(confidence) FILTER (signal_name='{n}') AS {n}__c"
    for n in SIGNALS) + " FROM v_signal GROUP BY 1,2"


# ---------------------------------------------------------------- AGG-03..05 AGG-15 MTH-01
@reg("weighted_avg", sql(f"""SELECT filing_id, round({_wavg([(n, w) for n, w in P.COMPOSITE_WEIGHTS.items()])},8)+0e0 AS weighted,
 round(({'+'.join(f'({n} IS NOT NULL)::INT' for n in SIGNALS)})/11.0,8)+0e0 AS coverage,
 round(({'+'.join(f'coalesce({n},0)' for n in SIGNALS)})/nullif({'+'.join(f'({n} IS NOT NULL)::INT' for n in SIGNALS)},0),8)+0e0 AS mean_defined,
 array_to_string(list_filter([{','.join(f"CASE WHEN {n} IS NULL THEN '{n}' END" for n in SIGNALS)}], lambda x: x IS NOT NULL),',') AS missing,
 array_to_string(list_filter([CASE WHEN coalesce(rlds,mda_drift,forward_pessimism) IS NULL THEN 'text' END,
  CASE WHEN coalesce(fundamental_deterioration,balance_sheet_stress,revenue_growth_deceleration,earnings_quality,numeric_anomaly) IS NULL THEN 'numeric' END,
  CASE WHEN insider_signal IS NULL THEN 'behavior' END], lambda x: x IS NOT NULL),',') AS missing_layers FROM w""", "v_signal", w=_WIDE))
def weighted_avg(spark, d):
    w = wide_signals(spark, d)
    c = {n: F.col(n) for n in SIGNALS}
    return w.select("filing_id", r8(S.weighted_average(c, P.COMPOSITE_WEIGHTS)).alias("weighted"),
                    r8(S.coverage_ratio(c.values(), 11)).alias("coverage"),
                    r8(S.mean_of_defined(list(c.values()))).alias("mean_defined"),
                    F.array_join(A.missing_names(c), ",").alias("missing"),
                    F.array_join(A.missing_layers(c), ",").alias("missing_layers"))


@reg("pivot_signals", sql("SELECT filing_id, company_id, " + ", ".join(f"round({n},8)+0e0 AS {n}" for n in SIGNALS) + " FROM w", "v_signal", w=_WIDE))
def pivot_signals(spark, d):
    return wide_signals(spark, d).select("filing_id", "company_id", *[r8(F.col(n)).alias(n) for n in SIGNALS])


_VAL = [s[0] for s in P.VALIDATION_SIGNALS]
_BACK = {v: k for k, v in P.SNAPSHOT_COLUMNS.items()}


@reg("unpivot_signals", sql("SELECT filing_id, n AS column_name, round(v,8)+0e0 AS signal_value FROM w, LATERAL (VALUES "
                            + ",".join(f"('{c}', {_BACK[c]})" for c in _VAL) + ") x(n,v)", "v_signal", w=_WIDE))
def unpivot_signals(spark, d):
    w = wide_signals(spark, d).select("filing_id", *[F.col(_BACK[c]).alias(c) for c in _VAL])
    return w.unpivot(["filing_id"], _VAL, "column_name", "signal_value").withColumn("signal_value", r8(F.col("signal_value")))


# ---------------------------------------------------------------- JON-09 AGG-17
_LAGS = "SELECT w.*, f.filed_at, f.form_type, f.fiscal_year, " + ", ".join(
    f"lag({n}) OVER o AS {n}_1, lag({n},2) OVER o AS {n}_2, lag({n}__c) OVER o AS {n}__c1, lag({n}__c,2) OVER o AS {n}__c2" for n in SIGNALS) + \
    ", lag(filing_id) OVER o AS f1, lag(filing_id,2) OVER o AS f2, lag(filed_at) OVER o AS d1, lag(filed_at,2) OVER o AS d2" \
    " FROM w JOIN v_filing f USING (filing_id, company_id) WINDOW o AS (PARTITION BY company_id ORDER BY filed_at, filing_id)"
_RES = "SELECT filing_id, company_id, filed_at, form_type, " + ", ".join(
    f"CASE WHEN {n} IS NOT NULL THEN {n} WHEN coalesce({n}_1,{n}_2) IS NOT NULL THEN least(1.0, coalesce({n}_1,{n}_2)*0.95) END AS {n},"
    f" CASE WHEN {n} IS NOT NULL THEN {n}__c WHEN {n}_1 IS NOT NULL THEN {n}__c1*0.95 WHEN {n}_2 IS NOT NULL THEN {n}__c2*0.95 END AS {n}__c,"
    f" CASE WHEN {n} IS NOT NULL THEN 0 WHEN {n}_1 IS NOT NULL THEN 1 WHEN {n}_2 IS NOT NULL THEN 2 END AS {n}__b,"
    f" CASE WHEN {n} IS NOT NULL THEN filing_id WHEN {n}_1 IS NOT NULL THEN f1 WHEN {n}_2 IS NOT NULL THEN f2 END AS {n}__s,"
    f" CASE WHEN {n} IS NOT NULL THEN 0 WHEN {n}_1 IS NOT NULL THEN filed_at-d1 WHEN {n}_2 IS NOT NULL THEN filed_at-d2 ELSE 0 END AS {n}__d"
    for n in SIGNALS) + " FROM lagd"
_CARRY = dict(w=_WIDE, lagd=_LAGS, res=_RES)


@reg("carry_forward", sql("SELECT filing_id, signal_name, round(v,8)+0e0 AS value, round(c,8)+0e0 AS confidence, b::INT AS filings_back, s AS source_filing_id FROM res, LATERAL (VALUES "
                          + ",".join(f"('{n}',{n},{n}__c,{n}__b,{n}__s)" for n in SIGNALS) + ") x(signal_name,v,c,b,s)",
                          "v_signal", "v_filing", **_CARRY))
def carry_forward(spark, d):
    r = C.resolved_inputs(filing(spark, d), signal(spark, d), F.col("confidence"))
    rows = F.array(*[F.struct(F.lit(n).alias("signal_name"), F.col(f"in_{n}").alias("r")) for n in SIGNALS])
    return (r.select("filing_id", F.explode(rows).alias("x")).select(
        "filing_id", "x.signal_name", r8(F.col("x.r.value")).alias("value"), r8(F.col("x.r.confidence")).alias("confidence"),
        F.col("x.r.filings_back").alias("filings_back"), F.col("x.r.source_filing_id").alias("source_filing_id")))


# ---------------------------------------------------------------- SIG-23..27 JOB-07 JOB-08 (flagship)
_SC = [n for n, w in P.COMPOSITE_WEIGHTS.items() if w > 0]
_UP = ("(coalesce(greatest(rlds,forward_pessimism)>=.25,false)::INT + coalesce(greatest(fundamental_deterioration,balance_sheet_stress)>=.2,false)::INT"
       " + coalesce(insider_signal>=.15,false)::INT + coalesce(market_signal>=.2,false)::INT + coalesce(sentiment_signal>=.2,false)::INT)")
_AVAIL = "(" + "+".join(f"({n} IS NOT NULL)::INT" for n in _SC) + ")"
_NUM = "(" + "+".join(f"coalesce({n}*{P.COMPOSITE_WEIGHTS[n]},0)" for n in _SC) + ")"
_DEN = "(" + "+".join(f"CASE WHEN {n} IS NOT NULL THEN {P.COMPOSITE_WEIGHTS[n]} ELSE 0 END" for n in _SC) + ")::DOUBLE"
_COMPOSITE = dict(_CARRY, fuse=f"""SELECT *, {_UP} AS up, {_AVAIL}/10.0 AS cov,
  CASE WHEN {_AVAIL}>=6 THEN {_NUM}/{_DEN} END AS raw,
  (coalesce(rlds,mda_drift,forward_pessimism) IS NULL)::INT + (coalesce(fundamental_deterioration,balance_sheet_stress,
   revenue_growth_deceleration,earnings_quality,numeric_anomaly) IS NULL)::INT + (insider_signal IS NULL)::INT AS miss,
  ({'+'.join(f'CASE WHEN {n} IS NOT NULL THEN coalesce({n}__c,0) ELSE 0 END' for n in _SC)})/nullif({'+'.join(f'({n} IS NOT NULL AND {n}__c IS NOT NULL)::INT' for n in _SC)},0) AS conf,
  coalesce(greatest(rlds__s,mda_drift__s,forward_pessimism__s), filing_id) AS tsrc,
  greatest(rlds__d,mda_drift__d,forward_pessimism__d) AS tdays,
  {'+'.join(f'coalesce({n}__b>0,false)::INT' for n in SIGNALS)} AS ncarried FROM res""",
  fin="""SELECT *, CASE up WHEN 5 THEN .2 WHEN 4 THEN .15 WHEN 3 THEN .1 ELSE 0 END::DOUBLE AS boost,
   CASE up WHEN 5 THEN 'full' WHEN 4 THEN 'strong' WHEN 3 THEN 'moderate' ELSE 'none' END AS tier,
   CASE WHEN cov>=.8 THEN 3 WHEN cov>=.6 THEN 2 ELSE 1 END AS lvl FROM fuse""",
  out_="""SELECT *, CASE WHEN raw IS NOT NULL THEN greatest(0.0,least(1.0,(raw+boost-.04)/.31)) END AS nci,
   CASE WHEN raw IS NULL THEN 'low' ELSE CASE lvl - (miss>0)::INT WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END END AS label FROM fin""")


@reg("composite", sql("""SELECT filing_id, company_id, round(nci,8)+0e0 AS nci_global, round(raw+boost,8)+0e0 AS raw_total, tier AS convergence_tier,
 up::INT AS layers_elevated, round(cov,8)+0e0 AS coverage_ratio, label AS confidence_label, CASE WHEN raw IS NOT NULL THEN round(conf,8)+0e0 END AS confidence,
 CASE WHEN forward_pessimism IS NOT NULL AND fundamental_deterioration IS NOT NULL THEN round(abs(forward_pessimism-fundamental_deterioration),8)+0e0 END AS narrative_numeric_divergence,
 tsrc AS text_source_filing, tdays::INT AS text_staleness_days FROM out_""", "v_signal", "v_filing", **_COMPOSITE))
def composite(spark, d):
    w = C.composite_wide(filing(spark, d), signal(spark, d), F.col("confidence"))
    return w.select("filing_id", "company_id", r8(F.col("nci_global")).alias("nci_global"),
                    r8(F.col("raw_total")).alias("raw_total"), "convergence_tier", "layers_elevated",
                    r8(F.col("coverage_ratio")).alias("coverage_ratio"), "confidence_label",
                    r8(F.col("confidence")).alias("confidence"),
                    r8(F.col("narrative_numeric_divergence")).alias("narrative_numeric_divergence"),
                    "text_source_filing", "text_staleness_days")


@reg("composite_rows", sql("""SELECT filing_id, signal_name, round(v,8)+0e0 AS signal_value FROM out_, LATERAL (VALUES
 ('nci_global', nci), ('composite_filing_risk', nci), ('convergence_signal', boost),
 ('narrative_numeric_divergence', CASE WHEN forward_pessimism IS NOT NULL AND fundamental_deterioration IS NOT NULL THEN abs(forward_pessimism-fundamental_deterioration) END)) x(signal_name, v)""",
                           "v_signal", "v_filing", **_COMPOSITE))
def composite_rows(spark, d):
    w = C.composite_wide(filing(spark, d), signal_table(spark, d))
    return C.composite_signals(w, at()).select("filing_id", "signal_name", r8(F.col("signal_value")).alias("signal_value"))


@reg("score_snapshots", sql("""SELECT filing_id, company_id, CASE WHEN form_type='10-K' THEN 'annual_anchor' ELSE 'quarterly_update' END AS event_type,
 round(nci,8)+0e0 AS nci_global, round(rlds,8)+0e0 AS signal_text, round(sentiment_signal,8)+0e0 AS signal_sentiment, label <> 'low' AS data_fresh,
 CASE WHEN label='low' THEN 'low_signal_coverage' WHEN ncarried>0 THEN 'carried_forward_inputs' END AS staleness_reason FROM out_ WHERE nci IS NOT NULL""",
                            "v_signal", "v_filing", **_COMPOSITE))
def score_snapshots(spark, d):
    w = C.composite_wide(filing(spark, d), signal(spark, d), F.col("confidence"))
    s = C.snapshot_rows(w, at())
    return s.select("filing_id", "company_id", "event_type", *[r8(F.col(c)).alias(c) for c in (
        "nci_global", "signal_text", "signal_sentiment")], "data_fresh", "staleness_reason")


# ---------------------------------------------------------------- AGG-09 AGG-10 DAT-11 JOB-11
_YEARLY = dict(
    rec="""SELECT c.ticker, year(f.filed_at) AS year, s.signal_name AS signal_key, f.filed_at, f.filing_id, s.signal_value/4.0 + (c.company_id%4)*0.2 AS v
      FROM v_signal s JOIN v_filing f USING (filing_id) JOIN v_company c ON c.company_id=s.company_id""",
    yr="""SELECT ticker, year, signal_key, count(*) AS point_count, count(v) AS non_null_points, avg(v) AS mean_value,
      arg_max(v,(filed_at,filing_id)) FILTER (v IS NOT NULL) AS last_value, min(v) AS min_value, max(v) AS max_value FROM rec GROUP BY 1,2,3""")


def _records(spark, d):
    # filings meet company and year as one row each and lie where the yearly groups are made before they become eleven
    s = signal(spark, d, lambda o: o.join(filing(spark, d).select("filing_id", "filed_at"), "filing_id").join(
        company(spark, d).select("company_id", "ticker"), "company_id")
        .withColumn("year", F.year("filed_at")).repartition("ticker", "year"))
    return s.select("ticker", "year", F.col("signal_name").alias("signal_key"),
                    F.col("signal_name").alias("signal_label"), "filed_at", F.col("filing_id").alias("seq"),
                    (F.col("signal_value") / 4.0 + (F.col("company_id") % 4) * 0.2).alias("signal_value"))


@reg("yearly_signals", sql("""SELECT ticker, year::INT AS year, signal_key, point_count, non_null_points, round(mean_value,8)+0e0 AS mean_value,
 round(last_value,8)+0e0 AS last_value, round(min_value,8)+0e0 AS min_value, round(max_value,8)+0e0 AS max_value FROM yr""", "v_signal", "v_filing", "v_company", **_YEARLY))
def yearly_signals(spark, d):
    y = A.yearly_signals(_records(spark, d))
    return y.select("ticker", "year", "signal_key", "point_count", "non_null_points", *[r8(F.col(c)).alias(c) for c in (
        "mean_value", "last_value", "min_value", "max_value")])


@reg("yearly_flags", sql("""SELECT ticker, signal_key, count(mean_value) AS yearly_points, round(avg(mean_value),8)+0e0 AS mean_value,
 CASE WHEN count(mean_value)=0 THEN 'missing' WHEN count(mean_value)=1 THEN 'sparse' WHEN max(abs(mean_value))<1e-9 THEN 'always_zero'
 WHEN count(mean_value)>=3 AND max(mean_value)-min(mean_value)<=.05 THEN 'flat' WHEN count(mean_value)>=3 AND min(mean_value)>=.75 THEN 'always_high'
 ELSE 'variable' END AS verdict FROM yr GROUP BY 1,2""", "v_signal", "v_filing", "v_company", **_YEARLY))
def yearly_flags(spark, d):
    f = A.signal_flags(A.yearly_signals(_records(spark, d)))
    return f.select("ticker", "signal_key", "yearly_points", r8(F.col("mean_value")).alias("mean_value"), "verdict")


# ---------------------------------------------------------------- AGG-19 SET-02 UDF-04, PRJ-11 PRJ-12
@reg("run_summary", sql("""SELECT layer, count(*) AS signal_count, count(signal_value) AS available_count,
 array_to_string(list_sort(list(DISTINCT signal_name)),',') AS signal_names,
 array_to_string(list_sort(list(DISTINCT signal_name) FILTER (signal_value IS NULL)),',') AS not_available FROM
 (SELECT *, CASE WHEN k<=3 THEN 'text' WHEN k<=8 THEN 'numbers' WHEN k=9 THEN 'behavior' WHEN k=10 THEN 'market' ELSE 'sentiment' END AS layer FROM v_signal) GROUP BY 1""", "v_signal"))
def run_summary(spark, d):
    return A.run_summary(R.with_catalogue(signal(spark, d)))


_DESC = {n: (layer, text) for n, layer, text in P.SIGNAL_CATALOGUE}


@reg("catalogue", sql("SELECT filing_id, signal_name, layer, description, CASE WHEN signal_value IS NULL THEN 'insufficient' END AS availability_reason,"
                      " CASE WHEN signal_value IS NULL THEN 0.0 ELSE confidence END::DOUBLE AS confidence FROM v_signal JOIN (VALUES "
                      + ",".join(f"('{n}','{_DESC[n][0]}','{_DESC[n][1].replace(chr(39), chr(39) * 2)}')" for n in SIGNALS)
                      + ") c(signal_name, layer, description) USING (signal_name)", "v_signal"))
def catalogue(spark, d):
    miss = F.col("signal_value").isNull()
    return R.with_catalogue(signal(spark, d)).select(
        "filing_id", "signal_name", "layer", "description", F.when(miss, "insufficient").alias("availability_reason"),
        F.when(miss, F.lit(0.0)).otherwise(F.col("confidence")).alias("confidence"))


# ---------------------------------------------------------------- MTH-06..20
@reg("score_math", sql(f"""SELECT filing_id, round({_c01('(1.0-x*3)/1.5')},8)+0e0 AS cf_quality_score, round({_c01('greatest(0.0,1.0-x)')},8)*CASE WHEN x IS NULL THEN NULL ELSE 1 END+0e0 AS conversion_weakness,
 round({_pos('x-y', .1)},8)+0e0 AS positive_shift, round(CASE WHEN x-y>=0 THEN 0.0 WHEN x-y<0 THEN least(1.0,abs(x-y)/.2) END,8)+0e0 AS negative_delta,
 round(CASE WHEN x-y IS NOT NULL THEN least(1.0,abs(x-y)/.1) END,8)+0e0 AS absolute_shift, round({_c01('(x/3.0-.04)/.31')},8)+0e0 AS fixed_range,
 CASE WHEN x IS NULL THEN 'UNKNOWN' WHEN x<.3 THEN 'LOW' WHEN x<.5 THEN 'MEDIUM' WHEN x<.75 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_label,
 CASE WHEN y IS NOT NULL THEN CASE WHEN x>=.8 THEN 'high' WHEN x>=.6 THEN 'medium' ELSE 'low' END ELSE CASE WHEN x>=.8 THEN 'medium' ELSE 'low' END END AS label,
 round(least(1.0,.6*least(1.0,k/4.0)+.4*coalesce(x,0)),8)+0e0 AS numeric_confidence, round(least(1.0,.7*least(1.0,k*40/252.0)+.3*coalesce(x,0)),8)+0e0 AS market_confidence,
 round(least(1.0,.65*least(1.0,k/15.0)+.35*coalesce(x,0)),8)+0e0 AS sentiment_confidence, round(least(1.0,.35*least(1.0,k/4.0)+.35*least(1.0,(k//2)/3.0)+.3*coalesce(x,0)),8)+0e0 AS behavior_confidence,
 round(least(1.0,.7*least(1.0,k/8.0)+.3*coalesce(x,0)),8)+0e0 AS text_confidence, least(k,4)/4.0::DOUBLE AS concentration,
 TRY_CAST(CASE filing_id%4 WHEN 0 THEN 'n/a' WHEN 1 THEN '' ELSE amount::VARCHAR END AS DOUBLE) AS safe_float
 FROM (SELECT f.filing_id, f.amount, (f.filing_id%9) AS k, w.rlds AS x, w.mda_drift AS y FROM w JOIN v_filing f USING (filing_id))""", "v_signal", "v_filing", w=_WIDE))
def score_math(spark, d):
    w = wide_signals(spark, d).join(filing(spark, d).select("filing_id", "amount"), "filing_id")
    x, y, k, c0 = F.col("rlds"), F.col("mda_drift"), F.col("filing_id") % 9, F.coalesce(F.col("rlds"), F.lit(0.0))
    text = F.when(F.col("filing_id") % 4 == 0, "n/a").when(F.col("filing_id") % 4 == 1, "").otherwise(F.col("amount").cast("string"))
    cols = {"cf_quality_score": S.cash_flow_quality_score(x * 3), "conversion_weakness": S.conversion_weakness_score(x),
            "positive_shift": S.positive_shift_score(x - y, .1), "negative_delta": S.negative_delta_score(x - y, .2),
            "absolute_shift": S.absolute_shift_score(x - y, .1), "fixed_range": S.fixed_range(x / 3.0),
            "numeric_confidence": S.numeric_confidence(k, c0), "market_confidence": S.market_confidence(k * 40, c0),
            "sentiment_confidence": S.sentiment_confidence(k, c0),
            "behavior_confidence": S.behavior_confidence(k, F.floor(k / 2), c0), "text_confidence": S.text_confidence(k, c0)}
    return w.select("filing_id", *[r8(c).alias(n) for n, c in cols.items()], S.risk_label(x).alias("risk_label"),
                    S.downgrade_label(S.coverage_label(x), y.isNull()).alias("label"),
                    S.concentration_step(k).alias("concentration"), S.safe_float(text).alias("safe_float"))


# ---------------------------------------------------------------- AGG-12 AGG-13 STR-24 MTH-17, SIG-11..15
_BEH = dict(
    econ="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id, accession_number, insider_name, transaction_date, transaction_code, shares,
      price_per_share, ownership_nature, acquired_disposed_code, is_derivative ORDER BY transaction_id) AS rn FROM v_trade) WHERE rn=1""",
    e="""SELECT *, coalesce(insider_cik,'')||'|'||lower(trim(insider_name)) AS ikey, coalesce(transaction_value, coalesce(price_per_share,0)*shares) AS val,
      CASE WHEN officer_title='Chief Executive Officer' THEN 'CEO' WHEN officer_title='EVP and CFO' THEN 'CFO' WHEN officer_title='President' THEN 'President'
        WHEN is_director THEN 'Director' ELSE 'Other Officer' END AS role FROM econ""",
    e2="SELECT *, CASE role WHEN 'CEO' THEN 1.0 WHEN 'CFO' THEN .9 WHEN 'President' THEN .85 WHEN 'Director' THEN .6 ELSE .5 END::DOUBLE AS wt FROM e",
    anc="SELECT DISTINCT company_id, filed_at AS day FROM v_trade_filing",
    win="""SELECT a.day, e2.*, (e2.shares>=1000 AND role IN ('CEO','CFO','President','Director')) AS big,
      (SELECT median(h.shares) FROM e2 h WHERE h.company_id=a.company_id AND h.ikey=e2.ikey AND h.transaction_code IN ('S','P') AND h.transaction_date < a.day-90) AS med,
      EXISTS (SELECT 1 FROM e2 c WHERE c.company_id=a.company_id AND c.ikey=e2.ikey AND c.transaction_code IN ('A','F','M','G')
        AND c.transaction_date>=a.day-90 AND e2.transaction_date-c.transaction_date BETWEEN 0 AND 7) AS linked
      FROM anc a JOIN e2 ON e2.company_id=a.company_id AND e2.transaction_date BETWEEN a.day-90 AND a.day+90""",
    cls="""SELECT *, CASE WHEN big AND shares>med AND transaction_code='S' AND NOT linked THEN 's' WHEN big AND shares>med AND transaction_code='P' THEN 'b' ELSE 'r' END AS k FROM win""",
    act="""SELECT company_id, day, ikey, arg_min(wt,(transaction_date,transaction_id)) AS wt, coalesce(sum(val) FILTER (k='s'),0) AS sv, coalesce(sum(val) FILTER (k='b'),0) AS bv,
      count(*) FILTER (k='s') AS sn, count(*) FILTER (k='b') AS bn, count(*) AS n FROM cls GROUP BY 1,2,3""",
    agg="""SELECT company_id, day, coalesce(sum(CASE WHEN sv+bv=0 THEN 0 ELSE sv/(sv+bv) END*wt)/nullif(sum(wt),0),0) AS wita, count(*) FILTER (sn>0) AS sellers,
      count(*) AS active, sum(n) AS n, sum(sn) AS sn, sum(bn) AS bn FROM act GROUP BY 1,2""",
    gov="""SELECT a.company_id, a.day, accession_number, min(transaction_date) AS tx, arg_min(filed_at,(transaction_date,transaction_id)) FILTER (filed_at IS NOT NULL) AS filed
      FROM anc a JOIN e2 ON e2.company_id=a.company_id AND transaction_date BETWEEN a.day-365 AND a.day GROUP BY 1,2,3""",
    late="""SELECT company_id, day, avg(CASE WHEN filed IS NULL THEN 1.0 WHEN filed>tx AND
      (SELECT count(*) FROM range(1, greatest(filed-tx,0)+1) r(i) WHERE isodow(tx+r.i::INT)<=5) > 2 THEN 1.0 ELSE 0.0 END) AS lr FROM gov GROUP BY 1,2""",
    firsts="SELECT company_id, min(transaction_date) AS first FROM v_trade GROUP BY 1")


@reg("insider_activity", sql("""SELECT company_id, day AS filed_at, ikey AS insider_key, sn AS opportunistic_sell_count, bn AS opportunistic_buy_count,
 n AS transaction_count, round(sv,2)+0e0 AS opportunistic_sell_value, wt AS role_weight FROM act""", "v_trade", "v_trade_filing", **_BEH))
def insider_activity(spark, d):
    anchors = trade_filing(spark, d).select("company_id", "filed_at").distinct()
    tr = B.prepared_trades(trade(spark, d)).withColumnRenamed("filed_at", "trade_filed_at")
    a = B.insider_activity(B.classified_trades(anchors, tr))
    return a.select("company_id", "filed_at", "insider_key", "opportunistic_sell_count", "opportunistic_buy_count",
                    "transaction_count", (F.round("opportunistic_sell_value", 2) + 0.0).alias("opportunistic_sell_value"), "role_weight")


@reg("behaviour_signals", sql("""SELECT filing_id, signal_name, round(CASE WHEN first <= filed_at+90 THEN v END,8)+0e0 AS signal_value FROM (
 SELECT f.filing_id, f.filed_at, firsts.first, coalesce(sellers,0) AS sellers, coalesce(lr,0) AS lr,
  CASE WHEN coalesce(ts,0)>.6 AND coalesce(wita,0)>.6 THEN least(1.0,wita*1.25) ELSE coalesce(wita,0) END AS ita
 FROM v_trade_filing f LEFT JOIN agg ON agg.company_id=f.company_id AND agg.day=f.filed_at LEFT JOIN late ON late.company_id=f.company_id AND late.day=f.filed_at
 LEFT JOIN firsts ON firsts.company_id=f.company_id LEFT JOIN (SELECT filing_id, signal_value AS ts FROM v_signal WHERE signal_name='rlds') t ON t.filing_id=f.filing_id) q,
 LATERAL (VALUES ('ita', ita), ('insider_concentration', least(sellers,4)/4.0), ('insider_signal', least(1.0,.7*ita+.3*least(sellers,4)/4.0+least(.3,lr*.5)))) x(signal_name, v)""",
                              "v_trade", "v_trade_filing", "v_signal", **_BEH))
def behaviour_signals(spark, d):
    f = B.behavior_features(trade_filing(spark, d), trade(spark, d))
    tone = signal(spark, d).where("signal_name = 'rlds'").withColumn("signal_name", F.lit("text_sentiment")).withColumn(
        "computed_at", at())
    return B.behavior_signals(f, tone, at()).select("filing_id", "signal_name", r8(F.col("signal_value")).alias("signal_value"))


# ---------------------------------------------------------------- STR-19 SIG-12
@reg("role_class", sql("""SELECT company_id, insider_name, role_name, role_weight FROM (SELECT c_custkey//10 AS company_id, 'Insider '||c_custkey AS insider_name,
 CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'CEO' WHEN 'BUILDING' THEN 'CFO' WHEN 'FURNITURE' THEN 'President' WHEN 'MACHINERY' THEN 'Director' ELSE 'Other Officer' END AS role_name,
 CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1.0 WHEN 'BUILDING' THEN .9 WHEN 'FURNITURE' THEN .85 WHEN 'MACHINERY' THEN .6 ELSE .5 END::DOUBLE AS role_weight
 FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))"""))
def role_class(spark, d):
    x = trade(spark, d).select("company_id", "insider_name", "officer_title", "is_director").distinct()
    role = T.role_name(F.col("officer_title"), F.col("is_director"))
    return x.select("company_id", "insider_name", role.alias("role_name"), T.role_weight(role).alias("role_weight"))


# ---------------------------------------------------------------- SIG-16..19
_MKT = dict(
    px="SELECT company_id, trading_date, arg_max(price, price_id) AS price FROM v_price GROUP BY 1,2",
    an="SELECT DISTINCT company_id, filed_at FROM v_event_filing",
    lp="SELECT an.*, px.trading_date AS td, px.price FROM an ASOF LEFT JOIN px ON an.company_id=px.company_id AND an.filed_at>=px.trading_date",
    m1="SELECT lp.company_id, lp.filed_at, b.price AS q FROM lp ASOF LEFT JOIN px b ON lp.company_id=b.company_id AND lp.td-30>=b.trading_date",
    rets="""SELECT * FROM (SELECT *, (price-p)/nullif(p,0) AS ret FROM (SELECT *, lag(price) OVER (PARTITION BY company_id ORDER BY trading_date, price_id) AS p FROM v_price)) WHERE p>0""",
    vol="""SELECT *, CASE WHEN count(ret) OVER w30>=30 THEN stddev_pop(ret) OVER w30 END AS v30, stddev_pop(ret) OVER w180 AS v180 FROM rets
      WINDOW w30 AS (PARTITION BY company_id ORDER BY trading_date, price_id ROWS 29 PRECEDING), w180 AS (PARTITION BY company_id ORDER BY trading_date, price_id ROWS 179 PRECEDING)""",
    vday="SELECT company_id, trading_date, arg_max(CASE WHEN v30 IS NULL OR v180=0 THEN 99 ELSE v30/v180 END, price_id) AS ratio FROM vol GROUP BY 1,2",
    va="SELECT an.company_id, an.filed_at, CASE WHEN ratio<>99 THEN greatest(0.0,least(1.0,(ratio-1)/1.5)) END AS vs FROM an ASOF LEFT JOIN vday ON an.company_id=vday.company_id AND an.filed_at>=vday.trading_date",
    fday="""SELECT company_id, filed_at, arg_max(filing_id, filing_id) AS fid FROM v_event_filing GROUP BY 1,2""",
    secday="SELECT DISTINCT c.sector, lp.filed_at FROM lp JOIN v_company c USING (company_id) WHERE lp.price IS NOT NULL",
    grid="SELECT s.sector, s.filed_at, c.company_id FROM secday s JOIN v_company c USING (sector)",
    g1="SELECT g.*, f.fid FROM grid g ASOF LEFT JOIN fday f ON g.company_id=f.company_id AND g.filed_at>=f.filed_at",
    g2="SELECT g.*, px.price FROM g1 g ASOF LEFT JOIN px ON g.company_id=px.company_id AND g.filed_at>=px.trading_date",
    g3="""SELECT g.sector, g.filed_at, g.company_id, CASE WHEN price>0 AND m.shares_outstanding>0 AND m.net_income>0
       THEN price*m.shares_outstanding/(m.net_income*CASE WHEN m.form_type='10-Q' THEN 4 ELSE 1 END) END AS pe FROM g2 g LEFT JOIN v_metric m ON m.filing_id=g.fid""",
    pm="""SELECT a.company_id, a.filed_at, any_value(a.pe) AS pe, count(b.pe) AS n, median(b.pe) AS med FROM g3 a JOIN an USING (company_id, filed_at)
       JOIN g3 b ON a.sector=b.sector AND a.filed_at=b.filed_at AND a.company_id<>b.company_id GROUP BY 1,2""",
    sig="""SELECT f.filing_id, CASE WHEN m1.q>0 AND lp.price>0 THEN greatest(0.0,least(1.0,greatest(0.0,-(lp.price-m1.q)/m1.q)*.4/.4)) END AS mo, va.vs,
       CASE WHEN pm.n>=3 THEN greatest(0.0,least(1.0,(pm.pe/pm.med-1)/2.0)) * CASE WHEN pm.pe IS NULL THEN NULL ELSE 1 END END AS dv
       FROM v_event_filing f LEFT JOIN lp USING (company_id, filed_at) LEFT JOIN m1 USING (company_id, filed_at) LEFT JOIN va USING (company_id, filed_at) LEFT JOIN pm USING (company_id, filed_at)""")


@reg("market_signals", sql(f"""SELECT filing_id, signal_name, round(v,8)+0e0 AS signal_value FROM sig, LATERAL (VALUES ('price_momentum_risk', mo),
 ('volatility_spike', vs), ('market_fundamental_divergence', dv), ('market_signal', {_wavg([('mo', .4), ('vs', .35), ('dv', .25)])})) x(signal_name, v)""",
                           "v_price", "v_event_filing", "v_company", "v_metric", **_MKT))
def market_signals(spark, d):
    f = event_filing(spark, d)
    m = metric(spark, d).select("filing_id", "shares_outstanding", S.annualise(F.col("net_income"), F.col("form_type")).alias("net_income"))
    fin = f.join(m, "filing_id", "left")
    feats = M.market_features(f, price(spark, d), company(spark, d), fin)
    return M.market_signals(feats, at()).select("filing_id", "signal_name", r8(F.col("signal_value")).alias("signal_value"))


# ---------------------------------------------------------------- SIG-20..22
_SEN = dict(
    an="SELECT DISTINCT company_id, filed_at FROM v_event_filing",
    j="""SELECT an.*, n.score, epoch_us(filed_at::TIMESTAMP + INTERVAL 1 DAY) - 1 - epoch_us(n.published_at) AS us FROM an JOIN v_news n USING (company_id)
      WHERE n.published_at < filed_at::TIMESTAMP + INTERVAL 1 DAY AND epoch_us(filed_at::TIMESTAMP + INTERVAL 1 DAY) - 1 - epoch_us(n.published_at) <= 90*86400000000""",
    g="""SELECT company_id, filed_at, count(*) AS n, count(*) FILTER (us<=7*86400000000) AS n7,
      sum(score*w) FILTER (us<=30*86400000000)/sum(w) FILTER (us<=30*86400000000 AND score IS NOT NULL) AS t30, sum(score*w)/sum(w) FILTER (score IS NOT NULL) AS t90
      FROM (SELECT *, exp(-(us//86400000000)/15.0) AS w FROM j) GROUP BY 1,2""",
    s="""SELECT f.filing_id, CASE WHEN coalesce(t30,t90) IS NOT NULL THEN least(1.0,.6*(1-coalesce(t30,t90))/2.0 + CASE WHEN t30 IS NULL THEN 0 ELSE .4*greatest(0.0,(1-t30)/2.0-(1-t90)/2.0) END) END AS tone,
      CASE WHEN n IS NOT NULL THEN greatest(0.0,least(1.0,(n7/(n/13.0)-1.5)/3.0)) END AS vol FROM v_event_filing f LEFT JOIN g USING (company_id, filed_at)""")


@reg("sentiment_signals", sql(f"""SELECT filing_id, signal_name, round(v,8)+0e0 AS signal_value FROM s, LATERAL (VALUES ('news_sentiment_signal', tone),
 ('news_volume_spike', vol), ('sentiment_signal', CASE WHEN tone IS NOT NULL THEN {_wavg([('tone', .7), ('vol', .3)])} END)) x(signal_name, v)""",
                              "v_news", "v_event_filing", **_SEN))
def sentiment_signals(spark, d):
    s = E.sentiment_signals(event_filing(spark, d), news(spark, d), at())
    return s.select("filing_id", "signal_name", r8(F.col("signal_value")).alias("signal_value"))


# ---------------------------------------------------------------- JSN-02 JSN-04 JSN-07
@reg("json_paths", """SELECT event_id, CASE WHEN json_type(props,'$.k') IN ('UBIGINT','BIGINT','DOUBLE') THEN json_extract(props,'$.k')::DOUBLE END AS k,
 NULL::DOUBLE AS quoted, value*2+0e0 AS raw_total, event_id AS back_id FROM events""")
def json_paths(spark, d):
    e = t(spark, d, "events")
    v = J.variant(F.col("props"))
    quoted = J.variant(F.concat(F.lit('{"k": "'), F.col("value").cast("string"), F.lit('"}')))
    dump = F.to_json(F.struct(F.col("value").alias("raw_score"), F.col("value").alias("convergence_boost"), "event_id"))
    return e.select("event_id", J.number_at(v, "$.k").alias("k"), J.number_at(quoted, "$.k").alias("quoted"),
                    J.raw_total(J.variant(dump)).alias("raw_total"), F.get_json_object(dump, "$.event_id").cast("bigint").alias("back_id"))


# ---------------------------------------------------------------- AGG-16 TXT-18 TXT-19 JSN-03 FIL-11 UDF-01 JOB-10
_PROB = "round(CASE WHEN event_id%10<>0 THEN value/503 END,6) AS p, round(CASE WHEN event_id%10<>0 THEN (1-value/503)/2 END,6) AS q"


@reg("argmax_label", f"""SELECT event_id AS news_id, CASE WHEN p IS NULL THEN NULL WHEN p>=q THEN 'positive' ELSE 'negative' END AS label,
 round(CASE WHEN p IS NOT NULL THEN greatest(-1.0,least(1.0,p-q)) END,6)+0e0 AS stored_score, CASE WHEN event_id%10<>0 THEN event_id%7 ELSE event_id%7 END AS kept,
 'Headline '||event_id||'. '||event_type AS article FROM (SELECT *, {_PROB} FROM events)""")
def argmax_label(spark, d):
    from ledgerlens.operators import news as N
    e = F.col("event_id")
    prob = lambda c: F.round(F.when(e % 10 != 0, c), 6)
    n = t(spark, d, "events").select(
        e.alias("news_id"), F.concat(F.lit("Headline "), e).alias("headline"), F.col("event_type").alias("summary"),
        F.lit(None).cast("string").alias("sentiment_label"),
        F.concat(F.lit('{"sentiment_score": null, "keep": '), (e % 7).cast("string"), F.lit("}")).alias("raw_json"),
        prob(F.col("value") / 503).alias("positive"), prob((1 - F.col("value") / 503) / 2).alias("negative"),
        prob((1 - F.col("value") / 503) / 2).alias("neutral"))
    s = N.score_news(N.needs_score(n))
    v = J.variant(F.col("raw_json"))
    return s.select("news_id", F.col("sentiment_label").alias("label"), r8(J.number_at(v, "$.sentiment_score")).alias("stored_score"),
                    J.number_at(v, "$.keep").cast("bigint").alias("kept"),
                    T.article_text(F.col("headline"), F.col("summary")).alias("article"))
