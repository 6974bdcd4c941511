"""Insider layer: which trades around a filing are opportunistic, by whom, and how late reported."""
from pyspark.sql import DataFrame, Window, functions as F

from ledgerlens import policies as P
from ledgerlens.functions import scoring as S, strings as T
from ledgerlens.operators import aggregates as A, ordered as O
from ledgerlens.operators.dedupe import economic_transactions
from ledgerlens.operators.intervals import interval_join
from ledgerlens.plans.rows import signal_rows

VERSION = "behavior_v3"
BUCKET = "filed_at_bucket"  # where the pairs of trades and anchors lie
TASK_FILINGS = 50_000  # whose pairs one task holds


def prepared_trades(trades: DataFrame) -> DataFrame:
    """Economic transactions with insider key, role, weight and value."""
    value = F.coalesce(F.col("transaction_value").cast("double"),
                       F.coalesce(F.col("price_per_share").cast("double"), F.lit(0.0)) * F.col("shares").cast("double"))
    return (economic_transactions(trades)
            .withColumn("insider_key", T.insider_key(F.col("insider_cik"), F.col("insider_name")))
            .withColumn("role_name", T.role_name(F.col("officer_title"), F.col("is_director")))
            .withColumn("role_weight", T.role_weight(F.col("role_name")))
            .withColumn("shares", F.col("shares").cast("double")).withColumn("value", value))


def compensation_links(trades: DataFrame) -> DataFrame:
    """For each (insider, day) the latest compensation-type row 0 to 7 days earlier. Built from
    distinct days, eight per compensation day, so no self join over trades."""
    days = trades.where(F.col("transaction_code").isin(*P.COMP_LINK_CODES)).select(
        "company_id", "insider_key", "transaction_date").distinct()
    return (days.select("company_id", "insider_key", F.col("transaction_date").alias("comp_date"),
                        F.explode(F.sequence(F.lit(0), F.lit(P.COMP_LINK_DAYS))).alias("__k"))
            .withColumn("transaction_date", F.expr("date_add(comp_date, __k)"))
            .groupBy("company_id", "insider_key", "transaction_date").agg(F.max("comp_date").alias("comp_date")))


def with_history(trades: DataFrame) -> DataFrame:
    """Trades with `comp_date`, the latest compensation-type day 0 to 7 days earlier, and `__sizes`: the
    median size of the insider's S and P trades so far, by day, as far back as a window around the trade
    asks for it. One shuffle by insider serves both; a size that is missing ranks below all others."""
    day = F.unix_date("transaction_date")
    w = Window.partitionBy("company_id", "insider_key").orderBy("__day")
    size = F.when(F.col("transaction_code").isin("S", "P") & F.col("transaction_date").isNotNull(),
                  F.coalesce(F.col("shares"), F.lit(float("-inf"))))
    comp = F.when(F.col("transaction_code").isin(*P.COMP_LINK_CODES), F.col("transaction_date"))
    reach = P.BEHAVIOR_DAYS_BEFORE + P.BEHAVIOR_DAYS_AFTER
    t = (trades.withColumns({"__day": day, "__size": size, "__comp": comp}).withColumns({
        "__median": F.percentile("__size", F.lit(0.5)).over(w.rangeBetween(Window.unboundedPreceding, 0)),
        "comp_date": F.max("__comp").over(w.rangeBetween(-P.COMP_LINK_DAYS, 0)),
        "__first": F.lag("__day").over(w)}))
    step = F.struct("__day", F.when(F.col("__median") != float("-inf"), F.col("__median")).alias("median"))
    t = t.withColumns({  # one entry a day, and the last one before them
        "__near": F.collect_list(F.when(F.col("__first").isNull() | (F.col("__first") != F.col("__day")), step))
        .over(w.rangeBetween(-reach, -1)),
        "__far": F.last(step).over(w.rangeBetween(Window.unboundedPreceding, -reach - 1))})
    sizes = F.when(F.col("__open"), F.array_compact(F.concat(F.array("__far"), "__near")))
    return t.withColumn("__sizes", sizes).drop("__day", "__size", "__comp", "__median", "__first", "__near", "__far")


def classified_trades(anchors: DataFrame, trades: DataFrame, tasks=None) -> DataFrame:
    """Trades of the window around each anchor day with their class. What a pair needs of the insider's
    history hangs on the trade, so the pairs are never shuffled; `filed_at_bucket` says where they lie."""
    open_market = (F.col("transaction_code").isin("S", "P") & (F.col("shares") >= P.OPPORTUNISTIC_MIN_SHARES)
                   & F.col("role_name").isin(*P.OPPORTUNISTIC_ROLES))
    pairs = interval_join(anchors, with_history(trades.withColumn("__open", open_market)), ["company_id"], "filed_at",
                          "transaction_date", P.BEHAVIOR_DAYS_BEFORE, P.BEHAVIOR_DAYS_AFTER, bucket=BUCKET, tasks=tasks)
    start = F.date_sub("filed_at", P.BEHAVIOR_DAYS_BEFORE)
    known = F.filter("__sizes", lambda x: x["__day"] < F.unix_date(start))
    pairs = pairs.withColumn("median_shares", F.get(known, F.size(known) - 1)["median"])
    bigger = F.col("__open") & (F.col("shares") > F.col("median_shares"))
    linked = F.coalesce(F.col("comp_date") >= start, F.lit(False))
    cls = (F.when(bigger & (F.col("transaction_code") == "S") & ~linked, "opportunistic_sell")
           .when(bigger & (F.col("transaction_code") == "P"), "opportunistic_buy").otherwise("routine"))
    return pairs.withColumn("classification", cls).drop("__open", "comp_date", "__sizes")


def _in_place(df, keys):
    """The keys, behind the bucket of their day if the rows still lie by it: groups need no shuffle."""
    return [*[c for c in df.columns if c == BUCKET and c not in keys], *keys]


def insider_activity(classified: DataFrame, keys=("company_id", "filed_at")) -> DataFrame:
    sell, buy = F.col("classification") == "opportunistic_sell", F.col("classification") == "opportunistic_buy"
    first = F.struct("transaction_date", "transaction_id")
    return classified.groupBy(*_in_place(classified, keys), "insider_key").agg(
        F.min_by("insider_name", first).alias("insider_name"), F.min_by("role_name", first).alias("role_name"),
        F.min_by("role_weight", first).alias("role_weight"),
        F.coalesce(F.sum(F.when(sell, F.col("value"))), F.lit(0.0)).alias("opportunistic_sell_value"),
        F.coalesce(F.sum(F.when(buy, F.col("value"))), F.lit(0.0)).alias("opportunistic_buy_value"),
        F.count_if(sell).alias("opportunistic_sell_count"), F.count_if(buy).alias("opportunistic_buy_count"),
        F.count(F.lit(1)).alias("transaction_count"))


def anchor_activity(activity: DataFrame, keys=("company_id", "filed_at")) -> DataFrame:
    s, b = F.col("opportunistic_sell_value"), F.col("opportunistic_buy_value")
    share = F.coalesce(F.try_divide(s, s + b), F.lit(0.0))
    return activity.groupBy(*_in_place(activity, keys)).agg(
        F.coalesce(F.try_divide(F.sum(share * F.col("role_weight")), F.sum("role_weight")), F.lit(0.0))
        .alias("weighted_ita"),
        F.count_if(F.col("opportunistic_sell_count") > 0).alias("unique_sellers_in_window"),
        F.count(F.lit(1)).alias("active_insider_count"), F.sum("transaction_count").alias("window_transaction_count"),
        F.sum("opportunistic_sell_count").alias("opportunistic_sell_count"),
        F.sum("opportunistic_buy_count").alias("opportunistic_buy_count"),
        F.sum(s).alias("opportunistic_sell_value"), F.sum(b).alias("opportunistic_buy_value")).drop(BUCKET)


def late_ratio(anchors: DataFrame, trades: DataFrame, tasks=None) -> DataFrame:
    days = trades.groupBy("company_id", "accession_number", "transaction_date").agg(
        F.min_by("trade_filed_at", F.when(F.col("trade_filed_at").isNotNull(), F.col("transaction_id")))
        .alias("trade_filed_at"))
    rows = interval_join(anchors, days, ["company_id"], "filed_at", "transaction_date", P.GOVERNANCE_DAYS, 0,
                         bucket=BUCKET, tasks=tasks)
    rows = rows.select("company_id", BUCKET, F.col("filed_at").alias("anchor"), "accession_number", "transaction_date",
                       F.col("trade_filed_at").alias("filed_at"))
    late = A.late_filing_ratio(rows, ["company_id", BUCKET, "anchor"])
    return late.drop(BUCKET).withColumnRenamed("anchor", "filed_at")


def _count_before(anchors, rows, day, limit_day, name, hot_rows):
    """Rows strictly before `limit_day`, from running day counts (one row per calendar day)."""
    w = Window.partitionBy("company_id").orderBy("__d").rowsBetween(Window.unboundedPreceding, 0)
    daily = (rows.groupBy("company_id", F.col(day).alias("__d")).agg(F.count(F.lit(1)).alias("n"))
             .withColumn("total", F.sum("n").over(w)))
    left = anchors.withColumn("__limit", limit_day)
    out = O.asof(left, daily, ["company_id"], "__limit", "__d", F.lit(0), ["total"], strict=True, hot_rows=hot_rows)
    return out.select("company_id", "filed_at", F.coalesce("asof.total", F.lit(0)).alias(name))


def behavior_features(filings: DataFrame, trades: DataFrame, hot_rows=O.AUTO, history_limit=None) -> DataFrame:
    """trades carry their own filing day in `filed_at`. With a `history_limit`, no more is reported as depth."""
    if hot_rows == O.AUTO:  # the ordered inputs below hold one row per company and day: at most as many as filings
        hot_rows = O.hot_limit(filings, ["company_id"])
    # several branches below read it; its shuffle is planned once and reused
    e = prepared_trades(trades).withColumnRenamed("filed_at", "trade_filed_at")
    anchors = filings.select("company_id", "filed_at").distinct()
    tasks = max(filings.sparkSession.sparkContext.defaultParallelism, -(-filings.count() // TASK_FILINGS))
    act = anchor_activity(insider_activity(classified_trades(anchors, e, tasks)))
    late = late_ratio(anchors, e, tasks)
    before = _count_before(anchors, e, "transaction_date", F.date_sub("filed_at", P.BEHAVIOR_DAYS_BEFORE),
                           "historical_transaction_count", hot_rows)
    depth = _count_before(anchors, filings.where(F.col("form_type").isin(*P.BEHAVIOR_HISTORY_FORMS)), "filed_at",
                          F.col("filed_at"), "history_depth", hot_rows)
    first = trades.groupBy("company_id").agg(F.min("transaction_date").alias("__first"))
    k = ["company_id", "filed_at"]
    j = anchors.join(act, k, "left").join(late, k, "left").join(before, k, "left").join(depth, k, "left")
    zero = ["weighted_ita", "late_filing_ratio", "unique_sellers_in_window", "active_insider_count",
            "window_transaction_count", "opportunistic_sell_count", "opportunistic_buy_count",
            "opportunistic_sell_value", "opportunistic_buy_value", "historical_transaction_count"]
    j = j.na.fill(0, zero)
    if history_limit is not None:
        j = j.withColumn("history_depth", F.least("history_depth", F.lit(history_limit)))
    out = filings.join(j, k).join(first, "company_id", "left")
    has = F.coalesce(F.col("__first") <= F.date_add("filed_at", P.BEHAVIOR_DAYS_AFTER), F.lit(False))
    return out.withColumn("has_transactions", has).drop("__first")


def behavior_values(text_sentiment="text_sentiment"):
    w = F.col("weighted_ita")
    keen = (F.coalesce(F.col(text_sentiment), F.lit(0.0)) > 0.6) & (w > 0.6)
    ita = F.when(keen, S.clip01(w * 1.25)).otherwise(w)
    conc = S.concentration_step(F.col("unique_sellers_in_window"))
    penalty = F.least(F.lit(P.GOVERNANCE_CAP), F.col("late_filing_ratio") * P.GOVERNANCE_MULTIPLIER)
    has = F.col("has_transactions")
    return {"ita": F.when(has, ita), "insider_concentration": F.when(has, conc),
            "insider_signal": F.when(has, S.clip01(0.70 * ita + 0.30 * conc + penalty))}, penalty


def behavior_signals(features: DataFrame, text_signals: DataFrame, computed_at) -> DataFrame:
    """text_signals: long rows; the `text_sentiment` of the same filing amplifies the asymmetry."""
    tone = (text_signals.where(F.col("signal_name") == "text_sentiment")
            .groupBy("filing_id").agg(F.max_by("signal_value", "computed_at").alias("text_sentiment")))
    d = features.join(tone, "filing_id", "left")
    v, penalty = behavior_values()
    d = d.withColumns({"governance_penalty": penalty, **{f"s_{k}": c for k, c in v.items()}})
    v = {k: F.col(f"s_{k}") for k in v}
    parts = {"ita": ("weighted_ita", "opportunistic_sell_value", "opportunistic_buy_value"),
             "insider_concentration": ("unique_sellers_in_window",), "insider_signal": ("governance_penalty",)}
    specs = {}
    for name, value in v.items():
        comps = [F.col(c) for c in parts[name]]
        cover = S.defined_ratio(comps)
        specs[name] = (value, {
            "coverage_ratio": cover, "history_depth": F.col("history_depth"),
            "confidence": S.behavior_confidence(F.col("history_depth"), F.col("active_insider_count"), cover),
            "component_scores": F.struct(*parts[name]), "text_sentiment": F.col("text_sentiment"),
            "features": F.struct("window_transaction_count", "historical_transaction_count", "active_insider_count",
                                 "opportunistic_sell_count", "opportunistic_buy_count", "late_filing_ratio"),
            "signal_category": F.lit("behavior"),
            "signal_role": F.lit("composite_layer" if name == "insider_signal" else "base")},
            "no_insider_transactions")
    return signal_rows(d, specs, VERSION, computed_at)
