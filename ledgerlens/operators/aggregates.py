"""Grouped aggregates with a map-side combine."""
from pyspark.sql import DataFrame, Window, functions as F

from ledgerlens import policies as P
from ledgerlens.functions import dates as D, scoring as S
from ledgerlens.operators import ordered as O


def _bracket(counts, keys, value, n, hot_rows):
    """Rows of the middle of hot groups (all rows of the others) plus how many lie below them."""
    hot = (counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("__d"), F.sum(n).alias("__size"),
                                     F.percentile_approx(value, [k / 256 for k in range(1, 256)], 100_000).alias("__q"))
           .where(F.col("__d") > hot_rows))
    # 256 slices of the distinct values; the slice holding a rank follows from the slice counts
    j = counts.join(F.broadcast(hot.select(*keys, "__q", "__size")), list(keys), "left")
    s = j.withColumn("__slice", F.when(F.col("__q").isNull(), 0).otherwise(
        F.size(F.filter("__q", lambda x: x < F.col(value)))))
    per = s.where(F.col("__q").isNotNull()).groupBy(*keys, "__slice").agg(F.sum(n).alias("__s"), F.max("__size").alias("__size"))
    w = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("__end", F.sum("__s").over(w)).withColumn("__from", F.col("__end") - F.col("__s"))
    base = F.floor(F.col("__size") / 2)
    need = per.where((F.col("__end") >= base) & (F.col("__from") < base + 2))  # slices meeting the ranks b..b+2
    first = need.groupBy(*keys).agg(F.min("__from").alias("__below"), F.min("__slice").alias("__lo"), F.max("__slice").alias("__hi"))
    out = s.join(F.broadcast(first), list(keys), "left")
    keep = F.col("__q").isNull() | F.col("__slice").between(F.col("__lo"), F.col("__hi"))
    return out.where(keep).select(*keys, value, n, F.coalesce("__below", F.lit(0)).alias("__below"))


def middle_values(counts: DataFrame, keys, value, n="__n", hot_rows=None) -> DataFrame:
    """Values at the ranks b, b+1 and b+2 of each group, b = floor(size / 2), as m0, m1, m2 with the
    group size in `size`. counts: one row per (keys, value) with its multiplicity `n`.

    The rank is a running sum over distinct values in a spilling sort. Groups with more than
    `hot_rows` distinct values are first cut into 256 slices by a sketch; slices away from
    the middle are only counted (map-side combine), and just the middle ones are sorted. The
    slice bounds need not be exact, the counts are. Broadcast: a row per hot group.
    """
    group = Window.partitionBy(*keys)
    upto = group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    if hot_rows is None:  # one shuffle serves the running sum and the total
        r = counts.withColumns({"__to": F.sum(n).over(upto), "size": F.sum(n).over(group)})
    else:
        sizes = counts.groupBy(*keys).agg(F.sum(n).alias("size"))
        r = (_bracket(counts, keys, value, n, hot_rows).withColumn("__to", F.sum(n).over(upto) + F.col("__below"))
             .join(sizes, list(keys)))
    base = F.floor(F.col("size") / 2)

    def at(i):
        hit = (F.col("__to") >= base + i) & (F.col("__to") - F.col(n) < base + i)
        return F.max(F.when(hit, F.col(value))).alias(f"m{i}")
    return r.groupBy(*keys).agg(F.max("size").alias("size"), at(0), at(1), at(2))


def median_of(size, m0, m1):
    return F.when(size % 2 == 1, m1).otherwise((m0 + m1) / 2.0)


def exact_median(df: DataFrame, keys, value, name="median", hot_rows=O.AUTO) -> DataFrame:
    """Exact interpolating median. Equal values are counted before the shuffle."""
    hot = O.hot_limit(df, keys) if hot_rows == O.AUTO else hot_rows
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    m = middle_values(counts, keys, value, hot_rows=hot)
    return m.select(*keys, median_of(F.col("size"), F.col("m0"), F.col("m1")).cast("double").alias(name))


def median_excluding_self(df: DataFrame, group, member, value, out="peer_median", count="peer_count",
                          hot_rows=O.AUTO) -> DataFrame:
    """For every member the median of the other members' values in its group.

    No member pairs: the median of the n-1 others is read from three middle order statistics
    of all n values. Without its own value v the i-th smallest is the old i+1-th if v is at
    most the old i-th, else the old i-th. Members without a value see the median of all.
    """
    hot = O.hot_limit(df, group) if hot_rows == O.AUTO else hot_rows
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__n"))
    j = df.join(middle_values(counts, group, value, hot_rows=hot), list(group), "left")
    v, n = F.col(value), F.coalesce(F.col("size"), F.lit(0))
    m0, m1, m2 = F.col("m0"), F.col("m1"), F.col("m2")
    rest = n - F.when(v.isNotNull(), 1).otherwise(0)
    # ranks of the middle of n-1: b and b (n even: n-1 odd) or b and b+1 (n odd)
    at_b, at_b1 = F.when(v <= m0, m1).otherwise(m0), F.when(v <= m1, m2).otherwise(m1)
    without = F.when(n % 2 == 0, at_b).otherwise((at_b + at_b1) / 2.0)
    med = F.when(rest > 0, F.when(v.isNull(), median_of(n, m0, m1)).otherwise(without))
    return j.withColumn(out, med.cast("double")).withColumn(count, rest.cast("int")).drop("size", "m0", "m1", "m2")


def insider_summary(trades: DataFrame, keys=("company_id",)) -> DataFrame:
    v, code = F.col("transaction_value"), F.col("transaction_code")
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(F.col("transaction_type_normalized") == "open_market_sell").alias("opportunistic_sells"),
        F.coalesce(F.sum(F.when(code == "S", v)), F.lit(0.0)).alias("total_sell_value"),
        F.coalesce(F.sum(F.when(code == "P", v)), F.lit(0.0)).alias("total_buy_value"),
        F.max("transaction_date").alias("latest_transaction_date"))


def latest_period_facts(facts: DataFrame, aliases, created="created_at", row_id="fact_id") -> DataFrame:
    """Facts of each company's latest period; per summary name the first alias present,
    newest row first. aliases: {name: ordered concepts}."""
    newest = facts.groupBy("company_id").agg(F.max("period_end").alias("period_end"))
    rows = facts.join(newest, ["company_id", "period_end"], "left_semi")
    aggs = []
    for name, concepts in aliases.items():
        rank = alias_rank(F.col("concept"), concepts)
        usable = F.col("concept").isin(*concepts) & F.col("value").isNotNull()
        order = F.struct(rank, -F.unix_micros(F.col(created)), -F.col(row_id))
        aggs.append(F.min_by(F.col("value").cast("double"), F.when(usable, order)).alias(name))
    return rows.groupBy("company_id").agg(F.max("period_end").alias("period_end"), *aggs)


def alias_rank(concept, concepts):
    out = F.lit(len(concepts))
    for i, c in reversed(list(enumerate(concepts))):
        out = F.when(concept == c, F.lit(i)).otherwise(out)
    return out


def best_facts(filings: DataFrame, facts: DataFrame, aliases=None, durations=P.DURATION_FACTS) -> DataFrame:
    """One value per (filing, canonical name): USD first, then alias order, distance of the
    period end to the filing's, distance of the duration to a year or quarter, row id."""
    aliases = aliases or P.FACT_ALIASES
    anchor = filings.select("filing_id", F.coalesce("period_of_report", "filed_at").alias("__end"),
                            F.when(F.col("form_type").isin(*P.ANNUAL_FORMS), 365).otherwise(90).alias("__days"))
    concepts = sorted({c for v in aliases.values() for c in v})
    rows = (facts.where(F.col("concept").isin(*concepts) & F.col("value").isNotNull())
            .join(anchor, "filing_id"))
    end_gap = F.coalesce(F.abs(F.datediff("period_end", "__end")), F.lit(0))
    span_gap = F.coalesce(F.abs(F.datediff("period_end", "period_start") - F.col("__days")), F.lit(0))
    aggs = []
    for name, names in aliases.items():
        order = F.struct((F.coalesce(F.col("unit"), F.lit("")) != "USD").alias("u"),
                         alias_rank(F.col("concept"), names).alias("a"), end_gap.alias("e"),
                         (span_gap if name in durations else F.lit(0)).alias("d"), F.col("fact_id").alias("i"))
        aggs.append(F.min_by(F.col("value").cast("double"),
                             F.when(F.col("concept").isin(*names), order)).alias(name))
    return rows.groupBy("filing_id").agg(*aggs)


def late_filing_ratio(rows: DataFrame, keys) -> DataFrame:
    """rows: one per (keys, accession_number, day) with the first known `filed_at` of the day.
    Share of accessions reported late: no filing date, or more than two business days."""
    per = rows.groupBy(*keys, "accession_number").agg(
        F.min("transaction_date").alias("first_trade"),
        F.min_by("filed_at", F.when(F.col("filed_at").isNotNull(), F.col("transaction_date"))).alias("filed"))
    late = F.col("filed").isNull() | (D.business_days(F.col("first_trade"), F.col("filed")) > P.LATE_BUSINESS_DAYS)
    return per.groupBy(*keys).agg(F.avg(late.cast("double")).alias("late_filing_ratio"))


def decayed_mean(df, keys, score, days, name="decayed", count="scored"):
    w = F.exp(-F.col(days) / P.NEWS_DECAY_DAYS)
    s = F.col(score)
    return df.groupBy(*keys).agg(
        F.try_divide(F.sum(s * w), F.sum(F.when(s.isNotNull(), w))).alias(name), F.count(s).alias(count))


def yearly_signals(raw: DataFrame) -> DataFrame:
    """raw: ticker, year, signal_key, signal_label, signal_value and the row order (filed_at, seq)."""
    v = F.col("signal_value")
    order = F.when(v.isNotNull(), F.struct(F.coalesce("filed_at", F.lit("0001-01-01").cast("date")), "seq"))
    return raw.groupBy("ticker", "year", "signal_key", "signal_label").agg(
        F.count(F.lit(1)).alias("point_count"), F.count(v).alias("non_null_points"), F.avg(v).alias("mean_value"),
        F.max_by(v, order).alias("last_value"), F.min(v).alias("min_value"), F.max(v).alias("max_value"))


ADVICE = {  # verdict -> recommendation
    "missing": "No values: fix data coverage or the computation.",
    "sparse": "One year only: collect more history.",
    "always_zero": "Always zero: check the formula.",
    "flat": "Hardly moves: check the calibration.",
    "always_high": "Saturated: check the scale.",
    "variable": "Keep, and compare turning points with known events.",
}


def signal_flags(yearly: DataFrame) -> DataFrame:
    m = F.col("mean_value")
    g = yearly.groupBy("ticker", "signal_key", "signal_label").agg(
        F.count(m).alias("yearly_points"), F.min(m).alias("min_value"), F.max(m).alias("max_value"),
        F.avg(m).alias("mean_value"), F.max(F.abs(m)).alias("__abs"))
    n, rng = F.col("yearly_points"), F.col("max_value") - F.col("min_value")
    verdict = (F.when(n == 0, "missing").when(n == 1, "sparse").when(F.col("__abs") < 1e-9, "always_zero")
               .when((n >= 3) & (rng <= P.FLAT_RANGE), "flat")
               .when((n >= 3) & (F.col("min_value") >= P.ALWAYS_HIGH), "always_high").otherwise("variable"))
    advice = F.create_map(*[x for k, v in ADVICE.items() for x in (F.lit(k), F.lit(v))])
    return (g.withColumn("range_value", rng).withColumn("verdict", verdict)
            .withColumn("recommendation", advice[F.col("verdict")]).drop("__abs"))


def term_counts(df, keys, text):
    """Counts per (keys, token). The text is what is shuffled, by the keys alone; its terms become rows where
    they are counted, and what groups or joins by the same keys next finds them in place."""
    from ledgerlens.functions.strings import tokens
    return (df.select(*keys, text).repartition(*keys)
            .select(*keys, F.explode_outer(tokens(F.col(text))).alias("token")).where(F.col("token").isNotNull())
            .groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("term_count")))


def document_frequency(counts):
    return counts.groupBy("token").agg(F.count(F.lit(1)).alias("doc_count"), F.sum("term_count").alias("total_count"))


def ordered_concat(df, keys, text, order, sep="\n"):
    """Non-blank pieces in order. The result value is the whole text of the key, so a key
    must be one document; pieces are trimmed before the shuffle."""
    t = F.trim(F.col(text))
    rows = df.select(*keys, *order, t.alias("__t")).where(F.col("__t") != "")
    return rows.groupBy(*keys).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(*order, "__t"))), lambda x: x["__t"]), sep).alias(text))


def run_summary(signals: DataFrame, stage="layer") -> DataFrame:
    """Per stage: rows, available rows, signal names and the names never available.
    Names come from the catalogue, so the collected sets are small."""
    n = signals.groupBy(stage, "signal_name").agg(
        F.count(F.lit(1)).alias("n"), F.count("signal_value").alias("ok"))
    return n.groupBy(stage).agg(
        F.sum("n").alias("signal_count"), F.sum("ok").alias("available_count"),
        F.array_join(F.array_sort(F.collect_set("signal_name")), ",").alias("signal_names"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("ok") < F.col("n"), F.col("signal_name")))), ",")
        .alias("not_available"))


def argmax_label(pos, neg, neu):
    """Label of the largest probability; ties go positive, negative, neutral."""
    top = F.greatest(pos, neg, neu)
    return F.when(pos == top, "positive").when(neg == top, "negative").otherwise("neutral")


def defined_names(values):
    """values: {name: Column} -> names with a value."""
    return F.filter(F.array(*[F.when(c.isNotNull(), F.lit(n)) for n, c in values.items()]),
                    lambda x: x.isNotNull())


def missing_names(values):
    return F.array_except(F.array(*[F.lit(n) for n in values]), defined_names(values))


def missing_layers(values, layers=None):
    layers = layers or P.CRITICAL_LAYERS
    return F.filter(F.array(*[F.when(F.coalesce(*[values[n] for n in names]).isNull(), F.lit(layer))
                              for layer, names in layers.items()]), lambda x: x.isNotNull())


def z_scores(current, history, count):
    """current, history: {metric: (Column)} with (count, mean, std) per metric -> z or NULL."""
    out = {}
    for m, cur in current.items():
        n, mean, std = history[m]
        ok = (count >= P.ANOMALY_MIN_HISTORY) & (n >= P.ANOMALY_MIN_HISTORY) & (std >= P.ANOMALY_MIN_STD)
        out[m] = F.when(ok, (cur - mean) / std)
    return out


def rms(zs):
    cols = list(zs.values())
    return F.sqrt(F.try_divide(S.sum_cols([F.coalesce(z * z, F.lit(0.0)) for z in cols]),
                               S.sum_cols([S.defined(z) for z in cols]).cast("double")))
