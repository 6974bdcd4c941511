"""News layer: decayed tone, its deterioration, and volume, per filing."""
from pyspark.sql import DataFrame, functions as F

from ledgerlens import policies as P
from ledgerlens.functions import jsonpath as J, scoring as S
from ledgerlens.operators.intervals import interval_join
from ledgerlens.plans.rows import signal_rows

VERSION = "sentiment_v2"


def article_score(raw_json, label):
    """Numeric score in the raw JSON, clamped to [-1, 1]; else the label's score."""
    table = F.create_map(*[x for k, v in P.LABEL_SCORES.items() for x in (F.lit(k), F.lit(v))])
    stored = S.clip(J.number_at(J.variant(raw_json), "$.sentiment_score"), -1.0, 1.0)
    return F.coalesce(stored, F.try_element_at(table, F.lower(F.trim(label))))


def daily_news(news: DataFrame, score) -> DataFrame:
    """One row per (company, day): everything the windows need, since articles of one day share
    their age. A window opens at the last microsecond of its first day, so articles of exactly
    that microsecond are counted apart."""
    edge = F.date_trunc("day", "published_at") + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")
    return (news.select("company_id", F.to_date("published_at").alias("day"),
                        (F.col("published_at") == edge).alias("edge"), score.alias("__s"))
            .groupBy("company_id", "day", "edge")
            .agg(F.count(F.lit(1)).alias("articles"), F.count("__s").alias("scored"), F.sum("__s").alias("score_sum")))


def news_features(filings: DataFrame, news: DataFrame, score=None) -> DataFrame:
    """Per (company, filed_at): article counts and decayed tone over 7, 30 and 90 days."""
    score = article_score(F.col("raw_json"), F.col("sentiment_label")) if score is None else score
    days = daily_news(news, score)
    anchors = filings.select("company_id", "filed_at").distinct()
    pairs = interval_join(anchors, days, ["company_id"], "filed_at", "day", P.NEWS_WINDOW_DAYS, 0)
    ago = F.datediff("filed_at", "day")
    inside = lambda n: (ago < n) | ((ago == n) & F.col("edge"))
    w = F.exp(-ago / P.NEWS_DECAY_DAYS)
    tone = lambda n: F.try_divide(
        F.sum(F.when(inside(n), F.coalesce("score_sum", F.lit(0.0)) * w)), F.sum(F.when(inside(n), F.col("scored") * w)))
    feats = pairs.where(inside(P.NEWS_WINDOW_DAYS)).groupBy("company_id", "filed_at").agg(
        F.sum("articles").alias("articles_90d"),
        F.coalesce(F.sum(F.when(inside(7), F.col("articles"))), F.lit(0)).alias("articles_7d"),
        F.coalesce(F.sum(F.when(inside(30), F.col("scored"))), F.lit(0)).alias("scored_30d"),
        F.sum("scored").alias("scored_90d"), tone(30).alias("tone_30d"), tone(90).alias("tone_90d"))
    any_news = news.select("company_id").distinct().withColumn("has_news", F.lit(True))
    return (filings.join(feats, ["company_id", "filed_at"], "left").join(any_news, "company_id", "left"))


def sentiment_values():
    t30, t90 = F.col("tone_30d"), F.col("tone_90d")
    recent = F.coalesce(t30, t90)
    risk = lambda x: S.clip01((1.0 - x) / 2.0)
    worse = F.when(t30.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), risk(t30) - risk(t90)))
    tone = F.when(recent.isNotNull(), S.clip01(0.60 * risk(recent) + 0.40 * worse))
    ratio = F.try_divide(F.col("articles_7d").cast("double"), F.col("articles_90d") / 13.0)
    volume = S.clip01((ratio - 1.5) / 3.0)
    both = F.when(tone.isNotNull(), S.weighted_average(
        {"news_sentiment_signal": tone, "news_volume_spike": volume}, P.SENTIMENT_WEIGHTS))
    return {"news_sentiment_signal": tone, "news_volume_spike": volume, "sentiment_signal": both}


def sentiment_signals(filings: DataFrame, news: DataFrame, computed_at, score=None) -> DataFrame:
    d = news_features(filings, news, score).withColumns({f"s_{k}": c for k, c in sentiment_values().items()})
    v = {k: F.col(f"s_{k}") for k in (*P.SENTIMENT_WEIGHTS, "sentiment_signal")}
    parts = {
        "news_sentiment_signal": {k: F.col(k) for k in ("tone_30d", "tone_90d", "scored_30d", "scored_90d")},
        "news_volume_spike": {k: F.col(k) for k in ("articles_7d", "articles_90d")},
        "sentiment_signal": {k: v[k] for k in P.SENTIMENT_WEIGHTS}}
    no_news = F.col("articles_90d").isNull()
    reason = (F.when(no_news & F.col("has_news"), "no_news_in_anchor_window").when(no_news, "missing_news_items")
              .otherwise("insufficient_news_signal_inputs"))
    specs = {}
    for name, value in v.items():
        cover = S.defined_ratio(parts[name].values())
        specs[name] = (value, {
            "article_count_90d": F.col("articles_90d"), "coverage_ratio": cover,
            "confidence": S.sentiment_confidence(F.col("articles_90d"), cover),
            "component_scores": F.struct(*[c.alias(k) for k, c in parts[name].items()]),
            "signal_category": F.lit("sentiment"),
            "signal_role": F.lit("composite_layer" if name == "sentiment_signal" else "base")}, reason)
    return signal_rows(d, specs, VERSION, computed_at)
