"""Scoring of articles from class probabilities, by a caller's model or a table."""
from pyspark.sql import DataFrame, functions as F

from ledgerlens import policies as P
from ledgerlens.functions import jsonpath as J, scoring as S, strings as T
from ledgerlens.operators.aggregates import argmax_label


def apply_scorer(df: DataFrame, text, scorer) -> DataFrame:
    """scorer: pandas UDF (iterator form loads its model once per task) from text to
    struct<positive,negative,neutral>; a failed text gives NULL."""
    return df.withColumn("__p", scorer(F.col(text))).select(
        *df.columns, *[F.col(f"__p.{c}").alias(c) for c in ("positive", "negative", "neutral")])


def apply_embedder(chunks: DataFrame, embedder, dimension, text="text") -> DataFrame:
    """embedder: pandas UDF text -> array<float>; a vector of another size fails the job."""
    d = chunks.withColumn("embedding", embedder(F.col(text)))
    ok = F.when(F.size("embedding") == dimension, True).otherwise(
        F.raise_error(F.concat(F.lit("expected dimension "), F.lit(str(dimension)))).cast("boolean"))
    return d.where(ok)


def needs_score(news: DataFrame) -> DataFrame:
    return news.where(J.number_at(J.variant(F.col("raw_json")), "$.sentiment_score").isNull())


def score_news(scored: DataFrame, model="tone-model") -> DataFrame:
    """Adds the clamped score, its parts and the model to the raw JSON, and the label; rows whose
    probabilities are NULL stay as they are."""
    p, n, u = F.col("positive"), F.col("negative"), F.col("neutral")
    score = S.clip(p - n, -1.0, 1.0)
    extra = F.from_json(F.to_json(F.struct(
        F.round(score, 6).alias("sentiment_score"), F.round(p, 6).alias("finbert_positive"),
        F.round(n, 6).alias("finbert_negative"), F.round(u, 6).alias("finbert_neutral"),
        F.lit(model).alias("sentiment_model"))), "map<string,variant>")
    base = F.coalesce(F.from_json("raw_json", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
    merged = F.to_json(J.merge(base, extra))
    ok = p.isNotNull()
    return (scored.withColumn("raw_json", F.when(ok, merged).otherwise(F.col("raw_json")))
            .withColumn("sentiment_label", F.when(ok, argmax_label(p, n, u)).otherwise(F.col("sentiment_label")))
            .drop("positive", "negative", "neutral"))


def model_text(news: DataFrame, chars=None) -> DataFrame:
    """The text a scorer sees, whole or its first `chars` characters."""
    text = T.article_text(F.col("headline"), F.col("summary"))
    return news.withColumn("model_text", F.substring(text, 1, chars) if chars else text)
