"""Text layer: section drift against the comparison filing, and tone of paragraphs."""
from pyspark.sql import DataFrame, functions as F

from ledgerlens import policies as P
from ledgerlens.functions import scoring as S, strings as T
from ledgerlens.operators import aggregates as A, ordered as O, similarity as M, text as X
from ledgerlens.operators.dedupe import top_per_key
from ledgerlens.plans.history import comparison_filings
from ledgerlens.plans.rows import signal_rows, union_all

VERSION = "text_v4"
DRIFT_SECTIONS = {"rlds": "risk_factors", "mda_drift": "mda"}


# ---------------------------------------------------------------- drift
def tfidf_drift(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs: filing_id, previous_filing_id; texts: filing_id, text (one document per filing).
    Mean drift of the most changed units; whole-text drift when either side has no units. The units
    of a filing come out of one text value, which bounds the rank window (`hot_rows=None`)."""
    # split where a filing's text lies after the shuffle that its term counts need too
    placed = texts.select("filing_id", "text").repartition("filing_id")
    # outer: a plain explode would repeat the splitting in a pushed-down not-empty test
    units = (X.with_drift_units(placed).select("filing_id", F.posexplode_outer("units").alias("unit_idx", "unit"))
             .where(F.col("unit").isNotNull()).select("filing_id", "unit_idx", T.tokens(F.col("unit")).alias("tokens")))
    keys = ["filing_id", "previous_filing_id"]
    best = M.best_tfidf(pairs, units, ["filing_id"], ["previous_filing_id"], ["filing_id"])
    top = M.top_k_mean(best.withColumn("drift", S.clip01(1.0 - F.col("best"))), keys, "drift", "unit_idx",
                       hot_rows=None)
    whole = M.tfidf_similarity(pairs, A.term_counts(texts, ["filing_id"], "text"), "filing_id", "previous_filing_id",
                               "filing_id")
    have = texts.where(F.trim("text") != "").select("filing_id")
    usable = pairs.join(have, "filing_id", "left_semi").join(
        have.withColumnRenamed("filing_id", "previous_filing_id"), "previous_filing_id", "left_semi")
    j = usable.select(*keys).join(top, keys, "left").join(whole, keys, "left")
    g = S.clip01(1.0 - F.col("similarity"))
    return j.select(*keys, F.coalesce("top_k_mean", g).alias("tfidf_drift"), g.alias("global_drift"),
                    F.coalesce("top_k_count", F.lit(0)).alias("tfidf_top_k_count"),
                    F.coalesce("unit_count", F.lit(0)).alias("tfidf_unit_count"),
                    F.when(F.col("top_k_mean").isNull(), "global_fallback").otherwise("top_k_sentence_drift")
                    .alias("tfidf_aggregation"), F.col("top_units").alias("top_changed_units"))


def semantic_novelty(pairs: DataFrame, vectors: DataFrame, hot_rows=O.AUTO) -> DataFrame:
    """vectors: filing_id, chunk_idx, embedding. Distance (1 - best cosine) / 2 per current chunk."""
    keys = ["filing_id", "previous_filing_id"]
    if hot_rows == O.AUTO:
        hot_rows = O.hot_limit(vectors, ["filing_id"])
    best = M.best_cosine(pairs, vectors, ["filing_id"], ["previous_filing_id"], ["filing_id"])
    d = best.withColumn("novelty", S.clip01((1.0 - F.col("best")) / 2.0))
    top = M.top_k_mean(d, keys, "novelty", "chunk_idx", hot_rows=hot_rows)
    return top.select(*keys, F.col("top_k_mean").alias("semantic_novelty"), F.col("global_mean").alias("novelty_mean"),
                      F.col("top_k_count").alias("novelty_top_k_count"), F.col("top_units").alias("top_novel_chunks"))


def section_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean best cosine of the current chunks and the drift (1 - s) / 2; NULL when a side is empty."""
    keys = ["filing_id", "previous_filing_id"]
    best = M.best_cosine(pairs, vectors, ["filing_id"], ["previous_filing_id"], ["filing_id"])
    s = best.groupBy(*keys).agg(S.clip(F.avg("best"), -1.0, 1.0).alias("average_best_similarity"))
    return pairs.select(*keys).join(s, keys, "left").withColumn(
        "drift_score", S.clip01((1.0 - F.col("average_best_similarity")) / 2.0))


def history_relative(df: DataFrame, keys, raw="raw_score", hot_rows=O.AUTO) -> DataFrame:
    """z of the raw score against all earlier raw scores of the key, as a score in [0, 1]; NULL with
    fewer than three earlier scores or nearly no spread."""
    r = F.col(raw)
    d = O.running(df, keys, O.Order.by_day("filed_at", "filing_id"),
                  {"__n": S.defined(r), "__s": r, "__ss": r * r}, hot_rows=hot_rows)
    n = F.col("__n")
    mean = F.try_divide(F.col("__s"), n)
    std = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("__ss"), n) - mean * mean))
    enough = n >= P.DRIFT_HISTORY_MIN
    d = d.withColumn("historical_raw_count", n.cast("int"))
    d = d.withColumn("historical_raw_mean", F.when(enough, mean)).withColumn("historical_raw_std", F.when(enough, std))
    z = F.when(F.col("historical_raw_std") >= P.DRIFT_HISTORY_MIN_STD,
               (r - F.col("historical_raw_mean")) / F.col("historical_raw_std"))
    d = d.withColumn("history_zscore", z)
    return d.withColumn("history_relative_score", S.positive_shift_score(F.col("history_zscore"), P.DRIFT_Z_CAP)
                        ).drop("__n", "__s", "__ss")


def drift_features(filings: DataFrame, sections: DataFrame, embeddings: DataFrame, section: str,
                   hot_rows=O.AUTO) -> DataFrame:
    """sections: filing_id, section, sequence_idx, text. embeddings: filing_id, section,
    sequence_idx, chunk_idx, embedding (already of one provider and model)."""
    vectors_hot = hot_rows
    if hot_rows == O.AUTO:
        hot_rows = O.hot_limit(filings, ["company_id"])
    comp = comparison_filings(filings, section, hot_rows)
    pairs = comp.where(F.col("previous_filing_id").isNotNull()).select("filing_id", "previous_filing_id")
    texts = A.ordered_concat(sections.where(F.col("section") == section), ["filing_id"], "text", ["sequence_idx"])
    vec = (embeddings.where(F.col("section") == section)
           .select("filing_id", (F.col("sequence_idx").cast("bigint") * 1_000_000 + F.col("chunk_idx")).alias("chunk_idx"),
                   "embedding"))
    n = vec.groupBy("filing_id").agg(F.count(F.lit(1)).alias("current_chunk_count"))
    keys = ["filing_id", "previous_filing_id"]
    d = (comp.join(tfidf_drift(pairs, texts), keys, "left")
         .join(semantic_novelty(pairs, vec, vectors_hot), keys, "left").join(n, "filing_id", "left")
         .join(n.select(F.col("filing_id").alias("previous_filing_id"),
                        F.col("current_chunk_count").alias("previous_chunk_count")), "previous_filing_id", "left")
         .na.fill(0, ["current_chunk_count", "previous_chunk_count"]))
    return score_drift(d.withColumn("section", F.lit(section)), hot_rows)


def score_drift(d: DataFrame, hot_rows=O.AUTO) -> DataFrame:
    parts = {"tfidf_drift": F.col("tfidf_drift"), "semantic_novelty": F.col("semantic_novelty")}
    d = d.withColumn("raw_score", S.weighted_average(parts, P.TEXT_WEIGHTS))
    d = history_relative(d, ["company_id"], hot_rows=hot_rows)
    basis = F.when(F.col("raw_score").isNotNull(), F.coalesce("semantic_novelty", "raw_score"))
    d = d.withColumn("raw_rescaled_score", S.rescale(basis))
    d = d.withColumn("signal_value", F.when(F.col("raw_score").isNotNull(),
                                            F.coalesce("history_relative_score", "raw_rescaled_score")))
    d = d.withColumn("scoring_mode", F.when(F.col("raw_score").isNull(), "not_available").when(
        F.col("history_relative_score").isNotNull(), "history_relative").otherwise("bounded_raw_rescale"))
    d = d.withColumn("coverage_ratio", S.coverage_ratio(parts.values(), 2))
    fewer = F.least("current_chunk_count", "previous_chunk_count")
    return d.withColumn("confidence", S.text_confidence(fewer, F.col("coverage_ratio")))


def drift_signals(features: DataFrame, name: str, computed_at) -> DataFrame:
    keep = ["section", "tfidf_drift", "semantic_novelty", "raw_score", "raw_rescaled_score", "history_relative_score",
            "history_zscore", "historical_raw_mean", "historical_raw_std", "historical_raw_count", "scoring_mode",
            "days_between_filings", "current_chunk_count", "previous_chunk_count", "comparison_basis",
            "top_changed_units", "top_novel_chunks", "tfidf_aggregation"]
    detail = {k: F.col(k) for k in keep}
    known = F.col("previous_filing_id").isNotNull()
    detail.update(comparison_filing_id=F.col("previous_filing_id"),
                  coverage_ratio=F.when(known, F.col("coverage_ratio")).otherwise(F.lit(0.0)),
                  signal_category=F.lit("text"), signal_role=F.lit("base"))
    rows = signal_rows(features, {name: (F.col("signal_value"), {**detail, "confidence": F.col("confidence")},
                                         F.when(~known, "no_previous_comparable_filing"))}, VERSION, computed_at)
    return rows


# ---------------------------------------------------------------- tone
def tone_paragraphs(sections: DataFrame, limit=None, keywords=P.FORWARD_LOOKING_KEYWORDS, chars=None) -> DataFrame:
    """The paragraphs of the tone sections (with a `limit`, the first so many per filing), with the
    forward-looking flag and the text a scorer sees, whole or its first `chars` characters."""
    d = X.with_paragraphs(sections.where(F.col("section").isin(*P.TONE_SECTIONS)))
    p = d.select("filing_id", "section", "sequence_idx", "section_id", F.posexplode_outer("paragraphs").alias("pos", "text"))
    p = p.where(F.col("text").isNotNull())
    if limit is not None:
        p = top_per_key(p, ["filing_id"], [F.col(c).asc() for c in ("sequence_idx", "section_id", "pos")], limit)
    fwd = (F.col("section") == "forward_looking") | T.is_forward_looking(F.col("text"), keywords)
    return (p.withColumn("is_forward_looking", fwd)
            .withColumn("model_text", F.substring("text", 1, chars) if chars else F.col("text")))


def tone_features(scored: DataFrame, key="filing_id", order=("sequence_idx", "section_id", "pos")) -> DataFrame:
    """scored: paragraphs with positive, negative, neutral (all NULL when the scorer failed)."""
    ok = F.col("positive").isNotNull()
    fwd = ok & F.col("is_forward_looking")
    avg = lambda c, cond: F.avg(F.when(cond, F.col(c)))
    n = scored.groupBy(key).agg(
        F.count(F.lit(1)).alias("paragraph_count"), F.count_if(ok).alias("paragraphs_scored"),
        F.count_if(fwd).alias("forward_count"),
        *[avg(c, ok).alias(f"avg_{c}_all") for c in ("positive", "negative", "neutral")],
        *[avg(c, fwd).alias(f"__{c}_fwd") for c in ("positive", "negative", "neutral")],
        F.slice(F.array_sort(F.collect_list(F.when(ok, F.struct(
            *order, "section", "is_forward_looking",
            *[F.round(c, 4).alias(c) for c in ("positive", "negative", "neutral")],
            F.substring("text", 1, 160).alias("text_preview"))))), 1, 5).alias("sample_scores"))
    for c in ("positive", "negative", "neutral"):  # no forward-looking paragraph: all of them
        n = n.withColumn(f"avg_{c}_forward", F.coalesce(f"__{c}_fwd", f"avg_{c}_all")).drop(f"__{c}_fwd")
    none = F.col("forward_count") == 0
    n = n.withColumn("forward_basis", F.when(none, "all_mda_forward_sections_fallback").otherwise("forward_looking_subset"))
    n = n.withColumn("paragraphs_scored_forward", F.when(none, F.col("paragraphs_scored")).otherwise(F.col("forward_count")))
    total = F.greatest("paragraph_count", F.lit(1))
    n = n.withColumn("coverage_ratio_all", S.clip01(F.col("paragraphs_scored") / total))
    n = n.withColumn("coverage_ratio_forward", S.clip01(F.col("paragraphs_scored_forward") / total))
    n = n.withColumn("confidence", S.text_confidence(F.col("paragraphs_scored"), F.col("coverage_ratio_all")))
    n = n.withColumn("raw_forward_pessimism", F.col("avg_negative_forward") - F.col("avg_positive_forward"))
    return (n.withColumn("text_sentiment", S.clip01(F.col("avg_positive_all")))
            .withColumn("forward_pessimism", S.clip01((F.col("raw_forward_pessimism") + 1.0) / 2.0)))


def tone_signals(filings: DataFrame, features: DataFrame, computed_at) -> DataFrame:
    d = filings.join(features, "filing_id", "left")
    reason = F.when(F.col("paragraph_count").isNull(), "no_paragraphs").otherwise("all_paragraphs_failed")
    common = {"paragraph_count": F.col("paragraph_count"), "confidence": F.col("confidence"), "history_depth": F.lit(0),
              "signal_category": F.lit("text"), "sample_scores": F.col("sample_scores")}
    return signal_rows(d, {
        "text_sentiment": (F.col("text_sentiment"), {
            **common, "coverage_ratio": F.col("coverage_ratio_all"), "paragraphs_scored": F.col("paragraphs_scored"),
            "avg_positive": F.col("avg_positive_all"), "avg_negative": F.col("avg_negative_all"),
            "avg_neutral": F.col("avg_neutral_all"), "signal_role": F.lit("auxiliary")}, reason),
        "forward_pessimism": (F.col("forward_pessimism"), {
            **common, "coverage_ratio": F.col("coverage_ratio_forward"), "paragraph_basis": F.col("forward_basis"),
            "paragraphs_scored": F.col("paragraphs_scored_forward"),
            "raw_forward_pessimism": F.col("raw_forward_pessimism"), "avg_positive": F.col("avg_positive_forward"),
            "avg_negative": F.col("avg_negative_forward"), "avg_neutral": F.col("avg_neutral_forward"),
            "signal_role": F.lit("base")}, reason)}, VERSION, computed_at)


def text_signals(filings, sections, embeddings, tone_scores, computed_at, hot_rows=O.AUTO) -> DataFrame:
    drift = [drift_signals(drift_features(filings, sections, embeddings, sec, hot_rows), name, computed_at)
             for name, sec in DRIFT_SECTIONS.items()]
    return union_all([*drift, tone_signals(filings, tone_features(tone_scores), computed_at)])
