"""The registered queries: each applies one operator, with production settings, to its whole table."""
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.decontamination import leaks
from ledgerlens.llm.id_files import round_trip
from ledgerlens.llm import fingerprints, language, main_text, quality, resampling, secrets, toxicity, whitening
from ledgerlens.llm.near_dedup import near_duplicates
from ledgerlens.llm.packing import pack
from ledgerlens.llm.repeats import repeated

Q_, S_ = {}, {}


def query(fn):
    Q_[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op5_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_binary_packing(spark, sf_dir):
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op10_ranked_id_files(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"))


@query
def op3_language_naive_bayes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out(F.col("doc_id"), 4, 2))
    model = language.fit(docs.where("not held_out"))
    return language.languages(docs, model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op2_secret_ownership(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


S_["op2_secret_ownership"] = secrets.SQL


@query
def op8_template_decontamination(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_bottom_k_fingerprints(spark, sf_dir):
    return fingerprints.edited(table(spark, sf_dir, "documents"))


S_["op6_bottom_k_fingerprints"] = fingerprints.SQL


@query
def op1_paragraph_minhash(spark, sf_dir):
    return repeated(table(spark, sf_dir, "documents"))


@query
def op9_minimum_cut_main_text(spark, sf_dir):
    return main_text.extract(table(spark, sf_dir, "pages"))


@query
def op4_subsequence_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out(F.col("doc_id"), 3, 1))
    labels = table(spark, sf_dir, "labels")
    machine = toxicity.fit(docs.where("not held_out"), labels.where(~language.held_out(F.col("doc_id"), 3, 1)))
    scored = toxicity.toxicity(docs.select("doc_id", "text", "held_out"), machine)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op11_log_likelihood_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.fit(docs, quality.trusted_ids(table(spark, sf_dir, "labels"))))


S_["op11_log_likelihood_quality"] = quality.SQL


@query
def op12_distinct_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_importance_resampling(spark, sf_dir):
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


S_["op13_importance_resampling"] = resampling.SQL
