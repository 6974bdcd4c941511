"""Raw filings by storage key, stored tables, and news normalisation on read."""
from pyspark.sql import DataFrame, functions as F

from ledgerlens.functions import dates as D, strings as T
from ledgerlens.schemas import TABLES


def raw_filings(spark, root) -> DataFrame:
    """Documents under {cik}/{form}/{accession}.txt with the key parts as columns."""
    d = (spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
         .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw_text")))
    part = lambda i: F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)\.txt$", i)
    return d.withColumns({"cik": part(1), "form_key": part(2), "accession_number": part(3)})


def scan(spark, path, table) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(path)


def normalise_news(raw: DataFrame, retrieved_at=None, unescape=T.unescape_entities) -> DataFrame:
    """Raw article rows -> clean rows with the dedupe hash; incomplete and garbage rows dropped."""
    txt = lambda c: T.clean_text(unescape(F.col(c)))
    d = raw.select(
        F.upper(txt("ticker")).alias("ticker"), txt("headline").alias("headline"),
        T.clean_text(T.strip_tags(unescape(unescape(F.col("summary"))))).alias("summary"),
        T.canonical_url(unescape(F.col("url"))).alias("url"), txt("publisher").alias("publisher"),
        D.parse_timestamp(F.col("published_at")).alias("published_at"),
        (retrieved_at if retrieved_at is not None else F.current_timestamp()).alias("retrieved_at"),
        F.coalesce(txt("source_name") if "source_name" in raw.columns else F.lit(None).cast("string"), F.lit("rss")).alias("source_name"),
        (txt("sentiment_label") if "sentiment_label" in raw.columns else F.lit(None).cast("string")).alias("sentiment_label"),
        (F.col("raw_json") if "raw_json" in raw.columns else F.lit(None).cast("string")).alias("raw_json"),
        *(["landed"] if "landed" in raw.columns else []))
    d = d.na.drop(subset=["ticker", "headline", "url", "published_at"])
    d = d.where(~T.is_garbage(F.col("headline"), F.col("summary")))
    d = d.withColumn("summary", F.when(F.col("summary") != F.col("headline"), F.col("summary")))
    return d.withColumn("dedupe_hash", T.article_hash(F.col("url"), F.col("publisher"), F.col("headline"),
                                                      F.col("published_at")))
