"""The rerun-safe ingestion of the batch jobs as Structured Streaming."""
from pyspark.sql import DataFrame, functions as F

from ledgerlens.operators import upsert as U

def deduplicated(stream: DataFrame, keys, event_time, delay="2 days") -> DataFrame:
    """Drops repeats of a natural key that arrive within the delay; state is bounded by it."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def upsert_sink(path, schema, keys, position=None):
    """foreachBatch function. Safe to repeat: the same batch gives the same table, and an empty
    last batch (which availableNow may send) writes nothing."""
    def write(batch: DataFrame, _):
        if not batch.isEmpty():
            spark = batch.sparkSession
            # only the buckets of the batch's keys are rewritten
            U.write_upsert(spark, path, schema, batch.select(*[f.name for f in schema.fields],
                                                             *([position] if position else [])), keys, position)
    return write


def start_upsert(stream, path, schema, keys, name, event_time=None, position=None, delay="2 days", **trigger):
    """The checkpoint lies beside the table, where a restart finds it."""
    s = deduplicated(stream, keys, event_time, delay) if event_time else stream
    return (s.writeStream.foreachBatch(upsert_sink(path, schema, keys, position))
            .option("checkpointLocation", f"{path}.checkpoints/{name}")
            .trigger(**(trigger or {"availableNow": True})).start())


def news_volume(stream: DataFrame, event_time="published_at", key="company_id", width="7 days", slide="1 day",
                delay="2 days") -> DataFrame:
    """Articles per company in sliding weeks."""
    return (stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width, slide), key)
            .agg(F.count(F.lit(1)).alias("articles"))
            .select(key, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "articles"))


def append_log(stream: DataFrame, path, name, **trigger):
    """Event rows appended to the log; the checkpoint lies beside it."""
    return (stream.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", f"{path}.checkpoints/{name}")
            .outputMode("append").trigger(**(trigger or {"availableNow": True})).start())
