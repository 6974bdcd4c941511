"""Session settings the plans rely on, and the folder for durable cut points."""
import os
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # call-site capture costs several driver round trips per Column; plans here have thousands
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        if spark.conf.isModifiable(k):
            spark.conf.set(k, v)
    return spark


def local_session(cpus="8", name="ledgerlens") -> SparkSession:
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(name)
         .config("spark.sql.shuffle.partitions", str(cpus))
         .config("spark.ui.enabled", "false")
         .config("spark.driver.memory", os.environ.get("LEDGERLENS_DRIVER_MEMORY", "12g"))
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names; one of our own only where it is unset (local tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        path = tempfile.mkdtemp(prefix="ledgerlens-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df):
    """Same rows, lineage cut by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def in_batches(df, rows=256):
    """df, of which Python gets so many rows at a time from now on: for rows that hold a text or a block."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def spread(df, key, rows=None):
    """Rows over all cores when a scan has fewer splits than cores (a few small files), for plans
    that spend much CPU per row. A large input has more splits than cores and is left alone,
    so no shuffle of document texts is added at scale. With `rows`, no task gets many more of them:
    for narrow rows of which a split holds millions (counted without reading a column)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, -(-df.count() // rows)) if rows else cores
    return df.repartition(parts, key) if df.rdd.getNumPartitions() < parts else df
