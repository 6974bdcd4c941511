"""Stage tables in the shared folder, and joins whose small side is measured first."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few dozen bytes that may be sent to every executor (about 100 MB).
BROADCAST_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only on a local master that names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="ledgerlens-llm-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def in_batches(df: DataFrame, rows: int = 256) -> DataFrame:
    """df, with texts crossing to Python some hundred rows at a time from now on, so that a task holds few megabytes."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def sampled(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About `rows` rows of df (all, if it has no more): those whose hash of the key lies below a bound, which one
    count sets. Nothing is sorted or gathered, and the same rows give the same sample."""
    n = df.count()
    return df if n <= rows else df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * rows / n))


def fresh(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; all of an application's lie in one folder named after it."""
    return f"{shared_dir(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and reread: the lineage is cut, a lost executor costs only a reread.
    The files stay until the application's folder is removed (`sweep`)."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Remove the stage tables of this application, once its results are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if a count shows that it has few rows; else as it is, for a shuffled join.
    Give it a stage table: the count then reads no more than file footers."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
