"""Tables as key-hash buckets under a manifest, on any file system Spark can write.

A table is a folder. `data/<write>/bucket=<k>` holds the rows of one bucket as one write left them; a
manifest `manifests/m<version>` lists the folders that make up a version, one for each bucket that has
rows. A change writes new folders for the buckets it touches and commits by putting one manifest in
place, so readers see the old version or the new one, a job that dies leaves the old one, and of two
writers that began from one version the second fails. Versions beyond the last few expire.
"""
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Buckets of a new table where the caller names no number: about a gigabyte each is right, so a large table wants thousands.
BUCKETS = 8
#: Versions that stay readable, and the age in hours from which folders that no manifest ever named (of dead jobs) go.
KEEP, ORPHAN_HOURS = 3, 24


def _fs(spark, path):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _names(fs, folder) -> list[str]:
    return sorted(s.getPath().getName() for s in (fs.listStatus(folder) if fs.exists(folder) else []))


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, Path = _fs(spark, path)
    return [int(n[1:]) for n in _names(fs, Path(f"{path}/manifests")) if n[:1] == "m" and n[1:].isdigit()]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """{"version", "buckets", "by", "folders": {bucket: folder}} of a version, the last one by default."""
    if version is None:
        known = versions(spark, path)
        if not known:
            return None
        version = known[-1]
    fs, Path = _fs(spark, path)
    stream = fs.open(Path(f"{path}/manifests/m{version:010d}"))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark, path, state: dict) -> None:
    """Puts the manifest in place by a rename that fails if that version is there already."""
    fs, Path = _fs(spark, path)
    draft = Path(f"{path}/manifests/draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    no_overwrite = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(Path(f"{path}/manifests/m{state['version']:010d}")), no_overwrite)
    except Exception as error:
        fs.delete(draft, False)
        raise RuntimeError(f"version {state['version']} of {path} was written by another job meanwhile") from error


def _folders(spark, path, schema, folders) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders])


def read(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """A version of a table, the last one by default; empty when none was written."""
    state = manifest(spark, path, version)
    return _folders(spark, path, schema, sorted(state["folders"].values()) if state else [])


def _bucket(by, buckets):
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")


def _land(df: DataFrame, path: str, folder: str, by, buckets) -> dict[str, str]:
    """Writes df by buckets below a folder; the folders of the buckets that have rows."""
    placed = df.withColumn("bucket", _bucket(by, buckets))
    placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}")
    fs, Path = _fs(df.sparkSession, path)
    return {n.split("=")[1]: f"{folder}/{n}" for n in _names(fs, Path(f"{path}/{folder}")) if n.startswith("bucket=")}


def write(spark: SparkSession, df: DataFrame, path: str, by, buckets: int | None = None) -> dict:
    """The whole table as a new version, in as many buckets as it had, or as are named."""
    old = manifest(spark, path)
    buckets = buckets or (old["buckets"] if old else BUCKETS)
    folders = _land(df, path, f"data/{uuid.uuid4().hex}", by, buckets)
    state = {"version": old["version"] + 1 if old else 1, "buckets": buckets, "by": list(by), "folders": folders}
    _commit(spark, path, state)
    expire(spark, path)
    return state


def change(spark: SparkSession, path: str, schema, source: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], by, buckets: int | None = None) -> dict:
    """A new version in which the buckets that source has rows of hold apply(their rows, source); others keep their files.

    by: columns of table and source that rows have in common whenever apply lets one replace the other. The source
    is landed by bucket first, so it is computed once, and what it touches is known from its folders. A source
    without rows leaves the table as it is."""
    old = manifest(spark, path)
    buckets, by = (old["buckets"], old["by"]) if old else (buckets or BUCKETS, list(by))
    incoming = f"incoming/{uuid.uuid4().hex}"
    landed = _land(source, path, incoming, by, buckets)
    known = old["folders"] if old else {}
    state = old
    if landed or not old:
        touched = _folders(spark, path, schema, [known[k] for k in sorted(landed) if k in known])
        batch = _folders(spark, path, source.schema, [landed[k] for k in sorted(landed)])
        new = _land(apply(touched, batch).select([f.name for f in schema.fields]), path, f"data/{uuid.uuid4().hex}", by, buckets)
        state = {"version": old["version"] + 1 if old else 1, "buckets": buckets, "by": by, "folders": {**{k: v for k, v in known.items() if k not in landed}, **new}}
        _commit(spark, path, state)
        expire(spark, path)
    fs, Path = _fs(spark, path)
    fs.delete(Path(f"{path}/{incoming}"), True)
    return state


def difference(spark: SparkSession, path: str, schema, since: int, columns) -> DataFrame | None:
    """The rows (columns, n) that the last version has more often (n > 0) or less often (n < 0) than version `since`,
    or None if that version is gone. Only buckets whose folder is another one are read; columns may leave out what
    does not count as a change."""
    if since not in versions(spark, path):
        return None
    old, new = manifest(spark, path, since), manifest(spark, path)
    if old["version"] == new["version"]:
        return spark.createDataFrame([], schema).select(*columns, F.lit(0).cast("long").alias("n"))
    same_split = old["buckets"] == new["buckets"]
    sides = []
    for mine, theirs, sign in ((old["folders"], new["folders"], -1), (new["folders"], old["folders"], 1)):
        other = [f for k, f in sorted(mine.items()) if not same_split or theirs.get(k) != f]
        sides.append(_folders(spark, path, schema, other).select(*columns, F.lit(sign).cast("long").alias("n")))
    return sides[0].unionByName(sides[1]).groupBy(*columns).agg(F.sum("n").alias("n")).where("n != 0")


def pin(spark: SparkSession, path: str, name: str, version: int | None) -> None:
    """Keeps a version for a reader of that name, instead of the one it kept before; None keeps no more."""
    fs, Path = _fs(spark, path)
    before = [n for n in _names(fs, Path(f"{path}/pins")) if n.rsplit("-", 1)[0] == name]
    if version is not None and f"{name}-{version}" not in before:
        fs.create(Path(f"{path}/pins/{name}-{version}"), True).close()
    for n in before:
        if n != f"{name}-{version}":
            fs.delete(Path(f"{path}/pins/{n}"), False)


def pinned(spark: SparkSession, path: str) -> dict[str, int]:
    fs, Path = _fs(spark, path)
    return {n.rsplit("-", 1)[0]: int(n.rsplit("-", 1)[1]) for n in _names(fs, Path(f"{path}/pins"))}


def expire(spark: SparkSession, path: str, keep: int = KEEP, orphan_hours: float = ORPHAN_HOURS) -> None:
    """Drops all versions but the last `keep` and pinned ones, with the folders only they name, and what dead jobs left behind."""
    fs, Path = _fs(spark, path)
    known = versions(spark, path)
    held = set(pinned(spark, path).values())
    gone = [v for v in known[:-keep] if v not in held]
    stay = [v for v in known if v not in gone]
    used = {f for v in stay for f in manifest(spark, path, v)["folders"].values()}
    old = {f for v in gone for f in manifest(spark, path, v)["folders"].values()} - used
    for v in gone:
        fs.delete(Path(f"{path}/manifests/m{v:010d}"), False)
    for folder in old:
        fs.delete(Path(f"{path}/{folder}"), True)
    writes = {f.split("/")[1] for f in used}
    now = spark._jvm.java.lang.System.currentTimeMillis()
    for part in ("data", "incoming"):
        for s in fs.listStatus(Path(f"{path}/{part}")) if fs.exists(Path(f"{path}/{part}")) else []:
            name = s.getPath().getName()
            emptied = part == "data" and any(f.split("/")[1] == name for f in old) and name not in writes
            if emptied or (name not in writes and now - s.getModificationTime() > orphan_hours * 3_600_000):
                fs.delete(s.getPath(), True)
