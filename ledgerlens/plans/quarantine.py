"""What a job could not take, set apart with the reason, so that all else goes on.

One row per (step, subject): a filing, or a company where a payload has no filing. A subject that fails again
gets one attempt more, one that goes through leaves the table. After `ATTEMPTS` failures the same input, known
by its hash, is left out; a new payload, or one whose hash is not kept, is tried again.
"""
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from ledgerlens.operators import upsert as U
from ledgerlens.schemas import TABLES, conform

TABLE, ATTEMPTS = "quarantine", 3
#: Companies that one stage may fail for; beyond them the fault is taken to be the stage's.
MOST_FAILED = 10


def input_hash(payload):
    return F.sha2(payload.cast("string"), 256)


def exhausted(store, step, attempts=ATTEMPTS) -> DataFrame:
    """subject and input_hash of what is not tried again."""
    return store.read(TABLE).where((F.col("step") == step) & (F.col("attempts") >= attempts)).select("subject", "input_hash")


def due(store, step, rows: DataFrame, subject, payload, attempts=ATTEMPTS) -> DataFrame:
    """rows without those whose payload has failed `attempts` times already; a row without a payload stays."""
    out = exhausted(store, step, attempts).toDF("__subject", "__hash")
    same = (F.col(subject).cast("string") == F.col("__subject")) & (input_hash(F.col(payload)) == F.col("__hash"))
    return rows.join(out, same, "left_anti")


def waiting(store, steps, attempts=ATTEMPTS) -> DataFrame:
    """company_id of the companies with a failure of these steps that is to be tried again."""
    q = store.read(TABLE).where(F.col("step").isin(*steps) & (F.col("attempts") < attempts) & F.col("company_id").isNotNull())
    return q.select("company_id").distinct()


def _merged(old: DataFrame, tried: DataFrame) -> DataFrame:
    key = ["step", "subject"]
    last = old.select(*key, F.col("attempts").alias("__attempts"), F.col("first_at").alias("__first"), F.col("input_hash").alias("__hash"))
    failed = tried.where(F.col("reason").isNotNull()).join(last, key, "left")
    other = F.col("__hash").isNotNull() & F.col("input_hash").isNotNull() & (F.col("__hash") != F.col("input_hash"))
    again = failed.withColumns({"attempts": F.when(other, 1).otherwise(F.coalesce("__attempts", F.lit(0)) + 1),
                                "first_at": F.when(other, F.col("last_at")).otherwise(F.coalesce("__first", "last_at"))})
    return old.join(tried.select(*key).distinct(), key, "left_anti").select(*old.columns).unionByName(again.select(*old.columns))


def record(store, step, tried: DataFrame, event_type, layer, at, duration_ms=None) -> None:
    """tried: subject, filing_id, company_id, input_hash and reason (NULL: it went through) of all a run took on; of
    several rows of a subject one with a reason counts. Each failure also becomes an event with its ids."""
    one = tried.withColumn("subject", F.col("subject").cast("string")).groupBy("subject").agg(
        *[F.max_by(c, F.struct(F.col("reason").isNotNull(), "reason")).alias(c) for c in ("filing_id", "company_id", "input_hash", "reason")])
    rows = one.where("subject is not null").withColumns({"step": F.lit(step), "last_at": at})
    store.change(TABLE, conform(rows, TABLES[TABLE]), _merged)
    failed = store.read(TABLE).where(F.col("step") == step).join(
        rows.where("reason is not null").select("subject"), "subject", "left_semi")
    detail = F.to_json(F.struct("step", "subject", F.col("reason").alias("error"), F.col("attempts").alias("attempt")))
    U.append_events(U.event_rows(failed, event_type, layer, detail, "filing_id", "company_id", duration_ms, at), store.path("pipeline_events"))


def described(error) -> str:
    """Kind and message of an error, in 500 characters; of one that came out of a Python worker, its last line."""
    lines = [x.strip() for x in str(error).splitlines() if x.strip()]
    told = [x for x in lines if x.split(":")[0].endswith(("Error", "Exception")) and not x.startswith("at ")]
    return f"{type(error).__name__}: {(told or lines or [''])[-1]}"[:500]


def isolated(run, filings: DataFrame, most=MOST_FAILED) -> list[tuple[int | None, str]]:
    """run(filings); where it raises, run on halves of its companies, down to single ones. Returns the companies that
    fail with their errors. run must leave what it wrote for other companies as it was, and be safe to repeat.

    A bad company costs some log2(companies) more runs on ever smaller halves. An error of the plan itself, an error
    on every company and more than `most` bad ones are no fault of rows: the first error is raised."""
    failed, passed, first = [], 0, None
    todo = [filings]
    while todo:
        part = todo.pop()
        try:
            run(part)
            passed += 1
            continue
        except AnalysisException:
            raise
        except Exception as error:
            first = first or error
            reason = described(error)
        ends = part.agg(F.min("company_id").alias("lo"), F.max("company_id").alias("hi"), F.percentile_approx("company_id", 0.5).alias("mid")).first()
        if ends.lo == ends.hi:
            failed.append((ends.lo, reason))
            if len(failed) > most:
                raise first
            continue
        mid = min(ends.mid, ends.hi - 1)
        todo += [part.where(F.col("company_id") > mid), part.where(F.col("company_id").isNull() | (F.col("company_id") <= mid))]
    if failed and not passed:
        raise first
    return failed
