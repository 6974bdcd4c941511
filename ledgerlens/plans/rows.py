"""The long signal table: one row per (filing, signal)."""
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ledgerlens import policies as P

COLUMNS = ("filing_id", "company_id", "signal_name", "signal_value", "detail", "model_version", "computed_at")


def signal_rows(wide: DataFrame, specs, model_version, computed_at, keep_coverage=()) -> DataFrame:
    """specs: {signal: (value, {detail name: Column}, reason when NULL)} -> long rows.

    One pass over `wide`: the signals are exploded from an array of structs. A row without a
    value states the reason and zero coverage and confidence (`keep_coverage` names keep theirs).
    """
    def one(name, value, detail, reason):
        missing = value.isNull()
        d = {**detail, "model_version": F.lit(model_version)}
        for k in ("coverage_ratio", "confidence"):
            if k in d and not (k == "coverage_ratio" and name in keep_coverage):
                d[k] = F.when(missing, F.lit(0.0)).otherwise(d[k])
        reason = reason if not isinstance(reason, str) else F.lit(reason)
        return F.struct(F.lit(name).alias("signal_name"), value.cast("double").alias("signal_value"),
                        F.to_json(F.struct(*[c.alias(k) for k, c in d.items()],
                                           F.when(missing, reason).alias("availability_reason"))).alias("detail"))
    rows = F.array(*[one(n, v, d, r) for n, (v, d, r) in specs.items()])
    return (wide.select("filing_id", "company_id", F.explode(rows).alias("s"))
            .select("filing_id", "company_id", "s.signal_name", "s.signal_value", "s.detail",
                    F.lit(model_version).alias("model_version"), computed_at.alias("computed_at")))


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def catalogue(spark) -> DataFrame:
    return spark.createDataFrame([list(r) for r in P.SIGNAL_CATALOGUE],
                                 "signal_name string, layer string, description string")


def with_catalogue(signals: DataFrame) -> DataFrame:
    """Layer and description of the fixed 23-row catalogue."""
    return signals.join(F.broadcast(catalogue(signals.sparkSession)), "signal_name", "left")


def pivot_signals(signals: DataFrame, names, value="signal_value", extra={}) -> DataFrame:
    """Long to wide in one map-side-combined aggregation; the name list is fixed, so no extra pass
    discovers it. extra: {suffix: Column} pivoted along with the value."""
    d = signals.where(F.col("signal_name").isin(*names)).withColumns({f"__x{i}": c for i, c in enumerate(extra.values())})
    cols = [F.expr(f"max(CASE WHEN signal_name = '{n}' THEN {c} END) AS {n}{suffix}")
            for suffix, c in [("", value), *[(s, f"__x{i}") for i, s in enumerate(extra)]] for n in names]
    return d.groupBy("company_id", "filing_id").agg(*cols)
