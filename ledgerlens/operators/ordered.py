"""Ordered per-key operators (lag, trailing frames, running totals, as-of joins) that
survive a key holding a large share of all rows.

A plain `Window.partitionBy(key)` puts a whole key into one task, and AQE cannot split a
window. So the row counts per key are checked first (one count over the key columns, with a
map-side combine; plans that chain several operators check their base tables once and pass
the result on as `hot_rows`):

* no key over the limit: the plain window;
* some key over it: the input is cut with `checkpoint()`, the timeline of each hot key is
  split into segments, the window runs per (key, segment), and what crosses a segment edge
  travels separately: the last k rows of the earlier segments for trailing frames
  (`with_halo`), one carried row or running total per segment (`asof`, `running`).

Order is always given by two integers: `unit` (usually the day number) and `tie` (usually
the row id). Time splits on `unit`; a single hot unit splits further on `tie`.

What is broadcast here is bounded by construction: at most total_rows / hot_rows keys, and
as many units, can be over the limit, and a table has a like number of segments.
"""
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.session import cut

HOT_ROWS = 2_000_000
AUTO = "auto"
UNIT, TIE, SEG, HALO = "__unit", "__tie", "__seg", "__halo"
_PLAIN = "struct(cast(0 as bigint) as s, cast(0 as bigint) as u, cast(0 as bigint) as t)"


def hot_limit(df: DataFrame, keys, hot_rows=HOT_ROWS):
    """`hot_rows` when some key has more rows than that, else None."""
    over = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows)
    return None if over.isEmpty() else hot_rows


def _limit(hot_rows, df, keys):
    return hot_limit(df, keys) if hot_rows == AUTO else hot_rows


@dataclass(frozen=True)
class Order:
    """Monotone integer position of a row: (unit, tie)."""
    unit: Column
    tie: Column

    @staticmethod
    def by_day(day, tie):
        c = F.col(day) if isinstance(day, str) else day
        t = F.col(tie) if isinstance(tie, str) else tie
        return Order(F.unix_date(c.cast("date")).cast("bigint"), t.cast("bigint"))


def _exact(c):
    """A 64-bit integer with room for differences: positions may be hashes or scaled scores."""
    return F.col(c).cast("decimal(20,0)")


def _width(low, high, hot_rows):
    """How many positions of a range hold about `hot_rows` of its n rows."""
    return F.greatest(F.lit(1), F.floor((_exact(high) - _exact(low) + 1).cast("double") / F.col("n") * hot_rows)).cast("decimal(20,0)")


def _slot(position, low, width):
    return F.floor((_exact(position) - _exact(low)) / F.col(width)).cast("bigint")


def segmented(df: DataFrame, keys, order: Order, hot_rows) -> DataFrame:
    """Adds the position columns and the segment; only hot keys have more than one."""
    df = df.withColumns({UNIT: order.unit, TIE: order.tie})
    if hot_rows is None:
        return df
    df = cut(df)  # read several times below
    per_unit = df.groupBy(*keys, UNIT).agg(F.count(F.lit(1)).alias("n"), F.min(TIE).alias("lo"),
                                           F.max(TIE).alias("hi"))
    hot_keys = (per_unit.groupBy(*keys)
                .agg(F.sum("n").alias("n"), F.min(UNIT).alias("u0"), F.max(UNIT).alias("u1"))
                .where(F.col("n") > hot_rows)
                .select(*keys, F.col("u0").alias("__u0"),
                        _width("u0", "u1", hot_rows).alias("__width")))
    slot = _slot(UNIT, "__u0", "__width")
    hot_units = (per_unit.where(F.col("n") > hot_rows)
                 .select(*keys, UNIT, F.col("lo").alias("__lo"),
                         _width("lo", "hi", hot_rows).alias("__tw")))
    # a slot holding a hot unit is cut at every unit, and the hot unit itself along the tie
    hot_slots = (hot_units.join(F.broadcast(hot_keys), list(keys))
                 .select(*keys, slot.alias("__slot"), F.lit(True).alias("__cut")).distinct())
    out = (df.join(F.broadcast(hot_keys), list(keys), "left").withColumn("__slot", slot)
           .join(F.broadcast(hot_slots), [*keys, "__slot"], "left")
           .join(F.broadcast(hot_units), [*keys, UNIT], "left"))
    seg = F.when(F.col("__width").isNull(), F.expr(_PLAIN)).otherwise(F.struct(
        F.col("__slot").alias("s"),
        F.when(F.col("__cut"), F.col(UNIT)).otherwise(F.lit(0)).cast("bigint").alias("u"),
        F.when(F.col("__tw").isNotNull(), _slot(TIE, "__lo", "__tw"))
        .otherwise(F.lit(0)).cast("bigint").alias("t")))
    return (out.withColumn(SEG, seg).withColumn("__hot", F.col("__width").isNotNull())
            .drop("__u0", "__width", "__lo", "__tw", "__slot", "__cut"))


def window(keys, hot_rows):
    """Window inside a segment, in row order."""
    return Window.partitionBy(*keys, *([SEG] if hot_rows is not None else [])).orderBy(UNIT, TIE)


def done(df: DataFrame) -> DataFrame:
    """Drops halo rows and helper columns after the window has run."""
    if HALO in df.columns:
        df = df.where(~F.col(HALO))
    return df.drop(UNIT, TIE, SEG, HALO, "__hot")


def _by_position(a, b):
    less = (a[UNIT] < b[UNIT]) | ((a[UNIT] == b[UNIT]) & (a[TIE] < b[TIE]))
    return F.when(less, -1).when((a[UNIT] == b[UNIT]) & (a[TIE] == b[TIE]), 0).otherwise(1)


def with_halo(df: DataFrame, keys, order: Order, rows_before: int, hot_rows) -> DataFrame:
    """Rows plus, for each segment, the `rows_before` rows that precede it, flagged HALO.

    Any frame reaching at most `rows_before` rows back is exact on `window(keys, hot_rows)`; finish
    with `done`.
    """
    s = segmented(df, keys, order, hot_rows)
    if hot_rows is None:
        return s
    s = s.withColumn(HALO, F.lit(False))
    payload = [c for c in s.columns if c not in keys and c != SEG]
    rank = F.row_number().over(Window.partitionBy(*keys, SEG).orderBy(F.desc(UNIT), F.desc(TIE)))
    tails = (s.where("__hot").withColumn("__r", rank).where(F.col("__r") <= rows_before).drop("__r")
             .groupBy(*keys, SEG)
             .agg(F.array_sort(F.collect_list(F.struct(UNIT, TIE, F.struct(*payload).alias("p"))), _by_position)
                  .alias("t")))
    before = F.flatten(F.collect_list("t").over(
        Window.partitionBy(*keys).orderBy(SEG).rowsBetween(-rows_before, -1)))
    halo = (tails.select(*keys, SEG, before.alias("b"))
            .select(*keys, SEG, F.explode(F.slice(
                "b", F.greatest(F.size("b") - rows_before + 1, F.lit(1)), F.lit(rows_before))).alias("x"))
            .select(*keys, SEG, "x.p.*").withColumn(HALO, F.lit(True)))
    return s.unionByName(halo.select(*s.columns))


def lagged(df, keys, order, columns, hot_rows=AUTO) -> DataFrame:
    """columns: {new name: (expression, rows back)}."""
    hot = _limit(hot_rows, df, keys)
    k = max(n for _, n in columns.values())
    s, w = with_halo(df, keys, order, k, hot), window(keys, hot)
    return done(s.withColumns({name: F.lag(e, n).over(w) for name, (e, n) in columns.items()}))


def trailing(df, keys, order, rows_before, make, hot_rows=AUTO) -> DataFrame:
    """make(window in row order without a frame) -> {name: Column}; frames may reach back
    `rows_before` rows."""
    hot = _limit(hot_rows, df, keys)
    s = with_halo(df, keys, order, rows_before, hot)
    return done(s.withColumns(make(window(keys, hot))))


def running(df, keys, order, sums, inclusive=False, hot_rows=AUTO) -> DataFrame:
    """Running totals of non-NULL values over the rows before (or up to) each row.

    sums: {name: Column}; a total over no rows is 0.
    """
    hot_rows = _limit(hot_rows, df, keys)
    s = segmented(df, keys, order, hot_rows)
    names = {n: F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in sums.items()}
    s = s.withColumns({f"__v_{n}": c for n, c in names.items()})
    frame = window(keys, hot_rows).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = s.withColumns({n: F.coalesce(F.sum(f"__v_{n}").over(frame), F.lit(0.0)) for n in names})
    if hot_rows is not None:
        totals = s.where("__hot").groupBy(*keys, SEG).agg(*[F.sum(f"__v_{n}").alias(f"__v_{n}") for n in names])
        prior = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
        base = totals.select(*keys, SEG, *[F.sum(f"__v_{n}").over(prior).alias(f"__b_{n}") for n in names])
        out = out.join(F.broadcast(base), [*keys, SEG], "left").withColumns(
            {n: F.col(n) + F.coalesce(F.col(f"__b_{n}"), F.lit(0.0)) for n in names})
        out = out.drop(*[f"__b_{n}" for n in names])
    return done(out.drop(*[f"__v_{n}" for n in names]))


def asof(left, right, keys, left_day, right_day, right_tie, payload, strict=False,
         hot_rows=AUTO) -> DataFrame:
    """Each left row with the latest right row on or before (`strict`: before) its day.

    One shuffle of the union, no range join. Among right rows of one day the highest
    `right_tie` wins. `payload` names the right columns to attach (as a struct `asof`,
    NULL when there is none). Rows with a NULL day match nothing.
    """
    keep = left.columns
    # two units per day put the side that must come first into the lower one
    lu, ru = (0, 1) if strict else (1, 0)
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("bigint") * 2
    match_type = right.select(F.struct(*payload).alias("asof")).schema["asof"].dataType
    rows = (left.select(*keys, (day(left_day) + lu).alias("__u"), F.lit(0).cast("bigint").alias("__t"),
                        F.struct(*keep).alias("__l"), F.lit(None).cast(match_type).alias("__r"))
            .unionByName(right.where(F.col(right_day).isNotNull())
                         .select(*keys, (day(right_day) + ru).alias("__u"),
                                 (F.col(right_tie) if isinstance(right_tie, str) else right_tie).cast("bigint").alias("__t"),
                                 F.lit(None).cast(left.select(F.struct(*keep).alias("l")).schema["l"].dataType)
                                 .alias("__l"), F.struct(*payload).alias("__r"))))
    if hot_rows == AUTO:
        hot_rows = hot_limit(left.select(*keys).unionByName(right.select(*keys)), keys)
    s = segmented(rows, keys, Order(F.col("__u"), F.col("__t")), hot_rows)
    upto = window(keys, hot_rows).rowsBetween(Window.unboundedPreceding, 0)
    out = s.withColumn("asof", F.last("__r", ignorenulls=True).over(upto))
    if hot_rows is not None:
        lasts = (s.where("__hot").groupBy(*keys, SEG)
                 .agg(F.max_by("__r", F.when(F.col("__r").isNotNull(), F.struct(UNIT, TIE))).alias("__last")))
        prior = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
        carry = lasts.select(*keys, SEG, F.last("__last", ignorenulls=True).over(prior).alias("__carry"))
        out = (out.join(F.broadcast(carry), [*keys, SEG], "left")
               .withColumn("asof", F.coalesce("asof", "__carry")))
    return (out.where(F.col("__l").isNotNull())
            .select("__l.*", F.when(F.col("__u").isNotNull(), F.col("asof")).alias("asof")))
