"""Closed-interval joins on days without a range join: the day line is cut into buckets as
wide as the interval, so each anchor meets its own bucket and the neighbours only."""
from pyspark.sql import DataFrame, functions as F


def interval_join(anchors: DataFrame, events: DataFrame, keys, anchor_day, event_day, before, after, bucket=None,
                  tasks=None) -> DataFrame:
    """Pairs with anchor_day - before <= event_day <= anchor_day + after.

    Pre-aggregate both sides to one row per (keys, day) where the semantics allow: then a
    hot key contributes at most (calendar days) x (interval length) pairs.

    The anchors are repeated, once a bucket they reach. With `bucket`, the events are: an anchor lies in
    one bucket, kept in the column of that name, so pairs grouped by (keys, bucket, anchor) stay where
    they were joined. `tasks`: how many share them, since their number is not seen in the size of either side.
    """
    width = before + after + 1
    b = lambda d: F.floor(d / width)
    num = lambda c: F.unix_date(F.col(c).cast("date"))
    name = bucket or "__bucket"
    if bucket:
        left = anchors.withColumn(name, b(num(anchor_day)))
        right = events.withColumn(name, F.explode(F.sequence(b(num(event_day) - after), b(num(event_day) + before))))
    else:
        left = anchors.withColumn(name, F.explode(F.sequence(b(num(anchor_day) - before), b(num(anchor_day) + after))))
        right = events.withColumn(name, b(num(event_day)))
    if bucket and tasks:
        left, right = (x.repartition(tasks, *keys, name) for x in (left, right))
    gap = F.datediff(F.col(event_day), F.col(anchor_day))
    pairs = left.join(right, [*keys, name]).where(gap.between(-before, after))
    return pairs if bucket else pairs.drop(name)
