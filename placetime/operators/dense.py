"""Empty time buckets between the rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placetime.functions.timeparts import CLOCK_UNITS, step


def dense_runs(aggregates: DataFrame, by: str, unit: str, first: Column, stop: Column) -> DataFrame:
    """Aggregates by (`by`, time_bucket) repeated over the empty buckets after them, as `_bucket`, and
    `_real` where the bucket is the row's own.

    Each row runs up to the next row of its group, the first one also from `first`, the last one
    up to `stop` (excluded). So the aggregates are neither read twice nor joined; a group has at
    most one row per bucket.
    """
    own = F.col("time_bucket")
    group = Window.partitionBy(by).orderBy("time_bucket")
    begin = F.when(F.row_number().over(group) == 1, first).otherwise(own)
    until = F.coalesce(F.lead("time_bucket").over(group), stop)
    marked = aggregates.filter((own >= first) & (own < stop)).select("*", begin.alias("_begin"), until.alias("_until"))
    if unit in CLOCK_UNITS:
        # Days first, then the buckets of each day, so no list is longer than a day's or the days'.
        day = F.explode(F.sequence(F.to_date("_begin"), F.to_date("_until"), F.expr("INTERVAL '1' DAY")))
        marked = marked.select("*", day.alias("_day"))
        opens = F.greatest(F.col("_begin"), F.col("_day").cast("timestamp_ntz"))
        closes = F.least(F.col("_until"), F.col("_day").cast("timestamp_ntz") + F.expr("INTERVAL '1' DAY"))
        marked = marked.withColumns({"_begin": opens, "_until": closes}).drop("_day").filter(F.col("_begin") < F.col("_until"))
    run = F.filter(F.sequence("_begin", "_until", step(unit)), lambda t: t < F.col("_until"))
    dense = marked.select("*", F.explode(run).alias("_bucket")).drop("_begin", "_until")
    return dense.withColumn("_real", F.col("_bucket") == own)
