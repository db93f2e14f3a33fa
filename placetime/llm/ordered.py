"""Places of rows in their groups, without a task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placetime.llm.tables import Tables

_IN_TASK = (1 << 33) - 1


def places(rows: DataFrame, group: str, order: Sequence[Column], tables: Tables) -> DataFrame:
    """`rows` with `index`, a row's place in its group from 0, and `total`, the group's size.

    Rows are laid out by ranges of group and `order`, so that a group of any size spreads over tasks;
    counts of each task's part of a group, one row each, shift its places. A null group is a group, the
    first one. Rows alike in group and order take their places in any order. `rows` should be a
    written table, as its keys are sampled first; order by short values, hashes of texts for instance.
    """
    keys = [F.col(group).asc_nulls_first(), *order]
    laid_out = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    task, at = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_TASK))
    placed = tables.settle(laid_out.withColumn("task", task).withColumn("at", at))
    runs = placed.groupBy("task", group).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(group)
    earlier = F.sum("n").over(whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    shifts = runs.select(
        F.col("task").alias("shift_task"), F.col(group).alias("shift_group"),
        (F.coalesce(earlier, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("total"),
    )
    same = (F.col("task") == F.col("shift_task")) & F.col(group).eqNullSafe(F.col("shift_group"))
    return placed.join(shifts, same).select(*rows.columns, (F.col("at") + F.col("shift")).alias("index"), "total")
