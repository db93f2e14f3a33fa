"""Pages of ordered rows at any depth."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placetime.plans.sizing import settled

#: Pages that end within so many rows are a top-k per task and one merge; deeper ones are cut from ranges.
TOP_ROWS = 100_000
_IN_TASK = (1 << 33) - 1


def newest_order(ts: str, tie: Sequence[str]) -> list[Column]:
    return [F.col(ts).desc_nulls_first(), *[F.col(c).asc_nulls_first() for c in tie]]


def cut(df: DataFrame, order: Sequence[Column], offset: int, limit: int | None) -> DataFrame:
    """Rows `offset` to `offset + limit` of `df` in `order`, for any offset and limit, without one task that sees them all.

    Rows are laid out by ranges of the order and written, each with its task and place there; the number of
    rows per task tells which tasks hold the page, and from which place on. So only those ranges are read.
    """
    laid_out = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = laid_out.withColumn("_task", F.spark_partition_id())
    placed = settled(placed.withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_TASK))), "page")
    counts = sorted((r["_task"], r["n"]) for r in placed.groupBy("_task").agg(F.count(F.lit(1)).alias("n")).collect())
    end = None if limit is None else offset + limit
    before, whole, parts = 0, [], []
    for task, n in counts:
        low, high = max(0, offset - before), n if end is None else min(n, end - before)
        if (low, high) == (0, n):
            whole.append(task)
        elif low < high:
            parts.append((F.col("_task") == task) & (F.col("_at") >= low) & (F.col("_at") < high))
        before += n
    # Whole tasks lie side by side.
    wanted = F.col("_task").between(whole[0], whole[-1]) if whole else F.lit(False)
    for part in parts:
        wanted = wanted | part
    return placed.filter(wanted).drop("_task", "_at").orderBy(*order)


def newest(df: DataFrame, ts: str, tie: Sequence[str], limit: int | None = 1000, offset: int = 0) -> DataFrame:
    """Newest rows first, missing dates leading; offset counts before limit.

    A page near the front is a top-k per task and one merge of offset + limit rows; any other one is `cut`.
    """
    order = newest_order(ts, tie)
    if limit is None and not offset:
        return df.orderBy(*order)
    if limit is not None and offset + limit <= TOP_ROWS:
        ordered = df.orderBy(*order)
        return (ordered.offset(offset) if offset else ordered).limit(limit)
    return cut(df, order, offset, limit)


def newest_after(df: DataFrame, ts: str, tie: Sequence[str], last: Mapping[str, object], limit: int) -> DataFrame:
    """The page after the row `last`: rows are found by their place in the order, so a deep page costs no more than the first.

    `last` holds the row's `ts` and `tie` values. The order must tell rows apart, or rows alike in it may be left out.
    """
    kinds = {name: df.schema[name].dataType for name in (ts, *tie)}

    def value(name: str) -> Column:
        return F.lit(last[name]).cast(kinds[name])

    after = F.lit(False)
    for name in reversed(tie):
        column, missing = F.col(name), last[name] is None
        beyond = column.isNotNull() if missing else column > value(name)
        after = beyond | (column.eqNullSafe(value(name)) & after)
    column = F.col(ts)
    # Missing dates lead, so after one of them come all dates.
    beyond = column.isNotNull() if last[ts] is None else column < value(ts)
    after = beyond | (column.eqNullSafe(value(ts)) & after)
    return newest(df.filter(F.coalesce(after, F.lit(False))), ts, tie, limit)
