"""Tables of a known size, and which keys are hot."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetime.session import scratch_path

BROADCAST_BYTES = 64 * 1024 * 1024
HOT_ROWS = 2_000_000
MAX_HOT_GROUPS = 100_000


def spread(df: DataFrame) -> DataFrame:
    """A scan of the driver's tables laid out over all cores: they are one file of one row group each, and so
    one task, which is far too little for work that is heavy per row. Only queries on those tables use it, no operator."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def with_pieces(
    df: DataFrame, keys: Sequence[str], spread_by: Sequence[str], own: DataFrame | None, other: DataFrame | None
) -> DataFrame:
    """Numbers the pieces of hot groups before a join on `keys`.

    `own_piece` is the one piece a row falls into where `own` says this side's group is hot;
    `other_piece` are all pieces of a group that is hot on the other side, one row each. Joining
    one side's own pieces with the other's other ones keeps every pair and adds none.
    """
    zero = F.lit(0).cast("long")
    if own is None or own.isEmpty():
        df = df.withColumn("own_piece", zero)
    else:
        found = df.join(F.broadcast(own), list(keys), "left")
        piece = F.pmod(F.xxhash64(*spread_by), F.coalesce("shards", F.lit(1)).cast("long"))
        df = found.withColumn("own_piece", piece).drop("shards")
    if other is None or other.isEmpty():
        return df.withColumn("other_piece", zero)
    found = df.join(F.broadcast(other), list(keys), "left")
    last = F.coalesce("shards", F.lit(1)).cast("long") - 1
    return found.withColumn("other_piece", F.explode(F.sequence(zero, last))).drop("shards")


def split_join(
    rows: DataFrame,
    other: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
    other_hot: DataFrame | None = None,
    other_by: Sequence[str] = (),
    gathered: Callable[[DataFrame, list[str]], DataFrame] | None = None,
) -> DataFrame:
    """A shuffled inner join in which hot keys of `rows` are cut into pieces, and the other side's rows
    of those keys repeated for each piece; so no task gets a whole hot key. `hot` are the hot groups where they are known,
    `other_hot` those of the other side, which is cut by `other_by`. `gathered` makes one row of the other side's rows with equal keys."""
    if hot is None:
        hot = hot_groups(rows, keys, hot_rows)
    pieces = {"own_piece": hot, "other_piece": other_hot}
    whole = [piece for piece, known in pieces.items() if known is None or known.isEmpty()]
    cut = with_pieces(rows, keys, spread_by, own=hot, other=other_hot).drop(*whole)
    repeated = with_pieces(other, keys, other_by, own=other_hot, other=hot)
    swapped = [F.col(piece).alias(name) for piece, name in zip(pieces, reversed(pieces))]
    repeated = repeated.select(*other.columns, *swapped).drop(*whole)
    meet = [*keys, *[piece for piece in pieces if piece not in whole]]
    return cut.join(repeated if gathered is None else gathered(repeated, meet), meet).drop(*pieces)


def settled(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, kept if executors are lost, and
    of a size in bytes that Spark knows when it decides between a broadcast and a shuffle."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_groups(df: DataFrame, keys: Sequence[str], rows: int = HOT_ROWS) -> DataFrame:
    """Groups of more than `rows` rows, as keys and `shards`, the number of pieces to cut them into.

    Counted map side first, so the shuffle carries one row per key and task. The groups are found at once and
    settled, as both sides of a plan ask for them.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > rows)
    return hot_of(settled(counted, "hot-groups"), keys, "n", rows)


def hot_of(counted: DataFrame, keys: Sequence[str], size: str, rows: int) -> DataFrame:
    """The hot ones of written groups with their sizes. The threshold rises with the data so that at most
    `MAX_HOT_GROUPS` rows come out: safe to broadcast."""
    hot = counted.filter(F.col(size) > rows)
    n, total = hot.agg(F.count(F.lit(1)), F.sum(size)).first()
    most = float(rows) if n <= MAX_HOT_GROUPS else max(rows, total / MAX_HOT_GROUPS)
    return hot.filter(F.col(size) > most).select(*keys, F.ceil(F.col(size) / most).cast("int").alias("shards"))
