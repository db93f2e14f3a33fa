"""Exact top-k search by inner product: a vector-approximation file narrows down what is read exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placetime.llm.tables import Tables

#: Vectors of a block of the approximation file, and of a block of queries.
BLOCK = 4096
QUERIES = 512
CELL_BITS = 6


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): components floor(scale * x) with x as double; rows without an id, and null or empty vectors
    or those with null or non-finite components, are left out."""
    x = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * scale).cast("long"))
    usable = F.forall(
        vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf"))
    )
    return (
        vectors.filter(F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & usable)
        .select(F.col(id_col).cast("long").alias("id"), x.alias("v"))
        .filter(F.size("v") > 0)
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a batch as rows; shorter ones are filled with zeros, which add nothing to a product."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, bounds = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    lengths = np.diff(bounds)
    if len(lengths) and (lengths == width).all():
        return values[bounds[0] : bounds[-1]].reshape(-1, width).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    for i, n in enumerate(lengths.tolist()):
        out[i, :n] = values[bounds[i] : bounds[i + 1]]
    return out


def _classes(vectors: DataFrame, keep: int) -> DataFrame:
    """(id, ids, v): each different vector once, with its `keep` least ids; further copies can't be among
    the first `keep - 1` of any query, as equal scores go by id.

    Each task folds its copies first, then ids meet in as many groups as a hash of the task gives,
    then per vector, so a vector that most rows hold gathers a few ids per task.
    """
    schema = "v array<long>, ids array<long>"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: dict[bytes, list[int]] = {}
            places: dict[bytes, int] = {}
            lists = batch.column(1)
            values, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
            numbers = batch.column(0).to_numpy()
            for i in np.argsort(numbers, kind="stable").tolist():
                key = values[bounds[i] : bounds[i + 1]].tobytes()
                mine = ids.setdefault(key, [])
                places.setdefault(key, i)
                if len(mine) < keep and int(numbers[i]) not in mine:
                    mine.append(int(numbers[i]))
            rows = pa.array(list(places.values()), pa.int64())
            yield pa.RecordBatch.from_arrays([lists.take(rows), pa.array(list(ids.values()), pa.list_(pa.int64()))], names=["v", "ids"])

    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    folded = vectors.mapInArrow(fold, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    met = folded.groupBy("v", "salt").agg(least.alias("ids")).groupBy("v").agg(least.alias("ids"))
    return met.select(F.col("ids")[0].alias("id"), "ids", "v")


def _blocks(rows: DataFrame, size: int, width: int, n_blocks: int) -> DataFrame:
    """(block, ids, data): vectors packed as 64-bit integers, about `size` to a block."""
    schema = "block long, ids binary, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            vectors = _matrix(batch.column(2), width)
            numbers = batch.column(1).to_numpy()
            for b in np.unique(blocks).tolist():
                mine = blocks == b
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int64()), pa.array([numbers[mine].tobytes()], pa.binary()), pa.array([vectors[mine].tobytes()], pa.binary())],
                    names=["block", "ids", "data"],
                )

    keyed = rows.select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("block"), "id", "v")
    return keyed.repartition("block").sortWithinPartitions("block", "id").mapInArrow(run, schema)


def _approximate(blocks: DataFrame, low: np.ndarray, step: np.ndarray) -> DataFrame:
    """The approximation file: a cell number of CELL_BITS per component instead of the exact number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for data in batch.column(2).to_pylist():
                vectors = np.frombuffer(data, np.int64).reshape(-1, len(low))
                cells.append(((vectors - low) // step).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.binary())], names=["block", "ids", "cells"])

    return blocks.mapInArrow(run, "block long, ids binary, cells binary")


def _bounds(query: np.ndarray, cells: np.ndarray, low: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest inner product that each query can have with each approximated vector."""
    floor = (low + cells.astype(np.float64) * step).T
    up, down = np.maximum(query, 0).astype(np.float64), np.minimum(query, 0).astype(np.float64)
    middle = up @ floor + down @ floor
    width = (step - 1).astype(np.float64)
    # Products of integers are exact below 2^53; beyond, the bounds give way by what rounding may cost.
    slack = np.abs(query).astype(np.float64) @ (np.abs(floor).max(axis=1) + step) * 1e-12
    least = middle + (down @ width)[:, None] - slack[:, None]
    most = middle + (up @ width)[:, None] + slack[:, None]
    return least, most


def _scan(rank: int, low: np.ndarray, step: np.ndarray):
    """Of each block of queries with a block of the file: vectors that may be among a query's first `rank`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                queries, ids = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in (0, 2))
                vectors = np.frombuffer(batch.column(1)[i].as_py(), np.int64).reshape(-1, len(low))
                cells = np.frombuffer(batch.column(3)[i].as_py(), np.uint8).reshape(-1, len(low))
                least, most = _bounds(vectors, cells, low, step)
                kth = np.partition(least, -rank, axis=1)[:, -rank] if least.shape[1] > rank else np.full(len(queries), -np.inf)
                row, column = np.nonzero(most >= kth[:, None])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(queries[row]), pa.array(ids[column]), pa.array(least[row, column]), pa.array(most[row, column])],
                    names=["query_id", "id", "least", "most"],
                )

    return run


def _first(rows: DataFrame, rank: int, *order) -> DataFrame:
    """The first `rank` rows per query, in an order without ties. Ranks within pieces come first, so a
    query with many rows is no single task's work."""
    # `rank` rows per piece are left before a query's rows meet.
    pieces = Window.partitionBy("query_id", "piece").orderBy(*order)
    whole = Window.partitionBy("query_id").orderBy(*order)
    cut = rows.withColumn("piece", F.pmod(F.xxhash64("id"), F.lit(32)))
    few = cut.withColumn("place", F.row_number().over(pieces)).filter(F.col("place") <= rank).drop("piece", "place")
    return few.withColumn("place", F.row_number().over(whole)).filter(F.col("place") <= rank)


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` the `k` rows of `vectors` with the highest
    integer inner product, its own id left out, ties to the smaller id; all, if there are fewer.

    1. Equal vectors are folded into one with its k + 1 least ids.
    2. The approximation file holds a cell of 6 bits per component, between the least and greatest
       value of each component in the whole table. Blocks of it meet blocks of queries; cells bound
       each product from below and above, and a block keeps what may be among a query's best.
    3. Per query, what lies above the (k + 1)th best lower bound of all blocks is left. The ones with
       the highest upper bounds are read exactly first; their (k + 1)th score then says which of the
       others still have to be read, and no other vector can be among the first.

    Blocks hold some thousand rows, so a task's memory doesn't grow with the table. Null or empty
    vectors, those with null or non-finite components, and rows without an id take no part.
    Vectors of different length compare over what both have. A repeated id with different vectors
    stands with each of them; its best score counts. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    tables = Tables(spark, "topk")
    rank = k + 1
    classes = tables.settle(_classes(quantised(vectors, scale, id_col, vector_col), rank))
    asked = tables.settle(quantised(queries, scale, id_col, vector_col))
    parts = classes.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    edges = parts.orderBy("at").collect()  # one row per component
    n, n_queries = classes.count(), asked.count()
    width = max([len(edges), *([asked.agg(F.max(F.size("v"))).first()[0]] if n_queries else [])])
    out_schema = "query_id long, rank int, vec_id long, score long"
    if not n or not n_queries:
        return spark.createDataFrame([], out_schema)
    low, high = np.zeros(width, np.int64), np.zeros(width, np.int64)
    for row in edges:
        low[row["at"]], high[row["at"]] = row["low"], row["high"]
    if classes.agg(F.min(F.size("v"))).first()[0] < width:
        low, high = np.minimum(low, 0), np.maximum(high, 0)  # filled with zeros
    step = (high - low) // (1 << CELL_BITS) + 1

    exact = tables.settle(_blocks(classes.select("id", "v"), BLOCK, width, -(-n // BLOCK)))
    file = tables.settle(_approximate(exact, low, step))
    tables.drop(exact)
    of_queries = tables.settle(_blocks(asked, QUERIES, width, -(-n_queries // QUERIES)))
    tasks = file.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(-(-n_queries // QUERIES) - 1)))).join(
        of_queries.select(F.col("block").alias("query_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), "query_block"
    )
    spread = tasks.repartition("query_block", "block").select("q_ids", "q_data", "ids", "cells")
    scanned = spread.mapInArrow(_scan(rank, low, step), "query_id long, id long, least double, most double")
    scanned = tables.settle(scanned)

    # What is certain after the scan: the (k + 1)th best lower bound over all blocks.
    sure = _first(scanned, rank, F.desc("least"), "id").groupBy("query_id").agg(F.min("least").alias("sure"))
    left = tables.settle(scanned.join(sure, "query_id").filter("most >= sure").select("query_id", "id", "most"))
    tables.drop(file, of_queries, scanned)

    def read(wanted: DataFrame) -> DataFrame:
        """Exact scores of (query, vector) pairs."""
        pairs = wanted.join(classes, "id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
        product = F.aggregate(F.zip_with("q", "v", lambda a, b: F.coalesce(a * b, F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x)
        return pairs.select("query_id", "id", "ids", product.alias("score"))

    early = tables.settle(_first(left, 4 * rank, F.desc("most"), "id").drop("place"))
    read_early = tables.settle(read(early.select("query_id", "id")))
    certain = _first(read_early.select("query_id", "id", "score"), rank, F.desc("score"), "id")
    kth = certain.groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n"))
    later = left.join(early.select("query_id", "id"), ["query_id", "id"], "left_anti").join(kth, "query_id")
    late = read(later.filter((F.col("n") < rank) | (F.col("most") >= F.col("kth"))).select("query_id", "id"))

    scores = read_early.unionAll(late).select("query_id", F.explode("ids").alias("id"), "score").filter("id <> query_id")
    best = scores.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    ranked = _first(best, k, F.desc("score"), "id")
    return ranked.select("query_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
