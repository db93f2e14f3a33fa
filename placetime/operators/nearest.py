"""Nearest nodes in space and nearest observations in time, for a table of query points."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placetime.functions.timeparts import micros
from placetime.operators.network import sensor_properties
from placetime.plans.sizing import HOT_ROWS, settled

NEIGHBOURS = 10
HALF_WINDOW_MICROS = 12 * 3600 * 1_000_000
RESULTS = 3
# Crowded time lines are cut into so many ranges at most, or more if these would hold more than `HOT_ROWS` rows.
MOST_PIECES = 256

# The neighbour search halves a square around all nodes again and again; a cell of level i is one of
# 4 ** i along a side. Cells of at most `LEAF` nodes are not divided, nor those of the last level.
SPLIT = 4
LEAF = 8
DEEPEST = 14
# Levels of so many cells at most (1.2 MB) are broadcast.
BROADCAST_LEVELS = 3
# The longest list of nodes that a group of queries looks through at once, about.
LIST_NODES = 1000


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Planar distance in degrees."""
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def reporting_nodes(
    nodes: DataFrame, bridge: DataFrame, sensors: DataFrame, features: Sequence[str], network: str | None = None
) -> DataFrame:
    """Nodes with at least one sensor that reports one of the features."""
    if network is not None:
        nodes = nodes.filter(F.col("network") == network)
    able = sensor_properties(sensors).filter(F.col("feature").isin(*features)).select("sensor").distinct()
    carrying = bridge.join(settled(able, "able-sensors"), "sensor", "left_semi").select("network", "node")
    return nodes.join(carrying, ["network", "node"], "left_semi")


def _sides_away(low: Column, high: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Least and greatest distance on one axis between places of two ranges."""
    return F.greatest(start - high, low - end, F.lit(0.0)), F.greatest(end - low, high - start)


def _bounds(df: DataFrame, x0: str = "x0", x1: str = "x1", y0: str = "y0", y1: str = "y1") -> DataFrame:
    """Adds the least and the greatest distance of a query of the group to a node of the cell."""
    q = [F.col(c) for c in GROUP_BOX]
    (near_x, far_x), (near_y, far_y) = _sides_away(q[0], q[1], F.col(x0), F.col(x1)), _sides_away(q[2], q[3], F.col(y0), F.col(y1))
    zero = F.lit(0.0)
    return df.withColumn("lower", distance(near_x, near_y, zero, zero)).withColumn("upper", distance(far_x, far_y, zero, zero))


GROUP = ["gx", "gy"]
GROUP_BOX = ["qx0", "qx1", "qy0", "qy1"]
CELL = ["level", "cx", "cy"]
CELL_BOX = ["n", "x0", "x1", "y0", "y1"]


def _square(placed: DataFrame) -> tuple[float, float, float, int]:
    """Lower left corner and side of the square around all nodes, and their number."""
    x0, y0, x1, y1, n = placed.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.count(F.lit(1))).first()
    return x0, y0, max(x1 - x0, y1 - y0) if n else 0.0, n


def _cells(placed: DataFrame, k: int, levels: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(nodes with a cell per level, cells with their number of nodes and the box around these, depth).

    Tries as many levels as evenly spread nodes would need and a few more; twice as many if that left crowded cells.
    """
    x0, y0, side, n = _square(placed)
    if not n:
        return placed, placed, 0
    deepest = min(DEEPEST, levels or 2 + math.ceil(math.log(n / LEAF + 1, SPLIT * SPLIT))) if side > 0 else 1

    def cell(value: str, start: float, parts: int) -> str:
        return f"CAST(least(floor(({value} - {start!r}D) / {side or 1.0!r}D * {parts}), {parts - 1}) AS BIGINT)"

    by_level = ", ".join(
        f"struct({i} AS level, {cell('x', x0, SPLIT**i)} AS cx, {cell('y', y0, SPLIT**i)} AS cy)" for i in range(1, deepest + 1)
    )
    located = placed.select("*", F.expr(f"explode(array({by_level}))").alias("c")).select(*placed.columns, "c.*")
    box = [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")]
    cells = settled(located.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), *box), "cells")
    crowded = cells.filter(F.col("n") > LEAF).agg(F.max("level")).first()[0] or 0
    if crowded == deepest and levels is None and deepest > 1:
        # Of nodes at the same place only the k with the smallest names can count.
        at_place = Window.partitionBy("x", "y").orderBy("network", "node")
        fewer = placed.withColumn("place", F.row_number().over(at_place)).filter(F.col("place") <= k).drop("place")
        return _cells(settled(fewer, "nodes"), k, DEEPEST)
    depth = min(crowded + 1, deepest)
    return located.filter(F.col("level") <= depth), cells, depth


def knn_nodes(queries: DataFrame, nodes: DataFrame, k: int = NEIGHBOURS, key: str = "query_id") -> DataFrame:
    """(key, network, node, distance, rank) of the k nearest nodes for every query point.

    Exact, by branch and bound over nested cells, all queries at once, level by level. Queries go down together with
    those in the same cell of the lattice, so a level holds a few rows per group and not per query. For each cell the box
    around its nodes bounds their distances from a group's box from both sides. The cells with the least upper bounds
    that hold k nodes together give the distance beyond which no neighbour lies; cells that begin farther away are
    dropped, the others divided, and so is the group. What is left are a few nodes around the k-th neighbours of a group,
    which each of its queries looks through on its own. Ties share a rank; the k-th place goes to the smallest names.
    """
    placed = nodes.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select("network", "node", F.col("lon").alias("x"), F.col("lat").alias("y"))
    placed = settled(placed, "nodes")
    asked = queries.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(key, F.col("lon").alias("qx"), F.col("lat").alias("qy"))
    located, cells, depth = _cells(placed, k)
    if depth == 0:
        none = F.lit(None).cast("string")
        return asked.filter(F.lit(False)).select(key, none.alias("network"), none.alias("node"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank"))

    x0, y0, side, _ = _square(placed)
    fine = SPLIT**depth / (side or 1.0)
    asked = asked.withColumns({"gx": F.floor((F.col("qx") - x0) * fine).cast("long"), "gy": F.floor((F.col("qy") - y0) * fine).cast("long")})
    box = [F.min("qx").alias("qx0"), F.max("qx").alias("qx1"), F.min("qy").alias("qy0"), F.max("qy").alias("qy1")]
    finest = settled(asked.groupBy(*GROUP).agg(*box), "query-groups")

    def groups(level: int) -> DataFrame:
        wide = SPLIT ** (depth - level)
        over = finest.select(*[F.expr(f"({g} - pmod({g}, {wide}L)) div {wide}L").alias(g) for g in GROUP], *GROUP_BOX)
        return over.groupBy(*GROUP).agg(F.min("qx0").alias("qx0"), F.max("qx1").alias("qx1"), F.min("qy0").alias("qy0"), F.max("qy1").alias("qy1"))

    # The first level has at most 16 cells; every group begins with all of them.
    top = cells.filter("level = 1").select(*CELL, *CELL_BOX)
    rows = json.dumps([row.asDict() for row in top.collect()])
    front = groups(1).select("*", F.explode(F.from_json(F.lit(rows), T.ArrayType(top.schema))).alias("c")).select(*GROUP, *GROUP_BOX, "c.*")
    front = _pruned(_bounds(front), GROUP, k)
    for level in range(2, depth + 1):
        inner = groups(level).select(*[F.expr(f"({g} - pmod({g}, {SPLIT}L)) div {SPLIT}L").alias(f"p{g}") for g in GROUP], *GROUP, *GROUP_BOX)
        outer = front.select(F.col("gx").alias("pgx"), F.col("gy").alias("pgy"), *CELL, *CELL_BOX, "reach")
        # What holds k nodes for all of a group does so for a part of it.
        front = _bounds(inner.join(outer, ["pgx", "pgy"])).filter(F.col("lower") <= F.col("reach")).drop("pgx", "pgy", "lower", "upper")
        below = cells.filter(F.col("level") == level).select(
            F.expr(f"cx div {SPLIT}").alias("px"), F.expr(f"cy div {SPLIT}").alias("py"), *[F.col(c).alias(f"_{c}") for c in [*CELL, *CELL_BOX]]
        )
        if level <= BROADCAST_LEVELS:
            below = F.broadcast(below)
        # Cells that are not divided meet nothing, under keys of their own that fall apart.
        open_ = (F.col("level") == level - 1) & (F.col("n") > LEAF)
        own = -1 - F.pmod(F.xxhash64(*GROUP), F.lit(1 << 30))
        to = front.withColumn("jx", F.when(open_, F.col("cx")).otherwise(own)).withColumn("jy", F.when(open_, F.col("cy")).otherwise(own))
        grown = to.join(below, (F.col("jx") == F.col("px")) & (F.col("jy") == F.col("py")), "left")
        grown = grown.select(*GROUP, *GROUP_BOX, "reach", *[F.coalesce(f"_{c}", c).alias(c) for c in [*CELL, *CELL_BOX]])
        front = _pruned(_bounds(grown).filter(F.col("lower") <= F.col("reach")).drop("reach"), GROUP, k)

    met = front.select(*GROUP, *GROUP_BOX, *CELL, "reach").join(located, CELL)
    met = _bounds(met, "x", "x", "y", "y").filter(F.col("lower") <= F.col("reach"))
    # A group's nodes travel as a few lists of bounded length, mostly one.
    lists = F.ceil(F.count(F.lit(1)).over(Window.partitionBy(*GROUP)) / LIST_NODES)
    listed = met.select(*GROUP, F.pmod(F.xxhash64("network", "node"), lists).alias("list"), F.struct("x", "y", "network", "node").alias("c"))
    lists = listed.groupBy(*GROUP, "list").agg(F.collect_list("c").alias("nodes"))
    pairs = asked.join(lists, GROUP).select(key, F.explode(_nearest_of(F.col("nodes"), k)).alias("c")).select(key, "c.network", "c.node", "c.distance")
    by_query = Window.partitionBy(key)
    place = F.row_number().over(by_query.orderBy("distance", "network", "node"))
    ranked = pairs.withColumn("_place", place).filter(F.col("_place") <= k)
    return ranked.withColumn("rank", F.rank().over(by_query.orderBy("distance"))).drop("_place")


def _nearest_of(nodes: Column, k: int) -> Column:
    """The k nearest of a list of nodes to (qx, qy) in order. Lists of one element keep values from being computed per node."""
    gaps = F.transform(nodes, lambda c: F.struct(distance(F.col("qx"), F.col("qy"), c["x"], c["y"]).alias("distance"), c["network"].alias("network"), c["node"].alias("node")))

    def first(near: Column, last: Column) -> Column:
        return F.slice(F.array_sort(F.filter(near, lambda c: c["distance"] <= last)), 1, k)

    def cut(near: Column) -> Column:
        last = F.coalesce(F.get(F.array_sort(F.transform(near, lambda c: c["distance"])), F.lit(k - 1)), F.lit(float("inf")))
        return F.transform(F.array(last), lambda at: first(near, at))[0]

    return F.transform(F.array(gaps), cut)[0]


def _pruned(cells: DataFrame, group: Sequence[str], k: int) -> DataFrame:
    """A group's cells that may hold one of its queries' k nearest nodes, with `reach`, a distance that holds k of them."""
    by_group = Window.partitionBy(*group)
    nearer = by_group.orderBy("upper").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    enough = F.when(F.sum("n").over(nearer) >= k, F.col("upper"))
    bounded = cells.withColumn("enough", enough).withColumn("reach", F.coalesce(F.min("enough").over(by_group), F.lit(float("inf"))))
    return bounded.filter(F.col("lower") <= F.col("reach")).drop("enough", "lower", "upper")


def nearest_node(nodes: DataFrame, lon: float, lat: float, k: int = NEIGHBOURS) -> DataFrame:
    """The k nearest nodes of a single place: a top-k per task, then a merge of k rows each."""
    gap = distance(F.col("lon"), F.col("lat"), F.lit(float(lon)), F.lit(float(lat)))
    placed = nodes.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    top = placed.select("network", "node", gap.alias("distance")).orderBy("distance", "network", "node").limit(k)
    return top.withColumn("rank", F.rank().over(Window.orderBy("distance")))


def nearest_in_time(
    queries: DataFrame,
    obs: DataFrame,
    key: Sequence[str] = ("query_id",),
    tie: Sequence[str] = ("sensor",),
    results: int = RESULTS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """For every query (key, node_id, instant) the observations of its node closest to the instant,
    at most 12 hours away, as the query's columns, the observation's, `gap` in microseconds and `place`.

    Queries and observations are laid on one time line per node and 12-hour slot, and each
    query looks at the few observations just before and just after it; so the work grows with
    the rows, not with the pairs. A query visits its own slot and both neighbours. Where slots hold
    too many rows of either side, the time lines are cut into ranges instead (see `_cut_lines`).

    Only node, time, tie and a hash of the row travel; the rows found are read once more by these.

    Equally close observations: the earlier one first, then the one whose neighbours in the
    (time, tie) order are closer to the query.
    """
    keys = list(key)
    row_hash = F.xxhash64(*[F.col(f"`{f.name}`") if _hashed(f.dataType) else F.to_json(F.struct(f"`{f.name}`")) for f in obs.schema.fields])
    slot_of = F.floor(F.col("_t") / HALF_WINDOW_MICROS)

    def seen_of(rows: DataFrame) -> DataFrame:
        return rows.select("node_id", micros(F.col("datetime")).alias("_t"), row_hash.alias("_o"), F.struct(*tie).alias("_tie")).withColumn(
            "slot", slot_of
        )

    asked = queries.select(*keys, "node_id", micros(F.col("instant")).alias("_t"))
    visits = asked.withColumn("slot", F.explode(F.array(*[slot_of + i for i in (-1, 0, 1)])))
    place = ["node_id", "slot"]

    # Only slots that are asked for take part, and only instants near any query leave the scan.
    ends = asked.agg(F.min("_t").alias("first"), F.max("_t").alias("last"))
    near_any = obs.filter(
        (F.col("datetime") >= F.timestamp_micros(ends.select(F.col("first") - HALF_WINDOW_MICROS).scalar()).cast("timestamp_ntz"))
        & (F.col("datetime") <= F.timestamp_micros(ends.select(F.col("last") + HALF_WINDOW_MICROS).scalar()).cast("timestamp_ntz"))
    )
    seen = seen_of(near_any)
    # One count tells which slots are asked for and which are crowded, on either side.
    both = seen.select(*place, F.lit(1).alias("s"), F.lit(0).alias("v")).unionAll(visits.select(*place, F.lit(0).alias("s"), F.lit(1).alias("v")))
    counted = both.groupBy(*place).agg(F.sum("s").alias("s"), F.sum("v").alias("v")).filter("s > 0 AND v > 0")
    counted = settled(counted, "slots")
    seen = seen.join(counted.select(*place), place, "left_semi")
    total, crowded = counted.agg(F.sum(F.col("s") + F.col("v")), F.max(F.greatest("s", "v"))).first()
    if (crowded or 0) > hot_rows:
        # Each query stands on its node's line once.
        line, visits = ["node_id"], asked.filter("node_id IS NOT NULL AND _t IS NOT NULL")
    else:
        line, visits = place, visits.join(counted.select(*place), place, "left_semi")

    query_type = visits.select(F.struct(*keys).alias("q")).schema["q"].dataType
    both = seen.select(*line, "_t", "_tie", "_o", F.lit(0).alias("kind"), F.lit(None).cast(query_type).alias("q")).unionByName(
        visits.select(
            *line,
            "_t",
            F.lit(None).cast(seen.schema["_tie"].dataType).alias("_tie"),
            F.lit(None).cast(seen.schema["_o"].dataType).alias("_o"),
            F.lit(1).alias("kind"),
            F.struct(*keys).alias("q"),
        )
    )
    if (crowded or 0) > hot_rows:
        both, line = _cut_lines(both, total, results, hot_rows), ["node_id", "piece"]
    found = both.withColumn("_at", F.when(F.col("kind") == 0, F.struct("_t", "_tie", "_o")))
    over = f"OVER (PARTITION BY {', '.join(line)} ORDER BY _t, kind, _tie)"
    sides = [
        F.expr(f"{fn}(_at, {i}) IGNORE NULLS {over}").alias(f"_{fn}{i}") for fn in ("lag", "lead") for i in range(1, results + 1)
    ]
    looked = found.select("q", "kind", "node_id", F.col("_t").alias("_now"), *sides).filter(F.col("kind") == 1)
    near = F.explode(
        F.filter(
            F.array(*[F.col(f"_{fn}{i}") for fn in ("lag", "lead") for i in range(1, results + 1)]),
            lambda o: o.isNotNull() & (F.abs(o["_t"] - F.col("_now")) <= HALF_WINDOW_MICROS),
        )
    )
    pairs = looked.select("q.*", "node_id", "_now", near.alias("_n"))
    # Before the instant the later row of a tie is nearer, after it the earlier one.
    before = F.col("_n._t") <= F.col("_now")
    tie_order = [F.when(before, F.col("_n._tie")).desc_nulls_last(), F.when(~before, F.col("_n._tie")).asc_nulls_last()]
    gap = F.abs(F.col("_n._t") - F.col("_now"))
    window = Window.partitionBy(*keys, "node_id").orderBy(gap, F.col("_n._t"), *tie_order)
    ranked = pairs.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= results)
    winners = ranked.select(*keys, "node_id", F.col("_n._t").alias("_t"), F.col("_n._o").alias("_o"), gap.alias("gap"), "place")
    values = [c for c in obs.columns if c not in {*keys, "node_id"}]
    rows = near_any.select("node_id", micros(F.col("datetime")).alias("_t"), row_hash.alias("_o"), *[F.col(f"`{c}`") for c in values])
    # Rows alike in everything are interchangeable, and each is met by all of them.
    found = winners.join(rows, ["node_id", "_t", "_o"]).dropDuplicates([*keys, "node_id", "place"])
    return found.select(*keys, "node_id", *values, "gap", "place")


def _cut_lines(both: DataFrame, total: int, results: int, hot_rows: int) -> DataFrame:
    """The rows of all time lines with `piece`, the range of (node, time) they fall into, and copies of the observations
    that a query may see beyond its piece.

    Ranges are cut by what the rows hold, so a piece is bounded however crowded a node, a slot or an instant is.
    Of a piece only the first and the last `results` observations can be seen from another one; the nearest of them
    before and after each piece of a node are repeated in it.
    """
    pieces = min(math.ceil(total / hot_rows), max(MOST_PIECES, math.ceil(total / HOT_ROWS)))
    order = ["_t", "kind", "_tie", "_o", "q"]
    whole = settled(both.repartitionByRange(max(pieces, 2), "node_id", *order).withColumn("piece", F.spark_partition_id()), "lines")
    spans = whole.groupBy("node_id").agg(F.min("piece").alias("low"), F.max("piece").alias("high")).filter("low < high")
    spans = settled(spans, "spans").select("node_id")  # at most one node more than there are cuts
    seen = whole.filter("kind = 0").join(F.broadcast(spans), "node_id", "left_semi")
    own, at = Window.partitionBy("node_id", "piece"), ["_t", "_tie", "_o"]
    nth = F.row_number().over(own.orderBy(*at))
    ends = seen.withColumn("first", nth).withColumn("last", F.count(F.lit(1)).over(own) - F.col("first"))
    ends = ends.filter((F.col("first") <= results) | (F.col("last") < results)).select("node_id", "piece", F.lit(1).alias("part"), "first", F.struct(*at).alias("_at"))
    marks = whole.join(F.broadcast(spans), "node_id", "left_semi").select("node_id", "piece").distinct()
    marks = marks.select("node_id", "piece", F.explode(F.array(F.lit(0), F.lit(2))).alias("part"), F.lit(0).alias("first"), F.lit(None).cast(ends.schema["_at"].dataType).alias("_at"))
    over = "OVER (PARTITION BY node_id ORDER BY piece, part, first)"

    def others(fn: str) -> Column:
        return F.array(*[F.expr(f"{fn}(_at, {i}) IGNORE NULLS {over}") for i in range(1, results + 1)])

    looked = ends.unionByName(marks).select("node_id", "piece", "part", others("lag").alias("before"), others("lead").alias("after"))
    beyond = looked.filter("part <> 1").select("node_id", "piece", F.explode(F.when(F.col("part") == 0, F.col("before")).otherwise(F.col("after"))).alias("_at"))
    repeated = beyond.filter("_at IS NOT NULL").select(
        "node_id", "piece", "_at.*", F.lit(0).alias("kind"), F.lit(None).cast(whole.schema["q"].dataType).alias("q")
    )
    return whole.unionByName(repeated, allowMissingColumns=True)


def _hashed(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.ArrayType, T.StructType, T.VariantType))


def nearest_observations(
    queries: DataFrame,
    nodes: DataFrame,
    obs: DataFrame,
    key: str = "query_id",
    neighbours: int = NEIGHBOURS,
    tie: Sequence[str] = ("sensor",),
    results: int = RESULTS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """For every query (key, lon, lat, instant): the observations closest in time at the nearest of
    its `neighbours` nodes that has any within 12 hours."""
    near = knn_nodes(queries, nodes, neighbours, key)
    asked = near.join(queries.select(key, "instant"), key).select(
        key, F.col("node").alias("node_id"), "instant", "distance"
    )
    # Looked at three times below, so the neighbour search is settled first.
    asked = settled(asked, "neighbours")
    found = nearest_in_time(asked, obs, (key, "distance"), tie, results, hot_rows)
    best = Window.partitionBy(key).orderBy("distance", "node_id")
    return found.withColumn("_best", F.rank().over(best)).filter(F.col("_best") == 1).drop("_best")
