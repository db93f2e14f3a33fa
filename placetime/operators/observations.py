"""Sensor observations: raw queries, per-node aggregates, gap filling, triggers.

An observation table holds `node_id`, `datetime`, `meta_id`, `sensor` and one column per
property.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placetime.functions.timeparts import bucket, check_unit, ts_lit
from placetime.operators.dense import dense_runs
from placetime.operators.filters import compile_tree, condition
from placetime.operators.paging import newest
from placetime.plans.sizing import HOT_ROWS, hot_groups, settled

META_COLUMNS = ("node_id", "datetime", "meta_id", "sensor")

AGGREGATES = {
    "avg": F.avg,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "max": F.max,
    "min": F.min,
    "med": F.median,
}


def select_observations(
    obs: DataFrame,
    start=None,
    end=None,
    nodes: Sequence[str] | None = None,
    sensors: Sequence[str] | None = None,
    prop: str | None = None,
    tree: Mapping | str | None = None,
) -> DataFrame:
    """Observations in [start, end) of some nodes and sensors (any case), where `prop` is known."""
    if start is not None:
        obs = obs.filter(F.col("datetime") >= ts_lit(start))
    if end is not None:
        obs = obs.filter(F.col("datetime") < ts_lit(end))
    if nodes:
        obs = obs.filter(F.lower("node_id").isin([n.lower() for n in nodes]))
    if sensors:
        obs = obs.filter(F.lower("sensor").isin([s.lower() for s in sensors]))
    if prop is not None:
        if prop not in obs.columns:
            raise ValueError(f"unknown property {prop!r}")
        obs = obs.filter(F.col(f"`{prop}`").isNotNull())
    if tree is not None:
        obs = obs.filter(compile_tree(obs.schema, tree))
    return obs


def observations(obs: DataFrame, limit: int | None = 1000, offset: int = 0, tie: Sequence[str] = ("node_id", "sensor"), **filters) -> DataFrame:
    """The newest matching observations."""
    return newest(select_observations(obs, **filters), "datetime", tie, limit, offset)


def with_results(obs: DataFrame, feature: str) -> DataFrame:
    """Observations as handed out: who, when, and the properties gathered in `results`."""
    properties = [c for c in obs.columns if c not in META_COLUMNS]
    return obs.select(
        F.col("node_id").alias("node"),
        "meta_id",
        "datetime",
        "sensor",
        F.lit(feature).alias("feature"),
        F.struct(*[F.col(f"`{c}`") for c in properties]).alias("results"),
    )


def merge_features(
    by_feature: Mapping[str, DataFrame],
    limit: int | None = 1000,
    offset: int = 0,
    tie: Sequence[str] = ("feature", "node_id", "sensor"),
    **filters,
) -> DataFrame:
    """Observations of several features together, newest first; absent properties are null."""
    tagged = [select_observations(df, **filters).withColumn("feature", F.lit(name)) for name, df in by_feature.items()]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return newest(whole, "datetime", tie, limit, offset)


def numeric_properties(obs: DataFrame, wanted: Sequence[str] | None = None) -> list[str]:
    """Properties that can be aggregated; an empty choice is an error."""
    names = [
        f.name
        for f in obs.schema.fields
        if f.name not in META_COLUMNS
        and isinstance(f.dataType, T.NumericType)
        and (wanted is None or f.name.lower() in {w.lower() for w in wanted})
    ]
    if not names:
        raise ValueError("no property to aggregate: the filters contradict each other")
    return names


def _aggregated(kept: DataFrame, keys: Sequence[str], properties: Sequence[str], fn: str) -> DataFrame:
    columns = []
    for name in properties:
        column = F.col(f"`{name}`")
        columns += [AGGREGATES[fn](column).alias(name), F.count(column).alias(f"{name}_count")]
    return kept.groupBy(*keys).agg(*columns)


def node_aggregate(
    obs: DataFrame,
    unit: str,
    fn: str,
    start=None,
    end=None,
    node: str | None = None,
    sensors: Sequence[str] | None = None,
    properties: Sequence[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(node_id, time_bucket, property, property_count, ...) for one node or all of them.

    All functions but the median combine map side. The median keeps a group's values, so
    groups beyond `hot_rows` take the way of `_large_medians`.
    """
    if fn not in AGGREGATES:
        raise ValueError(f"unknown function {fn!r}, use one of {', '.join(AGGREGATES)}")
    names = numeric_properties(obs, properties)
    kept = select_observations(obs, start, end, sensors=sensors)
    if node is not None:
        kept = kept.filter(F.col("node_id") == node)
    kept = kept.select("node_id", bucket(F.col("datetime"), check_unit(unit)).alias("time_bucket"), *names)
    keys = ["node_id", "time_bucket"]
    if fn != "med":
        return _aggregated(kept, keys, names, fn)
    hot = hot_groups(kept, keys, hot_rows)
    if hot.isEmpty():
        return _aggregated(kept, keys, names, "med")
    hot = F.broadcast(hot.select(*keys))
    usual = _aggregated(kept.join(hot, keys, "left_anti"), keys, names, "med")
    crowded = kept.join(hot, keys)
    large = [_large_medians(crowded, keys, name) for name in names]
    counts = crowded.groupBy(*keys).agg(*[F.count(f"`{n}`").alias(f"{n}_count") for n in names])
    merged = reduce(lambda a, b: a.join(b, keys, "left"), large, counts)
    return usual.unionByName(merged.select(*usual.columns))


BINS = 4096


def _large_medians(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Exact medians of groups too large for one task, by counts alone.

    A bracket (low, high) around the middle of each group is cut into bins of equal width; the number of values per
    bin, with their least and greatest, combines map side and tells which bin holds the middle and where in it.
    Its least and greatest value are the next bracket. Values equal to an end of the bracket have a bin of their own, so
    every pass narrows it; it ends when both are the same. No group is ranked, sorted or gathered anywhere.
    NaN is greater than any number.
    """
    keys = list(keys)
    value = F.col(f"`{name}`").cast("double")
    known = df.select(*keys, value.alias("v")).filter(F.col("v").isNotNull())
    number = ~F.isnan("v")
    extent = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(number).alias("numbers"),
        F.min(F.when(number, F.col("v"))).alias("low"), F.max(F.when(number, F.col("v"))).alias("high"),
    )
    # The two middle values, the same one for an odd number; each has its place from 1 on in its bracket.
    middles = F.array(F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2))
    state = extent.select(*keys, "numbers", "low", "high", F.posexplode(middles).alias("which", "rank"))
    beyond = F.col("rank") > F.col("numbers")
    nan = F.lit(float("nan"))
    state = state.select(
        *keys, "which", "rank", F.when(beyond, nan).otherwise(F.col("low")).alias("low"), F.when(beyond, nan).otherwise(F.col("high")).alias("high")
    )
    state = settled(state, "medians")
    while not (open_ := state.filter("low < high")).isEmpty():
        state = settled(_narrowed(known.filter(number), open_, keys).unionByName(state.filter("NOT low < high")), "medians")
    return state.groupBy(*keys).agg(F.avg("low").alias(name))


def _narrowed(known: DataFrame, open_: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The brackets after one more count; there are two per crowded group, few enough to broadcast."""
    v, low, high = F.col("v"), F.col("low"), F.col("high")
    most = F.lit(sys.float_info.max)
    held = [F.greatest(F.least(c, most), -most) / 2 for c in (v, low, high)]
    share = (held[0] - held[1]) / (held[2] - held[1])
    inner = F.least(F.floor(share * (BINS - 2)), F.lit(BINS - 3)) + 1
    bin_ = F.when(v == low, 0).when(v == high, BINS - 1).otherwise(F.coalesce(inner, F.lit(1))).cast("int")
    inside = known.join(F.broadcast(open_), list(keys)).filter((v >= low) & (v <= high))
    bins = inside.groupBy(*keys, "which", "rank", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
    # At most BINS entries a group.
    rows = bins.groupBy(*keys, "which", "rank").agg(F.sort_array(F.collect_list(F.struct("bin", "c", "low", "high"))).alias("bins"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("struct<rank:long,low:double,high:double>").alias("found"))

    def step(at: Column, one: Column) -> Column:
        here = at["found"].isNull() & (at["seen"] + one["c"] >= F.col("rank"))
        found = F.struct((F.col("rank") - at["seen"]).alias("rank"), one["low"].alias("low"), one["high"].alias("high"))
        return F.struct((at["seen"] + one["c"]).alias("seen"), F.when(here, found).otherwise(at["found"]).alias("found"))

    picked = rows.select(*keys, "which", F.aggregate("bins", start, step)["found"].alias("found"))
    return picked.select(*keys, "which", "found.rank", "found.low", "found.high")


def fill_gaps(aggregates: DataFrame, unit: str, start, end) -> DataFrame:
    """Every bucket of [start, end) for every node: missing ones with null values and count 0.

    Nodes that never reported stay absent.
    """
    values = [c for c in aggregates.columns if c not in ("node_id", "time_bucket")]
    dense = dense_runs(aggregates, "node_id", unit, bucket(ts_lit(start), unit), ts_lit(end))

    def value(name: str) -> Column:
        if name.endswith("_count"):
            return F.when(F.col("_real"), F.col(f"`{name}`")).otherwise(F.lit(0)).cast("long").alias(name)
        return F.when(F.col("_real"), F.col(f"`{name}`")).alias(name)

    return dense.select("node_id", F.col("_bucket").alias("time_bucket"), *[value(c) for c in values])


def threshold_trigger(
    by_feature: Mapping[str, DataFrame], prop: str, op: str, value, since=None, until=None, nodes=None, limit: int | None = 50
) -> DataFrame:
    """Observations of several features whose property passes a comparison, newest first."""
    parts = [
        exceeding(df, prop, op, value, since, until, nodes).select(
            "node_id", "datetime", F.lit(f"{name}.{prop}").alias("property"), F.col(f"`{prop}`").alias("value")
        )
        for name, df in by_feature.items()
    ]
    whole = reduce(DataFrame.unionByName, parts)
    return newest(whole, "datetime", ("node_id", "property", "value"), limit)


def exceeding(obs: DataFrame, prop: str, op: str, value, since=None, until=None, nodes=None) -> DataFrame:
    """The stateless filter behind the trigger, for batches and streams alike."""
    kept = select_observations(obs, since, until, nodes)
    return kept.filter(condition(obs.schema, prop, op, value))
