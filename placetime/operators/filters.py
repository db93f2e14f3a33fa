"""Condition trees and flat arguments compiled to one column expression.

A tree is `{"op": "and" | "or", "val": [tree, ...]}` or `{"op": <comparison>, "col": name,
"val": value}`. Everything is checked against the schema before a plan is built, and
literals get the type of their column, so comparisons reach the parquet scan.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import date, datetime
from functools import reduce
from operator import and_, or_

from dateutil import parser as date_parser
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placetime.functions.geometry import point_in

# The operator names a condition may use.
COMPARISONS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v,
}
PATTERNS = {
    "like": lambda c, v: c.like(v),
    "ilike": lambda c, v: c.ilike(v),
    "notlike": lambda c, v: ~c.like(v),
    "notilike": lambda c, v: ~c.ilike(v),
    "startswith": lambda c, v: c.startswith(v),
    "endswith": lambda c, v: c.endswith(v),
    "contains": lambda c, v: c.contains(v),
}
IDENTITY = ("is", "isnot")
MEMBERSHIP = ("in", "notin")
OPERATORS = (*COMPARISONS, *PATTERNS, *IDENTITY, *MEMBERSHIP)

# Arguments that shape a request rather than filter a column.
CONTROL_ARGUMENTS = frozenset(
    "agg buffer data_type dataset dataset_name dataset_name__in geom job limit location_geom__within"
    " offset order_by resolution shape shapeset".split()
)


def literal(value, data_type: T.DataType) -> Column:
    """A literal of the column's type; raises ValueError if the value does not fit it."""
    if value is None:
        return F.lit(None).cast(data_type)
    try:
        if isinstance(data_type, T.BooleanType):
            text = str(value).strip().lower()
            if text not in ("true", "t", "yes", "y", "1", "false", "f", "no", "n", "0"):
                raise ValueError(text)
            return F.lit(text in ("true", "t", "yes", "y", "1"))
        if isinstance(data_type, (T.IntegralType,)):
            return F.lit(int(str(value).strip())).cast(data_type)
        if isinstance(data_type, (T.FractionalType,)):
            return F.lit(float(value)).cast(data_type)
        if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            parsed = value if isinstance(value, (date, datetime)) else date_parser.parse(str(value))
            return F.lit(parsed.isoformat(sep=" ") if isinstance(parsed, datetime) else str(parsed)).cast(data_type)
        if isinstance(data_type, T.StringType):
            return F.lit(str(value))
    except (ValueError, OverflowError) as error:
        raise ValueError(f"{value!r} is not a {data_type.simpleString()}") from error
    raise ValueError(f"cannot compare values of type {data_type.simpleString()}")


def condition(schema: T.StructType, name: str, op: str, value) -> Column:
    """One comparison."""
    if name not in schema.names:
        raise ValueError(f"unknown column {name!r}")
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op!r}")
    column, data_type = F.col(f"`{name}`"), schema[name].dataType
    if op in IDENTITY:
        missing = value is None or str(value).lower() in ("null", "none", "")
        same = column.isNull() if missing else column.eqNullSafe(literal(value, data_type))
        return same if op == "is" else ~same
    if op in MEMBERSHIP:
        values = value.split(",") if isinstance(value, str) else list(value)
        member = column.isin([literal(v, data_type) for v in values])
        return member if op == "in" else ~member
    if op in PATTERNS:
        if not isinstance(data_type, T.StringType):
            raise ValueError(f"{op} needs a text column, {name!r} is {data_type.simpleString()}")
        return PATTERNS[op](column, str(value))
    return COMPARISONS[op](column, literal(value, data_type))


def compile_tree(schema: T.StructType, tree: Mapping | str) -> Column:
    """A nested condition tree as one boolean column."""
    tree = json.loads(tree) if isinstance(tree, str) else tree
    if not isinstance(tree, Mapping) or "op" not in tree or "val" not in tree:
        raise ValueError("a condition needs the keys op and val")
    op = str(tree["op"])
    if op in ("and", "or"):
        children = tree["val"]
        if not isinstance(children, (list, tuple)) or not children:
            raise ValueError(f"{op!r} needs a list of conditions")
        return reduce(and_ if op == "and" else or_, [compile_tree(schema, child) for child in children])
    if "col" not in tree:
        raise ValueError("a comparison needs the key col")
    return condition(schema, str(tree["col"]), op, tree["val"])


def time_of_day(ts: Column, first_hour: int = 0, last_hour: int = 23) -> Column:
    """Hour of day between two hours, both included."""
    for hour in (first_hour, last_hour):
        if not 0 <= hour <= 23:
            raise ValueError(f"hour out of range: {hour}")
    return F.hour(ts).between(first_hour, last_hour)


def compile_arguments(
    schema: T.StructType,
    arguments: Mapping[str, object],
    date_column: str = "point_date",
    strict: bool = False,
    null_word: str | None = None,
    lon: str = "lon",
    lat: str = "lat",
) -> tuple[Column, list[str]]:
    """Flat `column` / `column__operator` arguments joined with AND.

    `obs_date` stands for the date column; `<date>__time_of_day_ge` and `_le` bound the hour;
    `location__within` takes GeoJSON. Unknown columns and values that don't fit give warnings, or an
    error if `strict`.
    `null_word` is the text that stands for a missing value.
    """
    parts: list[Column] = []
    warnings: list[str] = []
    for key, value in arguments.items():
        if key in CONTROL_ARGUMENTS:
            continue
        name, _, op = key.partition("__")
        op = op or "eq"
        if name in ("obs_date", "date") and name not in schema.names:
            name = date_column
        if op.startswith("time_of_day") and name in schema.names:
            bounds = (0, int(value)) if op.endswith("le") else (int(value), 23)
            parts.append(time_of_day(F.col(f"`{name}`"), *bounds))
        elif op == "within" and {lon, lat} <= set(schema.names):
            parts.append(point_in(F.col(lon), F.col(lat), value))
        elif name not in schema.names:
            if strict:
                raise ValueError(f"unknown column {name!r}")
            warnings.append(f"unused argument {key!r}: no such column")
        else:
            value = None if null_word is not None and value == null_word else value
            if value is None and op in ("eq", "ne"):
                op = "is" if op == "eq" else "isnot"
            try:
                parts.append(condition(schema, name, op, value))
            except (ValueError, TypeError) as error:
                if strict:
                    raise
                warnings.append(f"unused argument {key!r}: {error}")
    return (reduce(and_, parts) if parts else F.lit(True)), warnings
