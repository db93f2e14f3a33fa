"""Order of stored rows, so that filters on date and place read few of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A cell of the curve: some 100 metres and a day, which suits cities over years.
CELL_DEGREES = 0.001
CELL_DAYS = 1
BITS = 21
# Masks that leave room for two more bits between the bits of a number.
_SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def _cell(steps: Column) -> Column:
    """A whole number of `BITS` bits; nothing known is 0."""
    within = F.least(F.greatest(F.floor(steps), F.lit(0)), F.lit((1 << BITS) - 1))
    return F.coalesce(within, F.lit(0)).cast("long")


def _spread(cell: Column) -> Column:
    for shift, mask in _SPREAD:
        cell = cell.bitwiseOR(F.shiftleft(cell, shift)).bitwiseAND(F.lit(mask))
    return cell


def z_value(ts: Column, lon: Column, lat: Column) -> Column:
    """Place on a space-filling curve through date, longitude and latitude: their cells' bits in turn.

    Rows near each other on the curve are near in all three, so a run of them has a small range of each.
    """
    days = F.datediff(ts, F.lit("1900-01-01").cast("date")) / CELL_DAYS
    cells = [days, (lon + 180.0) / CELL_DEGREES, (lat + 90.0) / CELL_DEGREES]
    first, second, third = (_spread(_cell(c)) for c in cells)
    return first.bitwiseOR(F.shiftleft(second, 1)).bitwiseOR(F.shiftleft(third, 2))


def along_curve(points: DataFrame, ts: str = "point_date", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points laid out by ranges of the curve, sorted along it: a file holds a stretch of time and a patch of
    ground, and parquet's own ranges of values leave out the others. Spark sizes the ranges; a crowded cell may be cut anywhere."""
    z = z_value(F.col(ts), F.col(lon), F.col(lat))
    order = [F.col("_z"), F.col(ts), F.col(lon), F.col(lat)]
    return points.withColumn("_z", z).repartitionByRange(*order).sortWithinPartitions(*order).drop("_z")
