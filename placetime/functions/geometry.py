"""Geometry as plain column expressions.

A geometry column is a struct holding its parts (a polygon is a list of rings, a line a list
with one polyline), its box and its edges; the edges are derived once at ingest so that point
tests only walk them. Geometry
*arguments* (one polygon in a query) are Python values turned into literals.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS_TYPE = "array<array<array<struct<x:double,y:double>>>>"
EDGE_TYPE = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
AREA_KINDS = ("Polygon", "MultiPolygon")
LINE_KINDS = ("LineString", "MultiLineString")

# Mean circumference of the earth in metres, default line buffer in metres.
EARTH_CIRCUMFERENCE_M = 40_041_000.0
LINE_BUFFER_M = 100.0

# Up to this many edges a literal geometry becomes one generated expression; beyond it the edges
# travel as a literal array walked by a higher-order function. Measured: longer expressions make
# generated methods that the JVM no longer compiles, which costs more than the function.
UNROLL_EDGES = 4


@dataclass(frozen=True)
class Geometry:
    """A geometry argument: kind, rings or polylines as (x, y) tuples, buffer in degrees."""

    kind: str
    rings: tuple[tuple[tuple[float, float], ...], ...]
    buffer: float = 0.0

    @property
    def box(self) -> tuple[float, float, float, float]:
        xs = [x for ring in self.rings for x, _ in ring]
        ys = [y for ring in self.rings for _, y in ring]
        b = self.buffer
        return min(xs) - b, min(ys) - b, max(xs) + b, max(ys) + b

    @property
    def edges(self) -> list[tuple[float, float, float, float]]:
        return [(*a, *b) for ring in self.rings for a, b in zip(ring, ring[1:])]

    @property
    def is_area(self) -> bool:
        return self.kind in AREA_KINDS

    @property
    def is_rectangle(self) -> bool:
        """One ring that runs around its own box."""
        if self.kind not in AREA_KINDS or len(self.rings) != 1:
            return False
        ring, (x0, y0, x1, y1) = self.rings[0], self.box
        return (
            len(ring) == 5
            and set(ring) == {(x0, y0), (x0, y1), (x1, y0), (x1, y1)}
            and all(a[0] == b[0] or a[1] == b[1] for a, b in zip(ring, ring[1:]))
        )


def geometry(document: str | dict | Geometry, buffer_m: float = LINE_BUFFER_M) -> Geometry:
    """Read GeoJSON: a feature collection (its first feature), a feature or a bare geometry.

    Lines are widened by `buffer_m` metres, as an area argument is expected.
    """
    if isinstance(document, Geometry):
        return document
    value = json.loads(document) if isinstance(document, str) else document
    if "features" in value:
        value = value["features"][0]
    if "geometry" in value:
        value = value["geometry"]
    kind, coordinates = value["type"], value["coordinates"]
    nesting = {"LineString": 0, "Polygon": 1, "MultiLineString": 1, "MultiPolygon": 2}
    if kind not in nesting:
        raise ValueError(f"unsupported geometry type: {kind}")
    if nesting[kind] == 0:
        coordinates = [coordinates]
    elif nesting[kind] == 2:
        coordinates = [ring for polygon in coordinates for ring in polygon]
    rings = tuple(tuple((float(p[0]), float(p[1])) for p in ring) for ring in coordinates)
    buffer = metres_to_degrees(buffer_m, 0.0)[1] if kind in LINE_KINDS else 0.0
    return Geometry(kind, rings, buffer)


def metres_to_degrees(metres: float, latitude: float) -> tuple[float, float]:
    """East-west and north-south extent in degrees of a length at a latitude."""
    north = metres * (360.0 / EARTH_CIRCUMFERENCE_M)
    return north * (1.0 / math.cos(latitude * (math.pi / 180.0))), north


def degrees_east(metres: float, latitude: Column) -> Column:
    return F.lit(metres * (360.0 / EARTH_CIRCUMFERENCE_M)) * (1.0 / F.cos(latitude * (math.pi / 180.0)))


def degrees_north(metres: float) -> Column:
    return F.lit(metres * (360.0 / EARTH_CIRCUMFERENCE_M))


def snap(value: Column, size: Column) -> Column:
    """Nearest lattice line (half to even); a size of zero leaves the value alone."""
    return F.when(size > 0, F.rint(value / size) * size).otherwise(value)


# -- tests of a point against one literal geometry ---------------------------------------


def _all_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def _balanced(parts: Sequence[Column], join) -> Column:
    """Fold pairwise, so that a long list gives a shallow expression tree."""
    parts = list(parts)
    while len(parts) > 1:
        parts = [join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def in_box(x: Column, y: Column, box: tuple[float, float, float, float], strict: bool = False) -> Column:
    x0, y0, x1, y1 = (F.lit(float(v)) for v in box)
    if strict:
        return _all_of([x > x0, x < x1, y > y0, y < y1])
    return _all_of([x >= x0, x <= x1, y >= y0, y <= y1])


def _crosses(x, y, x1, y1, x2, y2) -> Column:
    """Does the ray from (x, y) towards larger x cross the edge?"""
    return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)


def _touches(x, y, x1, y1, x2, y2) -> Column:
    """Is the point on the edge? On its line, and not outside it on either axis."""
    on_line = (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1)
    return on_line & ((x - x1) * (x - x2) <= 0) & ((y - y1) * (y - y2) <= 0)


def edge_array(edges: Sequence[tuple[float, float, float, float]]) -> Column:
    """The edges as one literal array; parsed once while the plan is optimised."""
    rows = [dict(zip(("x1", "y1", "x2", "y2"), edge)) for edge in edges]
    return F.from_json(F.lit(json.dumps(rows)), EDGE_TYPE)


def _fields(edge: Column) -> tuple[Column, ...]:
    return edge["x1"], edge["y1"], edge["x2"], edge["y2"]


def _near_edge(x, y, edge, distance: float) -> Column:
    """Is the point at most `distance` away from the segment?"""
    x1, y1, x2, y2 = edge
    dx, dy = x2 - x1, y2 - y1
    length2, reach2 = dx * dx + dy * dy, distance * distance
    along = (x - x1) * dx + (y - y1) * dy
    across = (x - x1) * dy - (y - y1) * dx

    def near(px, py) -> Column:
        return (x - px) * (x - px) + (y - py) * (y - py) <= reach2

    return F.when(along <= 0, near(x1, y1)).when(along >= length2, near(x2, y2)).otherwise(across * across <= reach2 * length2)


def point_in(x: Column, y: Column, shape: str | dict | Geometry, boundary: bool = False) -> Column:
    """Is (x, y) inside the literal geometry? `boundary` decides about points on its border.

    The box test comes first: on plain columns it reaches the parquet scan. Parity over all
    rings treats holes and multi-part areas alike.
    """
    shape = geometry(shape)
    if shape.is_rectangle:
        return in_box(x, y, shape.box, strict=not boundary)
    box = in_box(x, y, shape.box)
    if shape.is_area:
        return box & _area_test(x, y, shape.edges, boundary)
    edges = shape.edges
    if len(edges) <= UNROLL_EDGES:
        return box & _balanced([_near_edge(x, y, e, shape.buffer) for e in edges], lambda a, b: a | b)
    return box & F.exists(edge_array(edges), lambda e: _near_edge(x, y, _fields(e), shape.buffer))


def _area_test(x: Column, y: Column, edges, boundary: bool) -> Column:
    if len(edges) > UNROLL_EDGES:
        return point_in_edges(x, y, edge_array(edges), boundary)
    literal = [(tuple(F.lit(v) for v in edge), edge) for edge in edges]
    crossing = [_crosses(x, y, *cols).cast("int") for cols, (_, y1, _, y2) in literal if y1 != y2]
    odd = _balanced(crossing, lambda a, b: a + b) % 2 == 1
    touching = _balanced([_touches(x, y, *cols) for cols, _ in literal], lambda a, b: a | b)
    return (odd | touching) if boundary else (odd & ~touching)


def point_in_edges(x: Column, y: Column, edges: Column, boundary: bool, flip: Column | None = None) -> Column:
    """The same test against a column of edges; `flip` says if an odd number was left out of it."""
    touching = F.exists(edges, lambda e: _touches(x, y, *_fields(e)))
    odd = F.size(F.filter(edges, lambda e: _crosses(x, y, *_fields(e)))) % 2 == 1
    odd = odd if flip is None else odd != flip
    return (odd | touching) if boundary else (odd & ~touching)


def point_in_columns(x: Column, y: Column, edges: Sequence[tuple[Column, ...]], boundary: bool, flip: Column) -> Column:
    """The same test against a few edges in columns of their own, null where there is none.

    Unlike an array it needs no higher-order function, so it is part of the generated code.
    """
    none = F.lit(False)
    odd = reduce(lambda a, b: a != b, [F.coalesce(_crosses(x, y, *e), none) for e in edges], flip)
    touching = reduce(lambda a, b: a | b, [F.coalesce(_touches(x, y, *e), none) for e in edges])
    return (odd | touching) if boundary else (odd & ~touching)


# -- geometry columns ---------------------------------------------------------------------


def edges_of(rings: Column) -> Column:
    """Consecutive vertex pairs of every ring or polyline."""

    def pairs(ring: Column) -> Column:
        return F.zip_with(
            F.slice(ring, F.lit(1), F.size(ring) - 1),
            F.slice(ring, F.lit(2), F.size(ring) - 1),
            lambda a, b: F.struct(
                a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
            ),
        )

    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 1), pairs))


def rings_of(geom: Column) -> Column:
    return F.flatten(geom["parts"])


def geometry_struct(kind: Column, parts: Column) -> Column:
    """Kind, parts, box and edges in one struct; null where there are no points."""
    rings = F.flatten(parts)
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    value = F.struct(
        kind.alias("kind"),
        parts.alias("parts"),
        F.array_min(xs).alias("xmin"),
        F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"),
        F.array_max(ys).alias("ymax"),
        edges_of(rings).alias("edges"),
    )
    return F.when(F.size(points) > 0, value)


def boxes_overlap(geom: Column, box: tuple[float, float, float, float]) -> Column:
    x0, y0, x1, y1 = box
    return (geom["xmin"] <= x1) & (geom["xmax"] >= x0) & (geom["ymin"] <= y1) & (geom["ymax"] >= y0)


def _turn(ax, ay, bx, by, px, py) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def _segments_meet(e, f) -> Column:
    """Do two closed segments share a point? Boxes overlap and each straddles the other."""
    ex1, ey1, ex2, ey2 = e
    fx1, fy1, fx2, fy2 = f
    boxes = (
        (F.least(ex1, ex2) <= F.greatest(fx1, fx2))
        & (F.greatest(ex1, ex2) >= F.least(fx1, fx2))
        & (F.least(ey1, ey2) <= F.greatest(fy1, fy2))
        & (F.greatest(ey1, ey2) >= F.least(fy1, fy2))
    )
    side_e = F.signum(_turn(fx1, fy1, fx2, fy2, ex1, ey1)) * F.signum(_turn(fx1, fy1, fx2, fy2, ex2, ey2))
    side_f = F.signum(_turn(ex1, ey1, ex2, ey2, fx1, fy1)) * F.signum(_turn(ex1, ey1, ex2, ey2, fx2, fy2))
    return boxes & (side_e <= 0) & (side_f <= 0)


def _segments_near(e, f, distance: float) -> Column:
    """Are two segments at most `distance` apart? They meet, or an end of one is that near to the other."""
    ends = [_near_edge(x, y, other, distance) for one, other in ((e, f), (f, e)) for x, y in (one[:2], one[2:])]
    return reduce(lambda a, b: a | b, ends, _segments_meet(e, f))


#: Sides of a literal geometry that one lattice cell should hold about.
SIDES_PER_CELL = 4
MOST_CELLS = 64


def edge_lattice(edges: Sequence[tuple], box: tuple[float, float, float, float]) -> tuple[int, list[list[dict]]]:
    """(cells along a side, sides in each cell row by row) of a lattice over the box; a side lies in every cell
    that its own box touches. A few sides get a single cell."""
    side = max(1, min(MOST_CELLS, len(edges) // SIDES_PER_CELL))
    if side == 1:
        return 1, []
    cells: list[list[dict]] = [[] for _ in range(side * side)]
    for x1, y1, x2, y2 in edges:
        columns, rows = ((_cell_of(min(a, b), lo, hi, side), _cell_of(max(a, b), lo, hi, side)) for a, b, lo, hi in ((x1, x2, box[0], box[2]), (y1, y2, box[1], box[3])))
        for row in range(rows[0], rows[1] + 1):
            for column in range(columns[0], columns[1] + 1):
                cells[row * side + column].append({"x1": x1, "y1": y1, "x2": x2, "y2": y2})
    return side, cells


def _cell_of(value: float, low: float, high: float, side: int) -> int:
    """The cell of a value along one axis; values beyond the box count to the cell at its border."""
    step = (high - low) / side
    return min(side - 1, max(0, math.floor((value - low) / step))) if step > 0 else 0


def _meets_in_cells(e: Column, cells: Column, side: int, box, buffer: float, meet) -> Column:
    """Does a side meet one of the lattice, among those of the cells it touches itself?"""

    def span(a: Column, b: Column, low: float, high: float) -> tuple[Column, Column, Column]:
        step = (high - low) / side
        first, last = F.least(a, b) - buffer, F.greatest(a, b) + buffer

        def cell(value: Column) -> Column:
            return F.least(F.greatest(F.floor((value - low) / step), F.lit(0)), F.lit(side - 1)) if step > 0 else F.lit(0).cast("long")

        return cell(first), cell(last), (first <= high) & (last >= low)

    x1, y1, x2, y2 = _fields(e)
    left, right, across = span(x1, x2, box[0], box[2])
    bottom, top, along = span(y1, y2, box[1], box[3])
    found = F.exists(
        F.sequence(bottom, top),
        lambda row: F.exists(F.sequence(left, right), lambda column: F.exists(F.get(cells, (row * side + column).cast("int")), lambda f: meet(e, f))),
    )
    return across & along & found


def geometries_intersect(geom: Column, shape: str | dict | Geometry) -> Column:
    """Does a geometry column meet a literal geometry? A line reaches as far as its buffer.

    They meet if their borders do, or if a part of one lies inside the other; one vertex per
    ring decides the latter, because without a border crossing a ring is all in or all out.
    """
    shape = geometry(shape)
    own, other = geom["edges"], edge_array(shape.edges)

    def meet(e: Column, f: Column) -> Column:
        e, f = _fields(e), _fields(f)
        return _segments_near(e, f, shape.buffer) if shape.buffer else _segments_meet(e, f)

    side, held = edge_lattice(shape.edges, shape.box)
    if side == 1:
        borders = F.exists(own, lambda e: F.exists(other, lambda f: meet(e, f)))
    else:
        cells = F.from_json(F.lit(json.dumps(held)), f"array<{EDGE_TYPE}>")
        borders = F.exists(own, lambda e: _meets_in_cells(e, cells, side, shape.box, shape.buffer, meet))
    tests = [borders]
    if shape.is_area:
        tests.append(
            F.exists(
                rings_of(geom),
                lambda ring: point_in_edges(ring[0]["x"], ring[0]["y"], other, True),
            )
        )
    inside_own = reduce(
        lambda a, b: a | b,
        [point_in_edges(F.lit(r[0][0]), F.lit(r[0][1]), own, True) for r in shape.rings],
    )
    tests.append(geom["kind"].isin(*AREA_KINDS) & inside_own)
    return boxes_overlap(geom, shape.box) & reduce(lambda a, b: a | b, tests)


# -- GeoJSON out --------------------------------------------------------------------------


def point_geojson(x: Column, y: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))


def box_polygon(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """A box as a GeoJSON polygon: closed, anticlockwise from its lower right corner."""
    corners = [(xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin), (xmax, ymin)]
    ring = F.array(*[F.array(x, y) for x, y in corners])
    return F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))


def rings_coordinates(rings: Column) -> Column:
    return F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
