"""Geometry as expressions over ``array<struct<x:double,y:double>>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"


def let(value: Column, body) -> Column:
    """Bind a value once, so that an expression used many times is not repeated."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pin(df: DataFrame, **values: Column) -> DataFrame:
    """Add columns that are computed once per row.

    A plain projection may be merged into every later use; a generated row is
    not, which matters for array expressions used many times."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def path(*xy: tuple[Column, Column]) -> Column:
    return F.array(*[point(x, y) for x, y in xy])


def _next(points: Column) -> Column:
    """The same ring turned by one vertex, so that zip_with walks its edges."""
    return F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def signed_area(ring: Column) -> Column:
    """Shoelace about the first vertex, which keeps large map coordinates exact."""
    origin = F.element_at(ring, 1)
    ox, oy = origin["x"], origin["y"]
    cross = F.zip_with(
        ring, _next(ring),
        lambda a, b: (a["x"] - ox) * (b["y"] - oy) - (b["x"] - ox) * (a["y"] - oy),
    )
    return _sum(cross) / 2.0


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def ring_perimeter(ring: Column) -> Column:
    return _sum(F.zip_with(ring, _next(ring), lambda a, b: distance(a["x"], a["y"], b["x"], b["y"])))


def line_length(line: Column) -> Column:
    heads = F.slice(line, 1, F.size(line) - 1)
    tails = F.slice(line, 2, F.size(line))
    return _sum(F.zip_with(heads, tails, lambda a, b: distance(a["x"], a["y"], b["x"], b["y"])))


def endpoints(line: Column) -> Column:
    return F.array(F.element_at(line, 1), F.element_at(line, -1))


def thinness(area: Column, perimeter: Column) -> Column:
    """4*pi*A/P^2: 1 for a circle, 0 for a ring without length."""
    ratio = 4.0 * F.pi() * area / (perimeter * perimeter)
    return F.when(perimeter <= 0, F.lit(0.0)).otherwise(ratio)


def _crosses(a: Column, b: Column, px: Column, py: Column) -> Column:
    straddles = (a["y"] > py) != (b["y"] > py)
    at = (b["x"] - a["x"]) * (py - a["y"]) / (b["y"] - a["y"]) + a["x"]
    return F.when(straddles, (px < at).cast("int")).otherwise(F.lit(0))


def point_in_rings(px: Column, py: Column, rings: Column) -> Column:
    """Even-odd rule over all rings together, so holes flip back to outside."""
    hits = F.transform(
        rings,
        lambda ring: F.aggregate(
            F.zip_with(ring, _next(ring), lambda a, b: _crosses(a, b, px, py)),
            F.lit(0), lambda acc, v: acc + v,
        ),
    )
    return F.aggregate(hits, F.lit(0), lambda acc, v: acc + v) % 2 == 1


def vertical_crossings(x: Column, rings: Column) -> Column:
    """Sorted y of every edge that crosses the line X = x; pairs are inside."""
    def of_ring(ring: Column) -> Column:
        ys = F.zip_with(
            ring, _next(ring),
            lambda a, b: F.when(
                (a["x"] > x) != (b["x"] > x),
                (b["y"] - a["y"]) * (x - a["x"]) / (b["x"] - a["x"]) + a["y"],
            ),
        )
        return F.filter(ys, lambda y: y.isNotNull())
    return F.array_sort(F.flatten(F.transform(rings, of_ring)))


def dist_point_segment(
    px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column
) -> Column:
    """Distance to the nearest point of a segment; a point-like segment is its end."""
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, ((px - ax) * dx + (py - ay) * dy) / len2).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return distance(px, py, ax + t * dx, ay + t * dy)


def _clip_side(ring: Column, axis: str, bound: Column, keep_below: bool) -> Column:
    """Cut a ring by one axis-parallel half plane."""
    other = "y" if axis == "x" else "x"

    def inside(p: Column) -> Column:
        return p[axis] <= bound if keep_below else p[axis] >= bound

    def cut(a: Column, b: Column) -> Column:
        t = (bound - a[axis]) / (b[axis] - a[axis])
        across = a[other] + t * (b[other] - a[other])
        return point(bound, across) if axis == "x" else point(across, bound)

    def edge(a: Column, b: Column) -> Column:
        return (
            F.when(inside(a) & inside(b), F.array(point(b["x"], b["y"])))
            .when(inside(a), F.array(cut(a, b)))
            .when(inside(b), F.array(cut(a, b), point(b["x"], b["y"])))
            .otherwise(F.array().cast(POINTS))
        )
    return let(ring, lambda r: F.flatten(F.zip_with(r, _next(r), edge)))


def clip_to_box(ring: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Ring cut to a box, one half plane after the other; empty if they do not meet.

    A concave ring may come back with bridge edges along the box, which cancel
    in the area.
    """
    for axis, bound, below in (("x", xmin, False), ("x", xmax, True), ("y", ymin, False), ("y", ymax, True)):
        ring = _clip_side(ring, axis, bound, below)
    return ring


def rotate_x(x: Column, y: Column, px: Column, py: Column, degrees: Column) -> Column:
    rad = degrees * F.pi() / 180.0
    return px + (x - px) * F.cos(rad) - (y - py) * F.sin(rad)


def rotate_y(x: Column, y: Column, px: Column, py: Column, degrees: Column) -> Column:
    rad = degrees * F.pi() / 180.0
    return py + (x - px) * F.sin(rad) + (y - py) * F.cos(rad)


def rotate_ring(ring: Column, px: Column, py: Column, degrees: Column) -> Column:
    return F.transform(
        ring,
        lambda p: F.struct(
            rotate_x(p["x"], p["y"], px, py, degrees).alias("x"),
            rotate_y(p["x"], p["y"], px, py, degrees).alias("y"),
        ),
    )


def low(ring: Column, axis: str) -> Column:
    return F.array_min(F.transform(ring, lambda p: p[axis]))


def high(ring: Column, axis: str) -> Column:
    return F.array_max(F.transform(ring, lambda p: p[axis]))


def round_mm(v: Column) -> Column:
    """End-point key in millimetres, half to even."""
    return F.bround(v, 3)
