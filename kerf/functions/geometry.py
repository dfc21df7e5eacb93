"""Geometry as Column expressions: boxes, transforms, orientations, tools, shapes.

Angles are degrees, lengths millimetres. A point or vector is a tuple of three columns.
The default tool axis points down; A turns about x, B about y, C about z, and since C
comes first it never moves the axis.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column, Column]


def point(prefix: str = "", names: str = "xyz") -> Point:
    return tuple(F.col(f"{prefix}{n}") for n in names)


def const(x: float, y: float, z: float) -> Point:
    return F.lit(float(x)), F.lit(float(y)), F.lit(float(z))


def add(a: Point, b: Point) -> Point:
    return tuple(p + q for p, q in zip(a, b))


def subtract(a: Point, b: Point) -> Point:
    return tuple(p - q for p, q in zip(a, b))


def scale(a: Point, k: Column | float) -> Point:
    return tuple(p * k for p in a)


def dot(a: Point, b: Point) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Point, b: Point) -> Point:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(a: Point) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Point, b: Point) -> Column:
    return length(subtract(a, b))


def normalized(a: Point, otherwise: Point | None = None, least: float = 0.0) -> Point:
    """``a`` at unit length; ``otherwise`` where it is shorter than ``least`` or zero."""
    n = length(a)
    usable = n > least
    other = otherwise or (F.lit(None), F.lit(None), F.lit(None))
    return tuple(F.when(usable, F.try_divide(p, n)).otherwise(o) for p, o in zip(a, other))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


# Boxes


def box_size(lo: Point, hi: Point) -> Point:
    return subtract(hi, lo)


def box_centre(lo: Point, hi: Point) -> Point:
    return tuple((a + b) / 2 for a, b in zip(lo, hi))


def box_from_centre(centre: Point, size: Point) -> tuple[Point, Point]:
    """Corners of a box; a negative size is an error when the query runs."""
    ok = [F.when(s >= 0, s).otherwise(F.raise_error(F.lit("sizes can't be negative")).cast("double")) for s in size]
    return tuple(c - s / 2 for c, s in zip(centre, ok)), tuple(c + s / 2 for c, s in zip(centre, ok))


def box_contains(lo: Point, hi: Point, p: Point) -> Column:
    """Whether the closed box holds the point."""
    return p[0].between(lo[0], hi[0]) & p[1].between(lo[1], hi[1]) & p[2].between(lo[2], hi[2])


def box_moved(lo: Point, hi: Point, by: Point) -> tuple[Point, Point]:
    """The box moved by an offset."""
    return add(lo, by), add(hi, by)


def box_expanded(lo: Point, hi: Point, p: Point) -> tuple[Point, Point]:
    return tuple(F.least(a, c) for a, c in zip(lo, p)), tuple(F.greatest(b, c) for b, c in zip(hi, p))


def bounds(p: Point) -> list[Column]:
    """Aggregates that give the smallest box around all points."""
    names = ("x", "y", "z")
    return [f(c).alias(f"{label}_{n}") for label, f in (("min", F.min), ("max", F.max)) for c, n in zip(p, names)]


def box_text(lo: Point, hi: Point) -> Column:
    return F.format_string("[<%.3f, %.3f, %.3f>, <%.3f, %.3f, %.3f>]", *lo, *hi)


# Work and machine coordinates


def machine_to_work(p: Point, origin: Point) -> Point:
    return subtract(p, origin)


def work_to_machine(p: Point, origin: Point) -> Point:
    return add(p, origin)


# Orientation


def tool_direction(a: Column, b: Column) -> Point:
    """Unit vector from spindle to tip."""
    a, b = F.radians(a), F.radians(b)
    return -F.sin(b), F.cos(b) * F.sin(a), -F.cos(b) * F.cos(a)


def rotation(a: Column, b: Column, c: Column) -> tuple[Point, Point, Point]:
    """Rows of the rotation for row vectors: first about z, then y, then x."""
    a, b, c = F.radians(a), F.radians(b), F.radians(c)
    ca, sa, cb, sb, cc, sc = F.cos(a), F.sin(a), F.cos(b), F.sin(b), F.cos(c), F.sin(c)
    return (
        (cc * cb, sc * ca + cc * sb * sa, sc * sa - cc * sb * ca),
        (-sc * cb, cc * ca - sc * sb * sa, cc * sa + sc * sb * ca),
        (sb, -cb * sa, cb * ca),
    )


def rotated(p: Point, rows: tuple[Point, Point, Point]) -> Point:
    return tuple(p[0] * rows[0][k] + p[1] * rows[1][k] + p[2] * rows[2][k] for k in range(3))


def transformed(p: Point, a: Column, b: Column, c: Column, origin: Point) -> Point:
    """``p`` turned about ``origin``."""
    return add(rotated(subtract(p, origin), rotation(a, b, c)), origin)


def pose(position: Point, a: Column, b: Column, c: Column) -> Column:
    """The 4 x 4 matrix that turns and then moves row vectors, as an array of rows."""
    rows = [F.array(*(x.cast("double") for x in r), F.lit(0.0)) for r in rotation(a, b, c)]
    return F.array(*rows, F.array(*(x.cast("double") for x in position), F.lit(1.0)))


def spindle_position(tip: Point, a: Column, b: Column, tool_length: Column) -> Point:
    return subtract(tip, scale(tool_direction(a, b), tool_length))


def interpolated(start: Point, end: Point, t: Column) -> Point:
    """Angles in between, each by itself; ``t`` is held to 0 to 1."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return tuple(lerp(a, b, t) for a, b in zip(start, end))


def is_default_orientation(a: Column, b: Column, c: Column) -> Column:
    return (a == 0) & (b == 0) & (c == 0)


def orientation_text(a: Column, b: Column, c: Column) -> Column:
    return F.format_string("A=%.3f B=%.3f C=%.3f", a.cast("double"), b.cast("double"), c.cast("double"))


def angles_of(direction: Point) -> tuple[Column, Column]:
    """(A, B) whose tool direction is the unit vector ``direction``; exact everywhere."""
    x, y, z = direction
    return F.degrees(F.atan2(y, -z)), F.degrees(F.asin(-x))


# Tools


def tool_radius(height: Column, diameter: Column, tool_length: Column, is_ball: Column) -> Column:
    """Radius at a height above the tip: 0 beyond the tool, rounded at a ball's end."""
    r = diameter / 2
    ball = F.sqrt(r * r - (r - height) * (r - height))
    return F.when((height < 0) | (height > tool_length), F.lit(0.0)).when(is_ball & (height < r), ball).otherwise(r)


def valid_tool(diameter: Column, tool_length: Column) -> Column:
    """True; an error when the query runs where a size isn't positive."""
    ok = (diameter > 0) & (tool_length > 0)
    return F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("a tool needs a positive diameter and length")).cast("boolean"))


# Shapes: whether, and how far, a point is from them

#: Ends of a cylinder's axis reach this much further.
END_TOLERANCE = 1e-5
#: A shorter axis is a point.
SHORTEST_AXIS = 1e-6


def in_sphere(p: Point, centre: Point, r: Column) -> Column:
    d = subtract(p, centre)
    return dot(d, d) <= r * r


def along(p: Point, a: Point, b: Point) -> tuple[Column, Column]:
    """How far along the axis the point lies, and the axis' length."""
    axis = subtract(b, a)
    n = length(axis)
    return F.try_divide(dot(subtract(p, a), axis), n), n


def in_cylinder(p: Point, a: Point, b: Point, r: Column, rounded: Column) -> Column:
    """Within a cylinder with flat ends, or, where ``rounded``, a capsule."""
    t, n = along(p, a, b)
    foot = add(a, scale(subtract(b, a), F.try_divide(t, n)))
    d = subtract(p, foot)
    beside = (t >= -END_TOLERANCE) & (t <= n + END_TOLERANCE)
    return F.when(n < SHORTEST_AXIS, in_sphere(p, a, r)).when(beside, dot(d, d) <= r * r).otherwise(rounded & (in_sphere(p, a, r) | in_sphere(p, b, r)))


def capsule_distance(p: Point, a: Point, b: Point, r: Column) -> Column:
    """Signed distance from a capsule's surface, negative within."""
    t, n = along(p, a, b)
    t = F.greatest(F.lit(0.0), F.least(n, t))
    return distance(p, add(a, scale(subtract(b, a), F.try_divide(t, n)))) - r


def sphere_distance(p: Point, centre: Point, r: Column) -> Column:
    return distance(p, centre) - r


def is_valid_normal(n: Point) -> Column:
    return ~(F.isnan(n[0]) | F.isnan(n[1]) | F.isnan(n[2])) & (dot(n, n) > 1e-8)


def zero_crossing(a: Point, b: Point, va: Column, vb: Column) -> Point:
    """Where a value that is ``va`` at a and ``vb`` at b is zero; a where both are alike."""
    t = F.try_divide(va, va - vb)
    return tuple(F.when(F.abs(va - vb) < 1e-8, p).otherwise(p + (q - p) * t) for p, q in zip(a, b))


def morton(x: Column, y: Column, z: Column, bits: int) -> Column:
    """Path through an octree: three bits a level, x lowest, the coarsest level first."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        bit = lambda c: F.shiftright(c.cast("long"), k).bitwiseAND(F.lit(1).cast("long"))  # noqa: E731, B023
        level = bit(x) + F.shiftleft(bit(y), 1) + F.shiftleft(bit(z), 2)
        out = out + F.shiftleft(level, 3 * k)
    return out


def height_colour(z: Column, lo: Column, hi: Column) -> Point:
    """Blue at the bottom to red at the top."""
    t = F.when(hi > lo, (z - lo) / (hi - lo)).otherwise(F.lit(0.0))
    return t, F.lit(0.0), 1 - t
