"""The lattice: a box cut into cells of equal size. A few numbers, so plain Python."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[float, float, float]
AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Grid:
    """Cells of edge ``res`` from ``lo`` to ``hi``; each axis has ceil(size / res) of them."""

    lo: Vec
    hi: Vec
    res: float = 0.5

    def __post_init__(self) -> None:
        if not self.res > 0:
            raise ValueError("resolution must be positive")
        if any(b < a for a, b in zip(self.lo, self.hi)):
            raise ValueError("the box ends before it begins")

    @classmethod
    def centred(cls, size: Vec, res: float = 0.5, centre: Vec = (0.0, 0.0, 0.0)) -> Grid:
        if any(s < 0 for s in size):
            raise ValueError("sizes can't be negative")
        return cls(tuple(c - s / 2 for c, s in zip(centre, size)), tuple(c + s / 2 for c, s in zip(centre, size)), res)

    @classmethod
    def from_corner(cls, origin: Vec, size: Vec, res: float = 0.5) -> Grid:
        return cls(tuple(map(float, origin)), tuple(o + s for o, s in zip(origin, size)), res)

    @property
    def dims(self) -> tuple[int, int, int]:
        return tuple(math.ceil((b - a) / self.res) for a, b in zip(self.lo, self.hi))

    @property
    def cells(self) -> int:
        nx, ny, nz = self.dims
        return nx * ny * nz

    @property
    def size(self) -> Vec:
        return tuple(b - a for a, b in zip(self.lo, self.hi))

    @property
    def centre(self) -> Vec:
        return tuple((a + b) / 2 for a, b in zip(self.lo, self.hi))

    def index(self, world: Column, axis: int) -> Column:
        """Cell number of a coordinate. Truncates toward zero, so up to a cell below ``lo`` is cell 0."""
        return ((world - F.lit(float(self.lo[axis]))) / F.lit(float(self.res))).cast("int")

    def floor_index(self, world: Column, axis: int) -> Column:
        return F.floor((world - F.lit(float(self.lo[axis]))) / F.lit(float(self.res))).cast("int")

    def world(self, index: Column, axis: int) -> Column:
        """Coordinate of a cell's centre."""
        return F.lit(float(self.lo[axis])) + (index + F.lit(0.5)) * F.lit(float(self.res))

    def contains(self, x: Column, y: Column, z: Column) -> Column:
        """Whether cell numbers lie within the lattice."""
        return F.expr("true") & (x >= 0) & (x < self.dims[0]) & (y >= 0) & (y < self.dims[1]) & (z >= 0) & (z < self.dims[2])

    def linear(self, x: Column, y: Column, z: Column) -> Column:
        nx, ny, _ = self.dims
        return x.cast("long") + y.cast("long") * nx + z.cast("long") * (nx * ny)
