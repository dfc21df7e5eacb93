"""Fixed cuts for timing: what each removes is known, see the tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kerf.grid import Grid
from kerf.operators import blocks, lattice, runs, sdf

PRIMITIVE = "job_id long, seq long, part int, shape string, ax double, ay double, az double, bx double, by double, bz double, r double"


def shapes(spark: SparkSession, *rows: tuple) -> DataFrame:
    """Primitives of one job from (shape, start, end, radius)."""
    return spark.createDataFrame([(0, i, 0, s, *map(float, a), *map(float, b), float(r)) for i, (s, a, b, r) in enumerate(rows)], PRIMITIVE)


def _sphere(size: float, res: float, r: float) -> Callable[[SparkSession], DataFrame]:
    return lambda spark: lattice.removed(shapes(spark, ("sphere", (0, 0, 0), (0, 0, 0), r)), Grid.centred((size,) * 3, res))


def _field(spark: SparkSession) -> DataFrame:
    """The distance field of a million cells."""
    grid = Grid.centred((100, 100, 100), 1.0)
    ball = shapes(spark, ("sphere", (0, 0, 0), (0, 0, 0), 40))
    return blocks.field(runs.union(runs.words(ball, grid)), grid, 2)


SCENARIOS: dict[str, Callable[[SparkSession], DataFrame]] = {
    "sphere_small": _sphere(20, 1.0, 2),
    "sphere_medium": _sphere(100, 1.0, 10),
    "sphere_large": _sphere(200, 2.0, 20),
    "cylinder_medium": lambda spark: lattice.removed(shapes(spark, ("capsule", (-30, 0, 0), (30, 0, 0), 10)), Grid.centred((100, 100, 100), 1.0)),
    "cylinders_ten": lambda spark: lattice.removed(
        shapes(spark, *(("capsule", (-40, -40 + 8 * i, 0), (40, -40 + 8 * i, 0), 5) for i in range(10))), Grid.centred((100, 100, 50), 1.0)
    ),
    "field_million": _field,
}


#: A block of 100 mm with a ball of 50 mm and three rods of 10 mm taken away.
DEMO_GRID = Grid.centred((100, 100, 100), 1.0)
DEMO_BAND = 2.0
DEMO_SHAPES = (
    ("sphere", (0, 0, 0), (0, 0, 0), 50),
    ("capsule", (-40, 0, 50), (40, 0, 50), 10),
    ("capsule", (50, -40, 0), (50, 40, 0), 10),
    ("capsule", (0, 50, -40), (0, 50, 40), 10),
)


def demo_scene(spark: SparkSession) -> DataFrame:
    """The demo's distance field: cells below the band."""
    return sdf.from_primitives(shapes(spark, *DEMO_SHAPES), DEMO_GRID, DEMO_BAND)
