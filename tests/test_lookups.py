"""Look-ups by block against nodes that meet the field one by one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from kerf.grid import Grid
from kerf.operators import blocks, lattice, lookups, sdf


def test_everywhere(spark):
    """Points in all blocks, at their sides, around the lattice and far from it, repeated and null."""
    grid, band = Grid((-3.0, 1.0, 0.0), (15.0, 33.5, 5.5), 0.5), 6
    rng = np.random.default_rng(4)
    gone = np.argwhere(rng.random(grid.dims) < 0.01)
    cut = spark.createDataFrame([(0, *map(int, c), 0) for c in gone], "job_id long, x int, y int, z int, first_cut long").cache()
    rows = [(k, *(float(a + (b - a) * v) for a, b, v in zip(grid.lo, grid.hi, p))) for k, p in enumerate(rng.random((300, 3)) * 1.3 - 0.15)]
    corners = [(lo + d * 0.5, hi + e * 0.5) for lo, hi in zip(grid.lo, grid.hi) for d, e in zip(range(-4, 4), range(-3, 5))]
    rows += [(1000 + k, float(corners[k % 8][0]), float(corners[8 + k % 8][k % 2]), float(corners[16 + k // 3 % 8][1])) for k in range(60)]
    rows += [(1000 + 100 * j + k, *(v if i == j else (a + b) / 2 for i, (a, b) in enumerate(zip(grid.lo, grid.hi)))) for j in range(3) for k, v in enumerate(sum(corners[8 * j : 8 * j + 8], ()))]
    rows += [rows[0]] * 2 + [(2000, 1e9, -1e9, 0.0), (2001, None, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "id int, wx double, wy double, wz double")
    words, field = blocks.words_of(cut, grid), sdf.from_cells(lattice.dense(spark, cut, grid), grid, band).cache()
    tidy = lambda df: sorted((r[0], *(round(v, 9) + 0.0 for v in r[1:])) for r in df.collect())
    for new, old in ((lookups.sample, sdf.sample), (lookups.gradient, sdf.gradient)):
        got = tidy(new(points, words, grid, band))
        assert got == tidy(old(points, field, grid, band)) and len(got) == len(rows) - 1


def test_only_where_points_are(spark):
    """Of many blocks those of the points are computed, and a point is one row on its way."""
    grid = Grid((0.0, 0.0, 0.0), (128.0, 128.0, 128.0), 1.0)
    words = blocks.words_of(spark.createDataFrame([(0, 40, 40, 40, 0), (0, 100, 100, 100, 0)], "job_id long, x int, y int, z int, first_cut long"), grid)
    points = spark.createDataFrame([(k, 40.0 + k / 50, 40.0, 40.0) for k in range(50)], "id int, wx double, wy double, wz double")
    met, others = lookups._met(points, words, grid, 10, ("id",))
    assert met.select(*blocks.BLOCK).distinct().collect() == [(1, 1, 1)] and met.count() == 50 and others.isEmpty()
    assert lookups._values(words, met.select(*blocks.BLOCK).distinct(), grid, 10).count() == 1
    assert lookups.sample(points, words, grid, 10).agg(F.min("d")).first()[0] < 0
