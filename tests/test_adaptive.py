"""The octree by samples, against plain recursion."""

from __future__ import annotations

import numpy as np
import pytest

from kerf.grid import Grid
from kerf.operators import adaptive


def recursive(d, grid, band, at, level, out):
    """Leaves from the root down; ``d`` is a dict of cells."""
    size, (x, y, z) = 1 << level, at
    value = lambda *p: d.get(p, band)
    if level == 0:
        out[(0, *at)] = value(*at)
        return
    s = size - 1
    some = [value(x + i, y + j, z + k) for i in (0, s) for j in (0, s) for k in (0, s)] + [value(x + size // 2, y + size // 2, z + size // 2)]
    if len({v > 0 for v in some}) == 1 and max(some) - min(some) < grid.res:
        out[(level, x // size, y // size, z // size)] = (min(some) + max(some)) / 2
        return
    for i, j, k in np.ndindex(2, 2, 2):
        recursive(d, grid, band, (x + i * size // 2, y + j * size // 2, z + k * size // 2), level - 1, out)


@pytest.mark.parametrize("size", [(5, 7, 3), (40, 64, 33), (130, 20, 10)])
def test_octree(spark, size):
    """Lattices below a block, of some, and of several levels above; rows in places, balls and at corners."""
    grid, band = Grid((0, 0, 0), tuple(map(float, size)), 1.0), 4.0
    rng = np.random.default_rng(size[0])
    cells = {tuple(int(c) for c in rng.integers(0, size)): float(rng.integers(-8, 8)) / 2 for _ in range(60)}
    for at in [(0, 0, 0), tuple(s - 1 for s in size), tuple(s // 2 for s in size)]:
        for p in np.ndindex(*size):
            off = sum((a - b) ** 2 for a, b in zip(p, at)) ** 0.5 - 2
            if off < band / 2:
                cells[p] = round(off, 6)
    want = {}
    recursive(cells, grid, band, (0, 0, 0), adaptive.top_level(grid), want)
    field = spark.createDataFrame([(*map(int, p), d) for p, d in cells.items()], "x int, y int, z int, d double")
    got = {tuple(r)[:4]: r["value"] for r in adaptive.octree(field, grid, band).select("level", "cx", "cy", "cz", "value").collect()}
    assert got == want and len({k[0] for k in want}) > 2


def test_nothing(spark):
    """Without rows the root is the one leaf."""
    none = spark.createDataFrame([], "x int, y int, z int, d double")
    for size, level in ((100.0, 7), (3.0, 2)):
        got = adaptive.octree(none, Grid((0, 0, 0), (size,) * 3, 1.0), 2.5).select("level", "cx", "cy", "cz", "value").collect()
        assert [tuple(r) for r in got] == [(level, 0, 0, 0, 2.5)]
