"""Fields and nearest surfaces by blocks, against windows over whole lines and plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerf.grid import AXES, Grid
from kerf.operators import blocks, lattice, runs, sdf
from kerf.scenarios import shapes

CELLS = "job_id long, x int, y int, z int, first_cut long"


def cut_of(spark, cells):
    return spark.createDataFrame([(0, *map(int, c), 0) for c in cells], CELLS)


def differ(got, want):
    """Rows that only one side has, or with another value."""
    both = got.join(want.withColumnRenamed("d", "e"), list(AXES), "full")
    return both.where("d IS NULL OR e IS NULL OR abs(d - e) > 1e-12").count()


@pytest.mark.parametrize("size,band,share", [((40, 37, 70), 3, 0.002), ((70, 33, 5), 10, 0.0005), ((9, 8, 7), 2.5, 0.3), ((35, 1, 66), 40, 0.01)])
def test_field(spark, size, band, share):
    """Blocks that aren't whole, bands wider than a block, single cells and dense ones: the same as by windows."""
    grid = Grid((0, 0, 0), tuple(map(float, size)), 1.0)
    rng = np.random.default_rng(sum(size))
    cut = cut_of(spark, np.argwhere(rng.random(size) < share))
    got = sdf.from_removed(cut, grid, band)
    assert differ(got, sdf.from_cells(lattice.dense(spark, cut, grid), grid, band)) == 0
    assert got.count() == grid.cells


def test_solid_and_strange(spark):
    """Nothing removed, everything removed, repeated cells and cells outside."""
    grid = Grid((0, 0, 0), (20.0, 16.0, 17.0), 0.5)
    for cells in ([], [(1, 1, 1)] * 5 + [(-1, 0, 0), (99, 0, 0)]):
        cut = cut_of(spark, cells)
        assert differ(sdf.from_removed(cut, grid, 4), sdf.from_cells(lattice.dense(spark, cut, grid), grid, 4)) == 0
    small = Grid((0, 0, 0), (3.0, 3.0, 3.0), 1.0)
    gone = sdf.from_removed(cut_of(spark, np.argwhere(np.ones((3, 3, 3)))), small, 4)
    assert [tuple(r) for r in gone.groupBy("d").count().collect()] == [(-4.0, 27)]
    with pytest.raises(ValueError):
        sdf.from_removed(cut_of(spark, []), small, 1e6)


def test_keys(spark):
    """Lattices by key, one of them without anything removed."""
    grid = Grid((0, 0, 0), (34.0, 5.0, 5.0), 1.0)
    cut = spark.createDataFrame([(1, 2, 2, 2, 0), (2, 33, 4, 4, 0)], CELLS)
    owners = spark.createDataFrame([(1,), (2,), (3,)], "job_id long")
    got = blocks.field(blocks.words_of(cut, grid, ["job_id"]), grid, 3, ["job_id"], owners)
    for job in (1, 2, 3):
        alone = cut.where(F.col("job_id") == job)
        assert differ(got.where(F.col("job_id") == job).drop("job_id"), sdf.from_cells(lattice.dense(spark, alone, grid), grid, 3)) == 0
    assert got.count() == 3 * grid.cells


def test_exchanges(spark):
    """From words to the field: bits move once, and the list of blocks is dealt."""
    grid = Grid((0, 0, 0), (64.0, 64.0, 64.0), 1.0)
    words = runs.union(runs.tested(shapes(spark, ("sphere", (30, 30, 30), (0, 0, 0), 8)), grid))
    seen = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plan = seen(blocks.field(words, grid, 10))
    assert plan.count("Exchange ") - seen(words).count("Exchange ") == 2 and "Window" not in plan and "Join" not in plan
    assert blocks.steps(words, grid, 10).count() == 8 and blocks.steps(words, grid, 2).count() == 8
    corner = runs.union(runs.tested(shapes(spark, ("sphere", (5, 5, 5), (0, 0, 0), 3)), grid))
    assert blocks.steps(corner, grid, 10).count() == 1


@pytest.mark.parametrize("radius", [1, 4])
def test_nearest(spark, radius):
    """Distance and which surface cell, first by z, y, x of equals, across blocks."""
    size = (37, 7, 6)
    rng = np.random.default_rng(radius)
    solid = rng.random(size) < 0.97
    grid = Grid((0, 0, 0), tuple(map(float, size)), 1.0)
    surface = []
    for p in np.ndindex(*size):
        beside = [tuple(np.add(p, d)) for d in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]
        if any(not all(0 <= c < s for c, s in zip(q, size)) or solid[q] != solid[p] for q in beside):
            surface.append(p)
    cells = lattice.dense(spark, cut_of(spark, np.argwhere(~solid)), grid)
    for r in sdf.nearest_surface(cells, grid, radius, 3.5).collect():
        p = tuple(r[:3])
        some = [(sum((a - b) ** 2 for a, b in zip(s, p)), *s[::-1]) for s in surface if max(abs(a - b) for a, b in zip(s, p)) <= radius]
        d2, *at = min(some) if some else (None, None, None, None)
        want = min(3.5, d2**0.5) if some else 3.5
        assert abs(r["d"] - (want if solid[p] else -want)) < 1e-12 and (r["sz"], r["sy"], r["sx"]) == tuple(at)


def test_versions(spark, tmp_path):
    """Each batch writes the blocks near to its cells alone; replays, restarts and versions put together give the field of all cells."""
    from kerf.streaming import incremental

    grid = Grid((0, 0, 0), (128.0, 64.0, 40.0), 1.0)
    places = [(10, 10, 10), (31, 31, 31), (110, 50, 6), (12, 12, 10), (75, 45, 15), (10, 11, 10)]
    cut = lambda k: lattice.removed(shapes(spark, ("sphere", places[k], (0, 0, 0), 2)), grid)
    every = None
    for k in range(len(places)):
        table = incremental.RemovedTable(spark, str(tmp_path / "cells"))
        field = incremental.BoundField(table, grid, str(tmp_path / "field"), 4)
        table.FIRST_WHOLE = field.FIRST_WHOLE = 2
        dirty = table.add(cut(k), k)
        field.update(dirty, k)
        # A ball deep in a block concerns that block alone, one at a corner all eight.
        wrote = spark.read.parquet(str(tmp_path / "field" / "field" / f"batch={k}"))
        assert wrote.count() == (8 if k == 1 else 1)
        if k in (1, 3):
            field.update(dirty, k)
        every = cut(k) if every is None else every.unionByName(cut(k))
        assert differ(field.read(), sdf.from_removed(every, grid, 4)) == 0
        if k == 4:
            before = field.read(3)
            assert before.count() == grid.cells and before.where("x = 75 AND y = 45 AND z = 15").first()["d"] > 0
    assert field.versions._written("whole") == [1, 3] and field.versions._written("field") == [2, 3, 4, 5]
    assert field.packed().count() == 10
    with pytest.raises(ValueError):
        field.read(0)
    size = lambda p: sum(f.stat().st_size for f in p.rglob("*.parquet"))
    assert size(tmp_path / "field" / "field" / "batch=5") < size(tmp_path / "field" / "whole" / "batch=3") / 3
    field.update(table.add(cut(0).where("false"), 6), 6)
    assert field.versions._written("field")[-1] == 5
