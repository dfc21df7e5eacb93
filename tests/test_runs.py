"""Words of bits from runs and from tests, against cells."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from kerf.grid import Grid
from kerf.operators import lattice, runs

PRIMITIVES = "job_id long, seq long, part int, shape string, ax double, ay double, az double, bx double, by double, bz double, r double"


def shapes(seed: int, n: int, halves: bool) -> list[tuple]:
    """Whole and half numbers, where centres often lie on surfaces, or anything; axes along, across and almost along x; none at all."""
    rng = random.Random(seed)
    some = lambda: rng.randint(-8, 40) / 2 if halves else rng.uniform(-4, 20)
    out = []
    for k in range(n):
        a = [some() for _ in range(3)]
        b = [some() for _ in range(3)]
        turn = rng.randrange(7)
        if turn < 3:
            b = [v if i == turn else a[i] for i, v in enumerate(b)]
        elif turn == 3:
            b = [b[0], a[1] + 1e-8, a[2]]
        elif turn == 4:
            b = [a[0] + 1e-8, *b[1:]]
        elif turn == 5:
            b = list(a)
        r = rng.randint(1, 12) / 2 if halves else rng.uniform(0.1, 6)
        shape = rng.choice(["sphere", "cylinder", "capsule"])
        out.append((k % 2, k * 30_000, k % 3, shape, *map(float, a), *(map(float, a) if shape == "sphere" else map(float, b)), float(r)))
    return out


@pytest.mark.parametrize("seed, halves, res", [(1, True, 1.0), (2, False, 0.7), (3, True, 0.25)])
def test_same_cells(spark, seed, halves, res):
    grid = Grid((0.0, -1.0, 0.0), (17.0, 15.0, 16.0), res)
    df = spark.createDataFrame(shapes(seed, 60 if res > 0.5 else 16, halves), PRIMITIVES).repartition(3)
    want = lattice.removed(df, grid).select("job_id", "x", "y", "z", "first_cut")
    for make in (runs.words, runs.tested):
        cuts = runs.first_cuts(make(df, grid)).cache()
        got = runs.cells(cuts).select("job_id", "x", "y", "z", "first_cut")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        left = lambda d: sorted(map(tuple, d.collect()))
        assert left(runs.material_count(cuts, grid)) == left(runs.material_count(runs.union(make(df, grid)), grid)) == left(lattice.material_count(want, grid))
        assert left(runs.changed_region(cuts)) == left(lattice.changed_region(want))
        assert left(runs.count(runs.after(cuts, 300_000))) == left(lattice.after(want, 300_000).groupBy("job_id").agg(F.count("*").alias("n")))
        cuts.unpersist()


def test_few_rows(spark):
    """A cylinder along x over 2,000 cells is a row a line and word, not a row a cell."""
    grid = Grid((0.0, 0.0, 0.0), (2000.0, 20.0, 20.0), 1.0)
    rod = spark.createDataFrame([(0, 1, 0, "cylinder", 0.0, 10.0, 10.0, 2000.0, 10.0, 10.0, 5.0)], PRIMITIVES)
    lines = runs.runs(lattice.index_box(rod, grid), grid)
    n = sum(1 for y in range(20) for z in range(20) if (y + 0.5 - 10) ** 2 + (z + 0.5 - 10) ** 2 <= 25)
    assert lines.count() == n and {(r["first"], r["last"]) for r in lines.collect()} == {(0, 1999)}
    assert runs.words(rod, grid).count() == n * math.ceil(2000 / 32)
    assert runs.material_count(runs.union(runs.words(rod, grid)), grid).first()["removed"] == 2000 * n


def test_none(spark):
    grid = Grid((0.0, 0.0, 0.0), (8.0, 8.0, 8.0), 1.0)
    none = spark.createDataFrame([], PRIMITIVES)
    assert runs.first_cuts(runs.words(none, grid)).count() == runs.first_cuts(runs.tested(none, grid)).count() == 0
    away = spark.createDataFrame([(0, 1, 0, "sphere", 50.0, 0.0, 0.0, 50.0, 0.0, 0.0, 3.0)], PRIMITIVES)
    assert runs.words(away, grid).isEmpty()
