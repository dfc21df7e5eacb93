"""First cuts in rounds of commands, against all at once."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kerf import queries
from kerf.grid import Grid
from kerf.operators import lattice, rounds, runs
from kerf.plans import toolpath
from tests.test_runs import PRIMITIVES, shapes


def same(rows):  # noqa: ANN001, ANN201
    return rows


@pytest.mark.parametrize("seed, halves, res, make", [(4, True, 1.0, runs.tested), (5, False, 0.45, runs.words)])
def test_same_cells(spark, seed, halves, res, make):
    """Wherever rounds end; lattices that end within a block and within a word; a job without a name."""
    grid = Grid((0.0, -1.0, 0.0), (17.0, 14.0, 16.0), res)
    df = spark.createDataFrame(shapes(seed, 60, halves), PRIMITIVES).withColumn("job_id", F.when(F.col("job_id") == 1, F.lit(None).cast("long")).otherwise(F.col("job_id")))
    want = lattice.removed(df, grid).select("job_id", "x", "y", "z", "first_cut").cache()
    for first in (1, 100):
        got = runs.cells(rounds.first_cuts(df, same, grid, make, first)).select("job_id", "x", "y", "z", "first_cut")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    want.unpersist()


def test_gone_is_not_dealt(spark):
    """A program that is run again and again: only boxes with something left are dealt, so later rounds deal next to none."""
    grid = Grid((0.0, 0.0, 0.0), (18.0, 18.0, 18.0), 1.0)
    once = [(float(x), float(y), float(z)) for x in range(1, 18, 4) for y in range(1, 18, 4) for z in range(1, 18, 4)]
    rows = [(0, k, 0, "sphere", *c, *c, 4.0) for k, c in enumerate(once * 20)]
    boxed = lattice.index_box(spark.createDataFrame(rows, PRIMITIVES), grid)
    first = runs.union(runs.tested(spark.createDataFrame(rows[: len(once)], PRIMITIVES), grid))
    assert runs.count(first).first()["cells"] == grid.cells
    gone = rounds.gone_blocks(first, grid)
    assert gone.count() == 5**3 and rounds.open_boxes(boxed, gone, grid).isEmpty()
    # One cell less, and what is dealt is the part of its block in each box that has it.
    less = first.withColumn("bits", F.when((F.col("y") == 17) & (F.col("z") == 0), F.col("bits").bitwiseAND(F.lit(~1))).otherwise(F.col("bits")))
    dealt = rounds.open_boxes(boxed, rounds.gone_blocks(less, grid), grid)
    assert 0 < dealt.count() < boxed.count() / 4
    assert dealt.agg(F.max("hi_x"), F.min("lo_y"), F.max("hi_z")).first()[:] == (3, 16, 3)


@pytest.mark.parametrize("bits, res", [(0, 1.0), (1, 1.0), (2, 0.7), (6, 0.2)])
def test_look_ups(spark, bits, res):
    """A box is left out if no node that it touches has a cell left; nodes within a word, of a word and longer ones; a job without a name and one without sums."""
    grid, rng, edge = Grid((0.0, 0.0, 0.0), (17.0, 14.0, 15.0), res), random.Random(bits), 1 << bits
    nx, ny, nz = grid.dims
    # All but a few cells of job null.
    left = {tuple(rng.randrange(n) for n in grid.dims) for _ in range(6)}
    words = [
        (None, y, z, w, bits_)
        for y in range(ny) for z in range(nz) for w in range(-(-nx // 32))
        if (bits_ := sum(1 << x % 32 for x in range(32 * w, min(32 * w + 32, nx)) if (x, y, z) not in left))
    ]
    gone = spark.createDataFrame(words, "job_id long, y int, z int, w int, bits long")
    sums = rounds.left_sums(gone, grid, bits)
    ends = [[sorted(rng.randrange(n) for _ in "ab") for n in grid.dims] for _ in range(300)]
    rows = [(job, k, *(c for e in ends[k] for c in e)) for job in (None, 1) for k in range(len(ends))]
    boxed = spark.createDataFrame(rows, "job_id long, seq long, lo_x int, hi_x int, lo_y int, hi_y int, lo_z int, hi_z int")
    touches = lambda box: any(all(a // edge <= c // edge <= b // edge for c, (a, b) in zip(cell, box)) for cell in left)
    got = rounds.with_left(boxed, sums, grid, bits).select("job_id", "seq").collect()
    assert {r["seq"] for r in got if r["job_id"] == 1} == set(range(300))
    want = {k for k in range(300) if touches(ends[k])}
    assert {r["seq"] for r in got if r["job_id"] is None} == want and 0 < len(want) < 300 + (bits == 6)


def test_bounds_of_sums():
    """Nodes grow with lattices and numbers of jobs."""
    small, large = Grid((0.0,) * 3, (22.0,) * 3, 1.0), Grid((0.0,) * 3, (1000.0,) * 3, 1.0)
    assert [rounds.node_bits(small, n) for n in (0, 1, 300, 10**6, 10**9)] == [0, 0, 0, 5, None]
    assert rounds.node_bits(large, 1) == 6 and rounds.node_bits(large, 10**6) == 10


def passes(spark, n):  # noqa: ANN001, ANN201
    """Segments that empty a lattice of 18 cells a side and are run ``n`` times, and how many they are each time."""
    at = [(float(x), float(y), float(z)) for x in range(1, 18, 4) for y in range(1, 18, 4) for z in range(-4, 18, 4)]
    rows = [(0, k, "G1", *c, c[0] + 0.5, *c[1:]) for k, c in enumerate(at * n)]
    return spark.createDataFrame(rows, "job_id long, seq long, kind string, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"), len(at)


def test_gone_commands(spark):
    """Of commands that come to places where nothing is left no primitives are made."""
    grid, tool, seen = Grid((0.0, 0.0, 0.0), (18.0, 18.0, 18.0), 1.0), queries.TOOL, []
    segs, once = passes(spark, 40)
    made = lambda rows: toolpath.primitives_3axis(rows, tool, grid.res)
    got = runs.cells(rounds.first_cuts(segs, lambda rows: seen.append(rows.count()) or made(rows), grid, first=3 * once, reach=toolpath.reach_3axis(tool)))
    assert seen == [2.5 * once, 0]
    want = lattice.removed(made(segs.where(F.col("seq") < once)), grid).select(got.columns)
    assert want.count() == grid.cells and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_reach(spark):
    """What segments take away lies within their reach."""
    rng = random.Random(3)
    at = [[rng.uniform(-20, 20) for _ in range(6)] for _ in range(200)]
    rows = [(0, k, "G1", *p) for k, p in enumerate([*at, [3.0] * 6])]
    segs = spark.createDataFrame(rows, "job_id long, seq long, kind string, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    reach = toolpath.reach_3axis(queries.TOOL)
    ends = segs.select("seq", *(p[k].alias(f"{e}{n}") for e, p in zip(("from_", "to_"), reach) for k, n in enumerate("xyz")))
    prims = toolpath.primitives_3axis(segs, queries.TOOL, 2.0).join(ends, "seq")
    beyond = [(F.least(f"a{n}", f"b{n}") - F.col("r") < F.col(f"from_{n}") - 1e-9) | (F.greatest(f"a{n}", f"b{n}") + F.col("r") > F.col(f"to_{n}") + 1e-9) for n in "xyz"]
    assert prims.count() > 600 and prims.where(beyond[0] | beyond[1] | beyond[2]).isEmpty()


def test_not_dealt_by_job(spark):
    """Commands aren't exchanged by job to tell their round, though there are more than would be sent to all tasks."""
    grid, plans = Grid((0.0, 0.0, 0.0), (18.0, 18.0, 18.0), 1.0), []
    segs, once = passes(spark, 40)

    def made(rows):  # noqa: ANN001, ANN202
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return toolpath.primitives_3axis(rows, queries.TOOL, grid.res)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "6000")
    try:
        rounds.first_cuts(segs, made, grid, first=3 * once)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) == 2 and not any("SortMergeJoin" in p for p in plans)


def test_none(spark):
    grid = Grid((0.0, 0.0, 0.0), (8.0, 8.0, 8.0), 1.0)
    assert rounds.first_cuts(spark.createDataFrame([], PRIMITIVES), same, grid).isEmpty()


@pytest.fixture(scope="module")
def program(spark, tmp_path_factory):
    """A folder with ``events`` of five jobs, longer than a first round, of which few commands cut, and the cells removed."""
    folder = str(tmp_path_factory.mktemp("program"))
    kind = "CASE WHEN id % 20 < 5 AND id % 3 = 0 AND id % 7 = 1 THEN 'click' ELSE 'error' END AS event_type"
    spark.range(5400).selectExpr("id AS event_id", "id % 5 AS user_id", kind, "timestamp_seconds(id) AS ts").write.parquet(f"{folder}/events.parquet")
    return folder, lattice.removed(queries.toolpath_primitives(spark, folder), queries.BED).cache()


def in_rounds(monkeypatch, query, spark, folder):  # noqa: ANN001, ANN201
    calls, cut = [], rounds.open_boxes
    monkeypatch.setattr(rounds, "open_boxes", lambda *a: calls.append(1) or cut(*a))
    got = queries.QUERIES[query](spark, folder)
    assert calls, "all in one go"
    return sorted(map(tuple, got.collect()))


def test_state(spark, monkeypatch, program):
    folder, cells = program
    want = lattice.after(cells, 500).groupBy("job_id").agg(F.count("*").alias("n"))
    assert in_rounds(monkeypatch, "state_after_step", spark, folder) == sorted(map(tuple, want.collect())) != []


def test_regions(spark, monkeypatch, program):
    folder, cells = program
    names = ["job_id", "seq", "min_x", "min_y", "min_z", "max_x", "max_y", "max_z", "cells"]
    want = lattice.changed_region(cells).select(names)
    assert in_rounds(monkeypatch, "changed_region", spark, folder) == sorted(map(tuple, want.collect())) != []
