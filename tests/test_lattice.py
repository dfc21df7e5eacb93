"""Golden counts of cut stock, and the laws that set-based removal obeys."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kerf.grid import Grid
from kerf.operators import lattice as L
from kerf.plans import toolpath as T
from kerf.plans.toolpath import Tool
from kerf.scenarios import shapes
from kerf.sources.gcode import command, commands


def cut(spark, grid, tool, moves, start=(0.0, 0.0, 0.0)):
    segs = T.segments(commands(spark, moves), start)
    return L.removed(T.primitives(segs, tool, grid.res), grid)


@pytest.mark.parametrize(
    "size, res, shape, expected",
    [
        (10, 0.5, ("sphere", (0, 0, 0), (0, 0, 0), 1), 32),
        (10, 0.5, ("capsule", (-2, 0, 0), (2, 0, 0), 0.5), 40),
        (20, 1.0, ("sphere", (0, 0, 0), (0, 0, 0), 8), 8000 - 5824),
        (20, 1.0, ("sphere", (0, 0, 0), (0, 0, 0), 2), 32),
        (100, 1.0, ("sphere", (0, 0, 0), (0, 0, 0), 10), 4224),
        (200, 2.0, ("sphere", (0, 0, 0), (0, 0, 0), 20), 4224),
        (100, 1.0, ("capsule", (-30, 0, 0), (30, 0, 0), 10), 23184),
    ],
)
def test_shapes(spark, size, res, shape, expected):
    assert L.removed(shapes(spark, shape), Grid.centred((size,) * 3, res)).count() == expected


def test_ten_cylinders(spark):
    grid = Grid.centred((100, 100, 50), 1.0)
    got = shapes(spark, *(("capsule", (-40, -40 + 8 * i, 0), (40, -40 + 8 * i, 0), 5) for i in range(10)))
    assert L.removed(got, grid).count() == 63_472


@pytest.mark.parametrize("ball, left", [(False, 932), (True, 928)])
def test_one_cut(spark, ball, left):
    grid = Grid.centred((10, 10, 10), 1.0)
    gone = cut(spark, grid, Tool(2, 10, ball), [("G1", 2, 0, 0)], (-2.0, 0.0, 0.0))
    assert L.count_one(gone, grid) == left
    points = spark.createDataFrame([(2.5, 0.0, 0.0), (3.5, 0.0, 0.0), (99.0, 0.0, 0.0)], "wx double, wy double, wz double")
    got = {r["wx"]: r["material"] for r in L.look_up_world(points, gone, grid).collect()}
    assert got == {2.5: False, 3.5: True, 99.0: False}


def test_sequence_and_two_cuts(spark):
    grid = Grid.centred((20, 20, 20), 1.0)
    tool = Tool(2, 10)
    moves = [("G0", -3, 0, 5), ("G0", -3, 0, 0), ("G1", 3, 0, 0), ("G0", 3, 0, 5)]
    assert L.count_one(cut(spark, grid, tool, moves, (0.0, 0.0, 5.0)), grid) == 7828
    two = [("G0", -3, -2, 0), ("G1", 3, -2, 0), ("G0", 3, -2, 5), ("G0", -3, 2, 5), ("G0", -3, 2, 0), ("G1", 3, 2, 0)]
    assert L.count_one(cut(spark, grid, tool, two, (0.0, 0.0, 5.0)), grid) == 7656


def test_square_pocket(spark):
    grid = Grid((-50, -50, 0), (50, 50, 50), 1.0)
    ring = [(20, -20), (20, 20), (-20, 20), (-20, -20)]
    inner = [(-10, -10), (10, -10), (10, 10), (-10, 10), (-10, -10)]
    moves = [("G0", -20, -20, 45), *(("G1", x, y, 45) for x, y in ring), ("G1", -20, -20, 40), *(("G1", x, y, 40) for x, y in inner), ("G0", 0, 0, 60)]
    assert L.count_one(cut(spark, grid, Tool(10, 50, True), moves, (0.0, 0.0, 60.0)), grid) == 474_064


def test_corner_stock(spark):
    grid = Grid.from_corner((0, 0, 0), (100, 100, 100), 2.0)
    assert L.count_one(cut(spark, grid, Tool(10, 50), [("G0", -20, 0, 0), ("G1", 20, 0, 0)]), grid) == 124_310
    grid = Grid.from_corner((0, 0, 0), (20, 20, 20), 2.0)
    assert L.count_one(cut(spark, grid, Tool(5, 20), [("G0", 0, 0, 0), ("G1", 10, 0, 0)]), grid) == 940
    grid = Grid.from_corner((0, 0, 0), (10, 10, 10), 1.0)
    assert L.count_one(cut(spark, grid, Tool(2, 10), [("G0", -3, 0, 0), ("G1", 3, 0, 0)]), grid) == 960


def test_order_repetition_and_steps(spark):
    grid = Grid.centred((12, 12, 12), 1.0)
    tool = Tool(2, 4)
    moves = [("G1", 3, 0, 0), ("G1", 3, 3, 0), ("G0", 0, 0, 0), ("G1", -3, -3, -1)]
    segs = T.segments(commands(spark, moves))
    prims = T.primitives(segs, tool, 1.0)
    all_ = L.removed(prims, grid)
    key = lambda df: {tuple(r)[1:4] for r in df.collect()}
    backwards = prims.withColumn("seq", 100 - F.col("seq"))
    assert key(all_) == key(L.removed(backwards, grid)) == key(L.removed(prims.unionAll(prims), grid, salt=3))
    for k in range(4):
        replay = L.removed(T.primitives(segs.where(F.col("seq") <= k), tool, 1.0), grid)
        assert key(L.after(all_, k)) == key(replay)
    # Without tiles: every cell against every primitive.
    plain = L.lattice(spark, grid).crossJoin(L.index_box(prims, grid)).where(L.inside(grid)).select("job_id", "x", "y", "z").distinct()
    assert key(plain) == key(all_)


def test_views(spark):
    grid = Grid.centred((6, 6, 6), 1.0)
    gone = L.removed(shapes(spark, ("sphere", (0, 0, 0), (0, 0, 0), 1.5)), grid)
    n = gone.count()
    assert L.occupied(spark, gone, grid).count() == 216 - n
    assert L.dense(spark, gone, grid).where("material").count() == 216 - n
    assert L.material_count(gone, grid).first()["remaining"] == 216 - n
    box = L.changed_region(gone).first()
    assert (box["min_x"], box["max_x"], box["cells"]) == (2, 3, n) or n > 8
    root = L.octree_counts(gone, 3).where("level = 0").first()
    assert (root["node"], root["empty"]) == (0, n)
    edits = spark.createDataFrame([(0, 9, 2, 2, 2, True), (0, 9, 0, 0, 0, False), (0, 9, 99, 0, 0, False)], "job_id long, seq long, x int, y int, z int, material boolean")
    assert L.edited(gone, edits, grid).count() == n


def test_grid_checks():
    with pytest.raises(ValueError):
        Grid((0, 0, 0), (1, 1, 1), 0)
    with pytest.raises(ValueError):
        Grid((0, 0, 2), (1, 1, 1), 1)
    with pytest.raises(ValueError):
        Tool(0, 10)
    assert Grid.centred((10, 15, 20), 1.0).dims == (10, 15, 20)
    assert Grid((0, 0, 0), (10, 20, 30)).centre == (5, 10, 15)


def test_5axis(spark):
    grid = Grid.centred((20, 20, 20), 1.0)
    moves = [command("G0_5", 0, 0, 0, 0, 0, 0), command("G1_5", 4, 0, 0, 0, 90, 0), command("G1_5", 4, 0, 0, 0, 0, 0)]
    segs = T.segments(commands(spark, moves))
    prims = T.primitives(segs, Tool(2, 6), 1.0)
    # Four steps are five samples of two shapes; the last move only turns the tool.
    assert prims.count() == 10
    last = prims.orderBy(F.desc("part")).first()
    assert (round(last["bx"], 9), round(last["bz"], 9)) == (10.0, 0.0)
    assert L.removed(prims, grid).count() > 0


def test_ranges_of_a_job(spark, monkeypatch):
    """A job cut into ranges and a tile cut into slices give what they give whole, in more than one task."""
    n = 300
    words = spark.range(n).select(
        F.lit(7).cast("long").alias("job_id"), (F.col("id") * 3 - 200).alias("seq"), (F.col("id") % 3).cast("int").alias("code"),
        *(F.when(F.col("id") % k == 0, (F.col("id") * m % 5).cast("double")).alias(a) for a, k, m in (("x", 4, 3), ("y", 50, 7), ("z", 140, 11))), F.lit(None).cast("double").alias("f"),
    )
    grid, tool = Grid.centred((12, 12, 12), 1.0), Tool(2, 4)

    def results():
        commands_ = T.modal(words, (1.0, 2.0, 3.0))
        turned = commands_.withColumns({"kind": F.when(F.col("seq") % 7 == 0, "G1_5").otherwise(F.col("kind")), "a": F.col("seq").cast("double")})
        segs = T.segments(turned, (4.0, 5.0, 6.0), (7.0, 8.0, 9.0))
        cut_ = L.removed(T.primitives(segs, tool, 1.0), grid)
        return [commands_, segs, T.steps(commands_, 90, 120), cut_]

    rows = lambda dfs: [sorted(map(tuple, df.collect()), key=repr) for df in dfs]
    whole = rows(results())
    assert [len(r) for r in whole[:3]] == [n, n, 120]
    monkeypatch.setattr(T, "RANGE_BITS", 5)
    monkeypatch.setattr(L, "SLICE_BITS", 5)
    dfs = results()
    assert rows(dfs) == whole
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in T.modal(words), T.segments(T.modal(words)), L.hits(T.primitives(T.segments(T.modal(words)), tool, 1.0), Grid.centred((4, 4, 4), 1.0)):
            assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
