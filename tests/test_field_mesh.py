"""Distance fields, faces, welded and dual meshes, and STL."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerf.grid import Grid
from kerf.operators import lattice as L
from kerf.operators import mesh as M
from kerf.operators import sdf as S
from kerf.plans.toolpath import COMMANDS, Tool
from kerf.simulation import Simulation
from kerf.sources import stl
from tests.test_lattice import shapes

BALL = Grid.centred((20, 20, 20), 1.0)


@pytest.fixture(scope="module")
def ball(spark):
    return L.removed(shapes(spark, ("sphere", (0, 0, 0), (0, 0, 0), 8)), BALL).cache()


@pytest.fixture(scope="module")
def field(spark, ball):
    return S.from_cells(L.dense(spark, ball, BALL), BALL, 10).cache()


def test_histogram(field):
    got = {r["d"]: r["count"] for r in field.groupBy(F.round("d", 1).alias("d")).count().collect()}
    assert got == {-7.1: 8, -6.1: 24, -5.1: 56, -4.1: 144, -3.1: 200, -2.1: 288, -1.1: 392, -0.1: 1064, 0.1: 3616, 0.5: 2208}


def test_field_of_sphere(spark):
    grid = Grid.centred((20, 20, 20), 0.5)
    field = S.from_primitives(shapes(spark, ("sphere", (0, 0, 0), (0, 0, 0), 3)), grid, 10)
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 5.0, 0.0, 0.0), (2, 3.0, 0.0, 0.0)], "id int, wx double, wy double, wz double")
    d = {r["id"]: r["d"] for r in S.sample(points, field, grid).collect()}
    assert -4 < d[0] < 0 < d[1]
    slope = S.gradient(points.where("id = 2"), field, grid).first()
    assert abs(slope["gx"] ** 2 + slope["gy"] ** 2 + slope["gz"] ** 2 - 1) < 1e-9 and slope["gx"] > 0.5


def test_repeated_points(spark, field):
    """Rows with equal keys and places come out as often as they come in, each with its own value."""
    rows = [(1, 3.0, 2.5, 1.25)] * 3 + [(2, 8.0, 0.0, 0.0), (2, 6.5, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "id int, wx double, wy double, wz double")
    alone = points.distinct().withColumn("n", F.monotonically_increasing_id())
    for f, names in ((S.sample, ["d"]), (S.gradient, ["gx", "gy", "gz"])):
        one = {(r["n"]): [r[n] for n in names] for r in f(alone, field, BALL, 10, ("n",)).collect()}
        want = [(r["id"], one[r["n"]]) for r in alone.collect() for _ in range(3 if r["id"] == 1 else 1)]
        got = [(r["id"], [r[n] for n in names]) for r in f(points, field, BALL, 10).collect()]
        tidy = lambda some: sorted((i, [round(v, 9) + 0.0 for v in vs]) for i, vs in some)
        assert tidy(got) == tidy(want)


def test_fields_at_every_row(spark):
    """The queries of points take all rows of lineitem; many share a place."""
    from kerf import queries as Q

    sf = "/root/testdata/sf0.001"
    rows = Q.points(spark, sf).groupBy("ok", "ln", "wx", "wy", "wz").count()
    for name, value in (("trilinear", "d"), ("gradient", "gx")):
        got = Q.QUERIES[f"{name}_points"](spark, sf)
        assert got.where(F.col(value).isNull()).isEmpty()
        assert got.groupBy("ok", "ln", "wx", "wy", "wz").count().exceptAll(rows).isEmpty() and got.count() == Q.points(spark, sf).count()


def test_outside(spark, field):
    far = spark.createDataFrame([(100, 100, 100), (-1, 0, 0)], "x int, y int, z int")
    got = {r["x"]: r["d"] for r in S.look_up(far, field, BALL).collect()}
    assert got == {100: -10.0, -1: -0.5}


def test_difference_and_leaves(spark, field):
    other = S.from_primitives(shapes(spark, ("sphere", (9, 9, 9), (0, 0, 0), 2)), BALL)
    assert S.difference(field, other).where("x = 18 AND y = 18 AND z = 18").first()["d"] < 0
    assert S.octree_leaves(field, BALL, 2).count() == 125
    assert S.surface6(S.constant(spark, BALL).select("x", "y", "z", F.lit(True).alias("material")), BALL).where("surface").count() == 20**3 - 18**3


def test_faces_and_stl(spark, ball, tmp_path):
    faces = M.faces(spark, ball, BALL)
    assert faces.count() == 3648
    quads = M.quads(faces, BALL)
    triangles, vertices = M.triangles(quads), M.vertices(quads, BALL)
    assert triangles.count() == triangles.select("tid").distinct().count() == 7296
    facets = M.facets(triangles, BALL)
    n = stl.write(facets, str(tmp_path / "ball.stl"))
    raw = (tmp_path / "ball.stl").read_bytes()
    assert n == 7296 and len(raw) == 84 + 50 * 7296 == 364_884 and struct.unpack("<I", raw[80:84]) == (7296,)
    # Normals of whole faces point along an axis, and away from material.
    wrong = facets.where(F.abs(F.abs(F.col("nx")) + F.abs(F.col("ny")) + F.abs(F.col("nz")) - 1) > 1e-9)
    assert wrong.count() == 0
    own = triangles.join(quads.select("v0", "v1", "v2", "v3", "nx", "ny", "nz"), F.col("i0") == F.col("v0")).count()
    assert own >= 7296
    assert M.vertex_uses(triangles).agg(F.sum(F.col("uses") * F.col("vertices"))).first()[0] == 3 * 7296


def test_empty_stl(spark, ball):
    none = M.facets(M.triangles(M.quads(M.faces(spark, ball, BALL).where("false"), BALL)), BALL)
    assert len(stl.to_bytes(none)) == 84


def test_dual_solid(spark):
    grid = Grid.centred((10, 10, 10), 1.0)
    solid = S.constant(spark, grid)
    vertices = M.dual_vertices(solid, grid, normals=False)
    assert vertices.count() == 602
    reach = vertices.agg(*(f(F.col(f"p{a}")) for a in "xyz" for f in (F.min, F.max))).first()
    assert all(abs(abs(v) - 5) <= 1.01 for v in reach)


def test_dual_ball(field):
    vertices = M.dual_vertices(field, BALL).cache()
    assert vertices.count() == 3652
    quads = M.dual_quads(vertices, BALL).cache()
    assert quads.count() == 3648
    assert M.dual_triangles(quads).count() > 7000
    assert vertices.where(F.abs(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2 - 1) > 1e-6).count() == 0


def test_smooth_export(spark, tmp_path):
    """The smooth mesh goes to a file: wound one way, along the field's gradient into the material, and as many bytes as it has triangles."""
    sim = Simulation(spark, Grid.centred((12, 12, 12), 1.0), Tool(4, 10, ball=True), start=(0, 0, 20))
    sim.execute(spark.createDataFrame([(0, 0, "G1", 0.0, 0.0, 3.0, None, None, None, 100.0)], COMMANDS))
    n = sim.export_stl(str(tmp_path / "a.stl"), smooth=True)
    raw = (tmp_path / "a.stl").read_bytes()
    assert n > 100 and len(raw) == 84 + 50 * n and int.from_bytes(raw[80:84], "little") == n
    tri = np.frombuffer(raw[84:], np.dtype([("f", "<f4", (12,)), ("z", "<u2")]))["f"].reshape(-1, 4, 3)
    # What the triangles enclose, with the sign of inward ones: less than the block and a cell around it.
    volume = np.einsum("ij,ij->i", tri[:, 1], np.cross(tri[:, 2], tri[:, 3])).sum() / 6
    assert -(13**3) < volume < -(9**3)
    assert len(sim.stl_bytes()) % 50 == 84 % 50
    direct = sim.direct_field(5)
    assert direct.count() > 0 and direct.where("d >= 5").count() == 0
    assert sim.facets(averaged=True).count() == sim.facets().count()


def test_nearest_and_octree(spark):
    """Against plain loops, on a small block."""
    rng = np.random.default_rng(5)
    solid = rng.random((8, 8, 8)) < 0.9
    grid = Grid((0, 0, 0), (8, 8, 8), 1.0)
    cells = spark.createDataFrame([(x, y, z, bool(solid[x, y, z])) for x in range(8) for y in range(8) for z in range(8)], "x int, y int, z int, material boolean")
    surface = []
    for x, y, z in np.ndindex(8, 8, 8):
        near = [(x + dx, y + dy, z + dz) for dx, dy, dz in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]
        if any(not all(0 <= c < 8 for c in p) or solid[p] != solid[x, y, z] for p in near):
            surface.append((x, y, z))
    for r in S.nearest_surface(cells, grid, 1, 10).collect():
        some = [sum((a - b) ** 2 for a, b in zip(s, r[:3])) for s in surface if max(abs(a - b) for a, b in zip(s, r[:3])) <= 1]
        want = min(some) ** 0.5 if some else 10.0
        assert abs(r["d"] - (want if solid[r["x"], r["y"], r["z"]] else -want)) < 1e-12
    field = cells.selectExpr("x", "y", "z", "CASE WHEN x < 4 THEN 3.0D ELSE x * 2.0D END AS d")
    leaves = S.octree(field, grid, 3).groupBy("level").count().collect()
    assert {r["level"]: r["count"] for r in leaves} == {2: 4, 0: 256}
    listed = [tuple(r) for r in L.listed(cells.select("x", "y", "z"), grid).limit(9).collect()]
    assert listed == [(k, 0, 0) for k in range(8)] + [(0, 1, 0)]
    assert [tuple(r) for r in L.listed(cells.select("x", "y", "z"), grid, by_octree=True).limit(4).collect()] == [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0)]


def test_field_exchanges(spark):
    """Three exchanges make the field's windows, whatever the order of the cells."""
    grid = Grid((0, 0, 0), (6, 5, 4), 1.0)
    cells = spark.createDataFrame([(x, y, z, (x + y * z) % 5 > 0) for x in range(6) for y in range(5) for z in range(4)], "x int, y int, z int, material boolean")
    plan = S.from_cells(cells, grid)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 3


@pytest.mark.parametrize("res", [1.0, 0.7])
def test_octree_one_cell_apart(spark, res):
    """Values a whole resolution apart stay apart, though as binary numbers they seem nearer; a little less is one leaf."""
    grid = Grid((0.0, 0.0, 0.0), (4 * res, 2 * res, 2 * res), res)
    cells = [(x, y, z) for x in range(4) for y in range(2) for z in range(2)]
    for least, one in ((-4.1, False), (-4.0, True)):
        field = spark.createDataFrame([(*c, (-3.1 if (c[1] + c[2]) % 2 else least) * res) for c in cells], "x int, y int, z int, d double")
        assert [r["leaf"] for r in S.octree_leaves(field, grid, 1).collect()] == [one, one]
        assert {(r["level"], r["count"]) for r in S.octree(field, grid, 1).groupBy("level").count().collect()} == ({(1, 2)} if one else {(0, 16)})
