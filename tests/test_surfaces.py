"""Welding, winding, texts of boxes and commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerf.functions import geometry as g
from kerf.grid import Grid
from kerf.operators import lattice, mesh
from kerf.plans import toolpath as T
from kerf.sources import gcode as files


def test_welded(spark):
    """Points join where they round to the same thousandth; normals add up and uses are counted."""
    rows = [(0.0, 0.0, 1.0, 1.0, 0.0, 0.0), (0.0004, -0.0004, 1.0, 0.0, 1.0, 0.0), (0.0011, 0.0, 1.0, 0.0, 0.0, 1.0), (0.0, 0.0, 1.0, 1.0, 0.0, 0.0)]
    got = mesh.welded(spark.createDataFrame(rows, "x double, y double, z double, nx double, ny double, nz double")).collect()
    assert sorted((r["k" + "x"], r["uses"], r["nx"], r["ny"], r["nz"]) for r in got) == [(0, 3, 2.0, 1.0, 0.0), (1, 1, 0.0, 0.0, 1.0)]
    wide = mesh.welded(spark.createDataFrame(rows, "x double, y double, z double, nx double, ny double, nz double"), 0.01).collect()
    assert [(r["uses"], r["nx"]) for r in wide] == [(4, 2.0)]


def test_winding(spark):
    """Facets of a surface agree with their vertices' normals, and turned ones don't."""
    grid = Grid((0.0, 0.0, 0.0), (6.0, 6.0, 6.0), 1.0)
    cut = spark.createDataFrame([(0, 3, 3, 3, 1), (0, 3, 3, 4, 1), (0, 0, 0, 0, 1)], "job_id long, x int, y int, z int, first_cut long")
    facets = mesh.facets(mesh.triangles(mesh.quads(mesh.faces(spark, cut, grid), grid)), grid)
    normals = facets.select("tid", *(F.col(f"n{n}").alias(f"m{n}") for n in "xyz"))
    assert mesh.winding_consistency(facets, normals).first()["consistent"] == 1.0
    swapped = facets.select("tid", *(F.col(f"v{j}{n}").alias(f"v{i}{n}") for i, j in ((1, 1), (2, 3), (3, 2)) for n in "xyz"))
    assert mesh.winding_consistency(swapped, normals).first()["consistent"] == 0.0
    half = facets.where("tid % 2 = 0").select(*swapped.columns).unionByName(swapped.where("tid % 2 = 1"))
    assert mesh.winding_consistency(half, normals).first()["consistent"] == 0.5


def test_texts(spark):
    rows = [("G0", 1, 2.5, -3), files.command("G1_5", 0, 0, 0.25, 10, 20.25, 30, 5)]
    got = [r[0] for r in files.commands(spark, rows).orderBy("seq").select(T.command_text(F.col("kind"))).collect()]
    assert got == ["G0 X1.000 Y2.500 Z-3.000", "G1 5-axis X0.000 Y0.000 Z0.250 A10.000 B20.250 C30.000"]
    box = spark.range(1).select(g.box_text(g.const(0, -1.5, 2), g.const(1, 2, 3.0004))).first()[0]
    assert box == "[<0.000, -1.500, 2.000>, <1.000, 2.000, 3.000>]"


def test_salted_cells(spark):
    """Tiles dealt to further tasks give the same cells."""
    grid = Grid((0.0, 0.0, 0.0), (20.0, 20.0, 20.0), 1.0)
    rows = [(0, k, 0, "sphere", *([9.0 + k % 3] * 6), 4.0) for k in range(40)]
    df = spark.createDataFrame(rows, "job_id long, seq long, part int, shape string, ax double, ay double, az double, bx double, by double, bz double, r double")
    one, four = (sorted(map(tuple, lattice.removed(df, grid, salt).collect())) for salt in (1, 4))
    assert one == four and len(one) > 100
