"""Surfaces: exposed faces of cells, welded vertices, and dual contours of fields.

Corners of cells have whole numbers as keys, so welding is a grouping and a vertex id
is its corner's linear number: no global sort gives it, and it is the same in any run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerf.functions import geometry as g
from kerf.grid import AXES, Grid
from kerf.operators import sdf
from kerf.operators.lattice import lattice

#: For each side of a cell its outward normal and its corners in the order of winding.
SIDES = (
    ((-1, 0, 0), ((0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0))),
    ((1, 0, 0), ((1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1))),
    ((0, -1, 0), ((0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1))),
    ((0, 1, 0), ((0, 1, 0), (0, 1, 1), (1, 1, 1), (1, 1, 0))),
    ((0, 0, -1), ((0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 0, 0))),
    ((0, 0, 1), ((0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))),
)


def faces(spark: SparkSession, cut: DataFrame, grid: Grid) -> DataFrame:
    """x, y, z, side of each exposed side of a cell of material, for one job's removed cells.

    A side is exposed towards a removed cell or the outside. Both are listed from what
    is sparse, the removed cells and the lattice's outer layer, never from the lattice.
    """
    gone = cut.select(*AXES).distinct()
    around = [
        F.struct(*((F.col(n) - d).alias(n) for n, d in zip(AXES, normal)), F.lit(k).alias("side")) for k, (normal, _) in enumerate(SIDES)
    ]
    inner = gone.select(F.inline(F.array(*around))).where(grid.contains(F.col("x"), F.col("y"), F.col("z")))
    outer = None
    for k, (normal, _) in enumerate(SIDES):
        axis = next(i for i, d in enumerate(normal) if d)
        u, v = (i for i in range(3) if i != axis)
        edge = 0 if normal[axis] < 0 else grid.dims[axis] - 1
        cols = {
            AXES[axis]: F.lit(edge),
            AXES[u]: (F.col("id") % grid.dims[u]).cast("int"),
            AXES[v]: F.floor(F.col("id") / grid.dims[u]).cast("int"),
        }
        layer = spark.range(grid.dims[u] * grid.dims[v]).select(*(cols[n].alias(n) for n in AXES), F.lit(k).alias("side"))
        outer = layer if outer is None else outer.unionByName(layer)
    return inner.unionByName(outer).join(gone, list(AXES), "left_anti")


def _corner_id(grid: Grid, x: Column, y: Column, z: Column) -> Column:
    nx, ny, _ = grid.dims
    return x.cast("long") + y.cast("long") * (nx + 1) + z.cast("long") * ((nx + 1) * (ny + 1))


def quads(faces_: DataFrame, grid: Grid) -> DataFrame:
    """Each face with v0 .. v3, ids of its corners, and nx, ny, nz."""

    def at(corner: int) -> Column:
        out = None
        for k, (_, corners) in enumerate(SIDES):
            v = _corner_id(grid, *(F.col(n) + o for n, o in zip(AXES, corners[corner])))
            out = F.when(F.col("side") == k, v) if out is None else out.when(F.col("side") == k, v)
        return out

    normal = [F.element_at(F.array(*(F.lit(float(s[0][i])) for s in SIDES)), F.col("side") + 1).alias(f"n{n}") for i, n in enumerate(AXES)]
    return faces_.select(*AXES, "side", *(at(i).alias(f"v{i}") for i in range(4)), *normal)


def triangles(quads_: DataFrame) -> DataFrame:
    """tid, i0, i1, i2: two a quad. Ids say cell and side, so they are unique and the same in any run."""
    pair = F.array(*(F.struct(F.lit(k).alias("half"), F.col("v0").alias("i0"), F.col(a).alias("i1"), F.col(b).alias("i2")) for k, (a, b) in enumerate((("v1", "v2"), ("v2", "v3")))))
    base = (((F.col("z").cast("long") * (1 << 20) + F.col("y")) * (1 << 20)) + F.col("x")) * 12 + F.col("side") * 2
    return quads_.select(base.alias("_b"), F.inline(pair)).select((F.col("_b") + F.col("half")).alias("tid"), "i0", "i1", "i2")


def vertices(quads_: DataFrame, grid: Grid) -> DataFrame:
    """vid, x, y, z, nx, ny, nz: welded corners, with the mean of their faces' normals at unit length.

    Where opposite normals cancel, the normal is null.
    """
    each = quads_.select(F.explode(F.array("v0", "v1", "v2", "v3")).alias("vid"), "nx", "ny", "nz")
    sums = each.groupBy("vid").agg(*(F.sum(f"n{n}").alias(f"n{n}") for n in AXES), F.count("*").alias("uses"))
    unit = g.normalized(g.point("n"))
    return sums.select(
        "vid", *(c.alias(n) for n, c in zip(AXES, _corner(F.col("vid"), grid))), *(c.alias(f"n{n}") for c, n in zip(unit, AXES)), "uses"
    )


def welded(points: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Points (x, y, z, nx, ny, nz) joined where they round to the same multiple of ``tolerance``."""
    key = [F.round(F.col(n) / tolerance).cast("long").alias(f"k{n}") for n in AXES]
    return points.groupBy(*key).agg(*(F.first(n).alias(n) for n in AXES), *(F.sum(f"n{n}").alias(f"n{n}") for n in AXES), F.count("*").alias("uses"))


def _corner(vid: Column, grid: Grid) -> g.Point:
    """Coordinates of a corner, from its id."""
    nx, ny, _ = grid.dims
    place = (vid % (nx + 1), F.floor(vid / (nx + 1)) % (ny + 1), F.floor(vid / ((nx + 1) * (ny + 1))))
    return tuple(F.lit(float(grid.lo[k])) + p * F.lit(float(grid.res)) for k, p in enumerate(place))


def facets(triangles_: DataFrame, grid: Grid, vertices_: DataFrame | None = None) -> DataFrame:
    """tid, v1x .. v3z and nx, ny, nz of each triangle.

    Coordinates follow from the ids, so nothing is joined. The normal is the triangle's own, or
    with ``vertices_`` that of its first vertex, where it has one.
    """
    at = {f"v{i + 1}{n}": c for i in range(3) for n, c in zip(AXES, _corner(F.col(f"i{i}"), grid))}
    out = triangles_.withColumns(at)
    a, b, c = (g.point(f"v{i}") for i in (1, 2, 3))
    normal = g.normalized(g.cross(g.subtract(b, a), g.subtract(c, a)), g.const(0, 1, 0))
    if vertices_ is not None:
        out = out.join(vertices_.select(F.col("vid").alias("i0"), *(F.col(f"n{n}").alias(f"_n{n}") for n in AXES)), "i0")
        normal = tuple(F.coalesce(f"_n{n}", o) for n, o in zip(AXES, normal))
    return out.select("tid", *(c.alias(f"n{n}") for c, n in zip(normal, AXES)), *(f"v{i}{n}" for i in (1, 2, 3) for n in AXES))


# Dual contours

#: Corner k of a cell lies at bit 0 of k along x, bit 1 along y, bit 2 along z.
CORNERS = tuple(tuple(k >> i & 1 for i in range(3)) for k in range(8))
#: The twelve edges of a cell: corners that differ in one bit.
EDGES = tuple((a, a | 1 << i) for i in range(3) for a in range(8) if not a >> i & 1)


def dual_cells(field: DataFrame, grid: Grid, band: float = sdf.BAND, default: float | None = None) -> DataFrame:
    """x, y, z and corner values c0 .. c7 of cells whose corners differ in sign.

    Cells begin one before the lattice, so that it has an outer shell. Values are
    joined once: each goes to the eight cells around it.
    """
    nx, ny, nz = grid.dims
    sides = F.array(*(F.struct(*((F.col(n) - o).alias(n) for n, o in zip(AXES, c)), F.lit(k).alias("_c")) for k, c in enumerate(CORNERS)))
    # The lattice and a layer around it.
    padded = Grid(tuple(a - grid.res for a in grid.lo), tuple(a + (d + 1) * grid.res for a, d in zip(grid.lo, grid.dims)), grid.res)
    nodes = lattice(field.sparkSession, padded).select(*((F.col(n) - 1).alias(n) for n in AXES))
    values = sdf.look_up(nodes, field, grid, band, default)
    each = values.select("d", F.inline(sides)).where((F.col("x") >= -1) & (F.col("y") >= -1) & (F.col("z") >= -1) & (F.col("x") < nx) & (F.col("y") < ny) & (F.col("z") < nz))
    corner = lambda k: F.max(F.when(F.col("_c") == k, F.col("d"))).alias(f"c{k}")
    cells = each.groupBy(*AXES).agg(*map(corner, range(8)))
    positive = sum((F.when(F.col(f"c{k}") > 0, 1).otherwise(0) for k in range(8)), F.lit(0))
    return cells.where(positive.between(1, 7))


def dual_crossings(cells: DataFrame, grid: Grid) -> DataFrame:
    """x, y, z, edge, wx, wy, wz: where the field is zero along each edge that changes sign."""
    found = []
    for e, (a, b) in enumerate(EDGES):
        va, vb = F.col(f"c{a}"), F.col(f"c{b}")
        t = F.try_divide(va, va - vb)
        at = [
            (F.lit(float(grid.lo[k])) + (F.col(n) + CORNERS[a][k] + t * (CORNERS[b][k] - CORNERS[a][k])) * F.lit(float(grid.res))).alias(f"w{n}")
            for k, n in enumerate(AXES)
        ]
        found.append(F.when((va > 0) != (vb > 0), F.struct(F.lit(e).alias("edge"), *at)))
    return cells.select(*AXES, F.inline(F.filter(F.array(*found), lambda s: s.isNotNull())))


def dual_vertices(field: DataFrame, grid: Grid, band: float = sdf.BAND, default: float | None = None, normals: bool = True) -> DataFrame:
    """x, y, z, px, py, pz (and nx, ny, nz): one vertex a cell, the mean of its crossings.

    Its normal is the mean of the gradients there, else away from the cell's centre, else +y.
    """
    crossings = dual_crossings(dual_cells(field, grid, band, default), grid)
    mean = crossings.groupBy(*AXES).agg(*(F.avg(f"w{n}").alias(f"p{n}") for n in AXES))
    if not normals:
        return mean
    slopes = sdf.gradient(crossings, field, grid, band, (*AXES, "edge"))
    valid = g.is_valid_normal(g.point("g"))
    sums = slopes.groupBy(*AXES).agg(*(F.sum(F.when(valid, F.col(f"g{n}")).otherwise(0.0)).alias(f"s{n}") for n in AXES))
    middle = tuple(grid.world(F.col(n), k) for k, n in enumerate(AXES))
    away = g.normalized(g.subtract(g.point("p"), middle), g.const(0, 1, 0), 1e-4)
    unit = g.normalized(g.point("s"), away, 1e-4)
    return mean.join(sums, list(AXES)).select(*AXES, "px", "py", "pz", *(c.alias(f"n{n}") for c, n in zip(unit, AXES)))


#: The cells around an edge of the lattice along x, y, z, in the order of winding.
AROUND = (
    ((0, 0, 0), (0, 1, 0), (0, 1, 1), (0, 0, 1)),
    ((0, 0, 0), (0, 0, 1), (1, 0, 1), (1, 0, 0)),
    ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)),
)


def dual_quads(vertices_: DataFrame, grid: Grid) -> DataFrame:
    """x, y, z, axis and, of each of four cells with a vertex, position and normal (structs q0 .. q3).

    A quad stands wherever four cells around an edge have vertices. Each vertex goes to
    the quads that it may be part of, and those with all four stay: one grouping
    instead of twelve joins.
    """
    slots = F.array(
        *(
            F.struct(F.lit(axis).alias("axis"), F.lit(i).alias("i"), *((F.col(n) - o).alias(n) for n, o in zip(AXES, cell)))
            for axis, ring in enumerate(AROUND)
            for i, cell in enumerate(ring)
        )
    )
    vertex = F.struct("px", "py", "pz", *(f"n{n}" for n in AXES))
    each = vertices_.select(vertex.alias("q"), F.inline(slots))
    nx, ny, nz = grid.dims
    inside = (F.col("x") >= -1) & (F.col("y") >= -1) & (F.col("z") >= -1) & (F.col("x") < nx) & (F.col("y") < ny) & (F.col("z") < nz)
    found = each.where(inside).groupBy(*AXES, "axis").agg(*(F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in range(4)), F.count("*").alias("_n"))
    return found.where("_n = 4").drop("_n")


def dual_triangles(quads_: DataFrame) -> DataFrame:
    """Facets of dual quads, wound to agree with the mean of the vertices' normals; degenerate ones go."""
    q = [tuple(F.col(f"q{i}")[f"p{n}"] for n in AXES) for i in range(4)]
    normal = [tuple(F.col(f"q{i}")[f"n{n}"] for n in AXES) for i in range(4)]
    face = g.cross(g.subtract(q[1], q[0]), g.subtract(q[2], q[0]))
    mean = tuple(sum((n[k] for n in normal[1:]), normal[0][k]) / 4 for k in range(3))
    # What counts as degenerate.
    usable = (g.dot(face, face) >= 1e-8) & (g.dot(mean, mean) >= 1e-8)
    # At right angles, where rounding would decide, the winding stays.
    flip = g.dot(face, mean) < -1e-9

    def facet(half: int, a: int, b: int, c: int) -> Column:
        return F.struct(F.lit(half).alias("half"), *(F.col(f"q{i}")[f"p{n}"].alias(f"v{j}{n}") for j, i in ((1, a), (2, b), (3, c)) for n in AXES))

    pair = F.when(flip, F.array(facet(0, 0, 2, 1), facet(1, 0, 3, 2))).otherwise(F.array(facet(0, 0, 1, 2), facet(1, 0, 2, 3)))
    each = quads_.where(usable).select(*AXES, "axis", F.inline(pair))
    base = (((F.col("z").cast("long") + 1) * (1 << 20) + F.col("y") + 1) * (1 << 20) + F.col("x") + 1) * 6 + F.col("axis") * 2 + F.col("half")
    a, b, c = (g.point(f"v{i}") for i in (1, 2, 3))
    unit = g.normalized(g.cross(g.subtract(b, a), g.subtract(c, a)), g.const(0, 1, 0))
    return each.select(base.alias("tid"), *(u.alias(f"n{n}") for u, n in zip(unit, AXES)), *(f"v{i}{n}" for i in (1, 2, 3) for n in AXES))


def winding_consistency(facets_: DataFrame, normals: DataFrame) -> DataFrame:
    """Share of triangles (tid, v1x ..) that agree with the normals (tid, mx, my, mz) of their vertices."""
    a, b, c = (g.point(f"v{i}") for i in (1, 2, 3))
    face = g.cross(g.subtract(b, a), g.subtract(c, a))
    return facets_.join(normals, "tid").agg(F.avg(F.when(g.dot(face, g.point("m")) > -1e-3, 1.0).otherwise(0.0)).alias("consistent"))


def vertex_uses(triangles_: DataFrame) -> DataFrame:
    """How many vertices are used by how many triangles."""
    each = triangles_.select(F.explode(F.array("i0", "i1", "i2")).alias("vid")).groupBy("vid").agg(F.count("*").alias("uses"))
    return each.groupBy("uses").agg(F.count("*").alias("vertices"))
