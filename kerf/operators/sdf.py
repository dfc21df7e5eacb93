"""Signed distance fields: negative where empty, positive in material.

From cells, the fixpoint of sweeping is a closed form: material is 0.1 at a surface
and 0.5 elsewhere; an empty cell is 0.1 plus the number of steps to the nearest empty
surface cell, cut at the band. Steps separate by axis, so six running minima give
them, each over one line of cells: windows stay small and there are as many as lines.
Cells are dealt by one coordinate, so that lines along two axes are whole: three
exchanges make all windows.

From removed cells or their words of bits, the same field comes block by block (see
:mod:`kerf.operators.blocks`): no dense lattice is made before the result, and no window
holds a line.

From primitives, a cell's value is the least signed distance of all whose index box
holds it, and at most the band: one aggregation.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerf.functions import geometry as g
from kerf.grid import AXES, Grid
from kerf.operators import blocks
from kerf.operators.lattice import cells_in_boxes, centre, index_box, lattice

BAND = 10


def _line(axis: str, keys: list[str]):  # noqa: ANN202
    return Window.partitionBy(*keys, *(a for a in AXES if a != axis)).orderBy(axis)


def _slabs(df: DataFrame, axis: str, keys: list[str]) -> DataFrame:
    """Rows dealt by one coordinate: lines along both other axes are whole then, and windows over them move nothing."""
    return df.repartition(*keys, axis)


def surface(cells: DataFrame, grid: Grid, keys: list[str] | None = None) -> DataFrame:
    """``cells`` (x, y, z, material) with ``surface``: one of 26 neighbours differs; outside is empty.

    Least and greatest of three neighbours, one axis after the other; rows end up dealt by y.
    """
    keys = keys or []
    df = cells.withColumn("_m", F.col("material").cast("int")).withColumns({"_lo": F.col("_m"), "_hi": F.col("_m")})
    for a in ("y", "z", "x"):
        k = AXES.index(a)
        df = _slabs(df, "y" if a == "x" else "x", keys) if a != "z" else df
        w = _line(a, keys).rowsBetween(-1, 1)
        edge = (F.col(a) == 0) | (F.col(a) == grid.dims[k] - 1)
        df = df.withColumns({"_lo": F.when(edge, F.lit(0)).otherwise(F.min("_lo").over(w)), "_hi": F.max("_hi").over(w)})
    differs = F.when(F.col("material"), F.col("_lo") == 0).otherwise(F.col("_hi") == 1)
    return df.withColumn("surface", differs).drop("_m", "_lo", "_hi")


def surface6(cells: DataFrame, grid: Grid, keys: list[str] | None = None) -> DataFrame:
    """As :func:`surface` with 6 neighbours, where a cell at the lattice's edge always is one."""
    keys = keys or []
    df = cells.withColumn("surface", F.lit(False))
    for a in ("y", "z", "x"):
        df = _slabs(df, "y" if a == "x" else "x", keys) if a != "z" else df
        w, differs = _line(a, keys), F.col("surface")
        for f in (F.lag, F.lead):
            differs = differs | (f("material").over(w) != F.col("material"))
        df = df.withColumn("surface", F.coalesce(differs, F.lit(True)) | (F.col(a) == 0) | (F.col(a) == grid.dims[AXES.index(a)] - 1))
    return df


def from_cells(cells: DataFrame, grid: Grid, band: float = BAND, keys: list[str] | None = None) -> DataFrame:
    """x, y, z, d of each cell of ``cells`` (x, y, z, material), in millimetres.

    ``band`` is in cells. ``cells`` must be a whole lattice for each value of ``keys``.
    """
    keys = keys or []
    df = surface(cells, grid, keys)
    far = float(sum(grid.dims) + band + 1)
    df = df.withColumn("_f", F.when(F.col("surface") & ~F.col("material"), 0.0).otherwise(far))
    # The surface's rows are dealt by y, so lines along x and z are whole; one more exchange makes those along y.
    for a in ("x", "z", "y"):
        df = _slabs(df, "x", keys) if a == "y" else df
        w = _line(a, keys)
        onward = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        back = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        up = F.min(F.col("_f") - F.col(a)).over(onward) + F.col(a)
        down = F.min(F.col("_f") + F.col(a)).over(back) - F.col(a)
        df = df.withColumn("_f", F.least(up, down))
    held = lambda v: F.least(F.lit(float(band)), v)
    solid = F.when(F.col("surface"), held(F.lit(0.1))).otherwise(held(F.lit(0.5)))
    d = F.when(F.col("material"), solid).otherwise(-held(F.col("_f") + 0.1))
    return df.select(*keys, *AXES, (d * float(grid.res)).alias("d"))


def from_removed(cut: DataFrame, grid: Grid, band: float = BAND) -> DataFrame:
    """x, y, z, d of all cells of one lattice from the removed ones (x, y, z), as :func:`from_cells` has them."""
    return blocks.field(blocks.words_of(cut, grid), grid, band)


def constant(spark: SparkSession, grid: Grid, band: float = BAND) -> DataFrame:
    """A field of solid stock: the band everywhere."""
    return lattice(spark, grid).withColumn("d", F.lit(float(band)))


def from_primitives(primitives: DataFrame, grid: Grid, band: float = BAND, salt: int = 1) -> DataFrame:
    """job_id, x, y, z, d of cells that primitives touch; all others are at the band.

    A capsule without length takes nothing away.
    """
    p, a, b, r = centre(grid), g.point("a"), g.point("b"), F.col("r")
    some = primitives.where((F.col("shape") == "sphere") | (g.distance(a, b) >= g.SHORTEST_AXIS))
    # A sphere is a capsule without an axis; the axis is prepared, so what is computed for each cell is short.
    u = tuple(F.coalesce(f"u{n}", F.lit(0.0)) for n in AXES)
    near_end = g.subtract(p, a)
    t = F.when(F.col("point"), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.col("axis"), g.dot(near_end, u))))
    value = g.length(g.subtract(near_end, g.scale(u, t))) - r
    near = cells_in_boxes(index_box(some, grid, about_centre=True), salt).withColumn("_v", value).where(F.col("_v") < float(band))
    least = near.groupBy("job_id", "tx", "ty", "tz", *AXES).agg(F.min("_v").alias("d"))
    return least.select("job_id", *AXES, "d")


def difference(field: DataFrame, other: DataFrame, band: float = BAND) -> DataFrame:
    """The field with what ``other`` takes away: the lesser of both."""
    b = other.select(*AXES, F.col("d").alias("_d"))
    return field.join(b, list(AXES), "left").select(*AXES, F.least(F.col("d"), F.coalesce("_d", F.lit(float(band)))).alias("d"))


def outside_distance(grid: Grid, x: Column, y: Column, z: Column, band: float = BAND) -> Column:
    """Value of a cell outside: minus its centre's distance from the box, cut at the band."""
    over = []
    for k, c in enumerate((x, y, z)):
        w = grid.world(c, k)
        over.append(F.greatest(F.lit(0.0), F.lit(float(grid.lo[k])) - w, w - F.lit(float(grid.hi[k]))))
    return -F.least(F.lit(float(band)), g.length(tuple(over)))


def look_up(points: DataFrame, field: DataFrame, grid: Grid, band: float = BAND, default: float | None = None) -> DataFrame:
    """``points`` (x, y, z) with ``d``. Cells without a row in ``field`` are at ``default``, the band."""
    inside = grid.contains(F.col("x"), F.col("y"), F.col("z"))
    known = points.join(field.select(*AXES, F.col("d").alias("_d")), list(AXES), "left")
    value = F.coalesce("_d", F.lit(float(band if default is None else default)))
    return known.withColumn("d", F.when(inside, value).otherwise(outside_distance(grid, F.col("x"), F.col("y"), F.col("z"), band))).drop("_d")


def _based(points: DataFrame, grid: Grid, keys: tuple[str, ...]) -> DataFrame:
    """Each different point once: ``_key`` (keys, place and number of equal rows), the lower corner's cell _ix .. and the place in it _tx .."""
    at = [f"w{n}" for n in AXES]
    once = points.groupBy(*dict.fromkeys((*keys, *at))).agg(F.count("*").alias("_n"))
    cols = {}
    for k, n in enumerate(AXES):
        f = (F.col(f"w{n}") - F.lit(float(grid.lo[k]))) / F.lit(float(grid.res))
        cols[f"_i{n}"] = F.floor(f).cast("int")
        cols[f"_t{n}"] = f - F.floor(f)
    # Keys go into a struct: they may be named as the nodes' cell numbers are.
    return once.withColumns(cols).withColumn("_key", F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), *(F.col(n).alias(n) for n in at), "_n"))


def _each_row(df: DataFrame, keys: tuple[str, ...], *values: Column) -> DataFrame:
    """Keys and values again for each row that a point had."""
    rows = df.select("_key", *values, F.explode(F.sequence(F.lit(1), F.col("_key")["_n"].cast("int"))).alias("_again"))
    return rows.select(*(F.col("_key")[f"k{i}"].alias(k) for i, k in enumerate(keys)), *(c for c in rows.columns if c not in ("_key", "_again")))


def _weight(n: str, offset: int) -> Column | None:
    """The share of a node in the value at a point, along one axis; none beyond the point's cell."""
    return F.col(f"_t{n}") if offset == 1 else 1 - F.col(f"_t{n}") if offset == 0 else None


def sample(points: DataFrame, field: DataFrame, grid: Grid, band: float = BAND, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys and ``d`` at wx, wy, wz of each point, trilinear between the cells' values.

    A cell's value stands at its lower corner, as the field's own look-up has it. Each
    point has eight nodes; equal nodes of many points meet the field once by join. Equal
    rows are counted before and repeated after.
    """
    nodes = []
    for offset in product((0, 1), repeat=3):
        weight = F.lit(1.0)
        for o, n in zip(offset, AXES):
            weight = weight * _weight(n, o)
        nodes.append(F.struct(*((F.col(f"_i{n}") + o).alias(n) for o, n in zip(offset, AXES)), weight.alias("_w")))
    each = _based(points, grid, keys).select("_key", F.inline(F.array(*nodes))).where(F.col("_w") != 0)
    sums = look_up(each, field, grid, band).groupBy("_key").agg(F.sum(F.col("_w") * F.col("d")).alias("d"))
    return _each_row(sums, keys, F.col("d"))


def gradient(points: DataFrame, field: DataFrame, grid: Grid, band: float = BAND, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys and gx, gy, gz: unit gradient by central differences of one cell; +y where there is none. Repeated points give repeated rows.

    A step of one cell moves a point to the next nodes and leaves its place between them,
    so the differences are sums over 32 nodes around it, with a weight for each axis: one
    look-up and one grouping.
    """
    nodes = []
    for offset in product(range(-1, 3), repeat=3):
        weights = []
        for k, n in enumerate(AXES):
            beside = [_weight(m, offset[i]) for i, m in enumerate(AXES) if i != k]
            up, down = _weight(n, offset[k] - 1), _weight(n, offset[k] + 1)
            if any(w is None for w in beside) or up is None and down is None:
                weights.append(F.lit(0.0))
            else:
                along = up if down is None else -down if up is None else up - down
                weights.append(along * beside[0] * beside[1])
        # Nodes at an edge or a corner of the block count for no axis.
        if sum(o in (-1, 2) for o in offset) < 2:
            nodes.append(F.struct(*((F.col(f"_i{n}") + o).alias(n) for o, n in zip(offset, AXES)), *(w.alias(f"_w{n}") for w, n in zip(weights, AXES))))
    some = (F.col("_wx") != 0) | (F.col("_wy") != 0) | (F.col("_wz") != 0)
    each = _based(points, grid, keys).select("_key", F.inline(F.array(*nodes))).where(some)
    sums = look_up(each, field, grid, band).groupBy("_key").agg(*((F.sum(F.col(f"_w{n}") * F.col("d")) / (2 * float(grid.res))).alias(f"_g{n}") for n in AXES))
    unit = g.normalized(g.point("_g"), g.const(0, 1, 0), 1e-6)
    return _each_row(sums, keys, *(c.alias(f"g{n}") for c, n in zip(unit, AXES)))


def _even(least: Column, greatest: Column, grid: Grid) -> Column:
    """Whether values have one sign and differ by less than the resolution.

    Values are tenths of cells, which binary numbers only come near to: -3.1 and -4.1 are one cell apart, and
    their difference isn't quite 1. So it is rounded.
    """
    return (F.signum(least) == F.signum(greatest)) & (F.round((greatest - least) / float(grid.res), 9) < 1)


def octree_leaves(field: DataFrame, grid: Grid, level: int) -> DataFrame:
    """Per cube of ``2 ** level`` cells: least, greatest and middle value, and whether one value would do."""
    cube = [F.shiftright(n, level).alias(f"c{n}") for n in AXES]
    d = F.col("d")
    some = field.groupBy(*cube).agg(F.min(d).alias("least"), F.max(d).alias("greatest"))
    return some.withColumns({"value": (F.col("least") + F.col("greatest")) / 2, "leaf": _even(F.col("least"), F.col("greatest"), grid)})


def nearest_surface(cells: DataFrame, grid: Grid, radius: int, band: float = BAND) -> DataFrame:
    """x, y, z, d and the nearest surface cell sx, sy, sz (of equals the first by z, y, x) of each cell of the whole lattice ``cells`` (x, y, z, material).

    Straight distance to the nearest surface cell (see :func:`surface6`) within ``radius`` cells
    along each axis, in millimetres and cut at ``band``; at the band where there is none.
    """
    return nearest_to_removed(cells.where(~F.col("material")), grid, radius, band)


def nearest_to_removed(cut: DataFrame, grid: Grid, radius: int, band: float = BAND) -> DataFrame:
    """As :func:`nearest_surface`, from removed cells (x, y, z): axis by axis within blocks, a row for each cell only at the end."""
    near = blocks.nearest(blocks.words_of(cut, grid), grid, radius)
    found = F.col("d2") >= 0
    far = F.when(found, F.sqrt(F.col("d2").cast("double")) * float(grid.res)).otherwise(float(band))
    d = F.least(far, F.lit(float(band))) * F.when(F.col("material"), 1.0).otherwise(-1.0)
    return near.select(*AXES, d.alias("d"), *(F.when(found, F.col(f"s{n}")).alias(f"s{n}") for n in AXES))


def octree(field: DataFrame, grid: Grid, top: int) -> DataFrame:
    """Leaves of the octree over a field: level, cx, cy, cz, value.

    From cells upwards, eight leaves become one where their values have one sign and differ by
    less than the resolution, up to cubes of ``2 ** top`` cells. A leaf's value is the mean of
    its least and greatest. At most as many leaves are grouped as there were a level below.
    """
    cells = [F.col(n).alias(f"c{n}") for n in AXES]
    open_ = field.select(*cells, F.col("d").alias("least"), F.col("d").alias("greatest"))
    done = None
    for level in range(top + 1):
        names = [f"c{n}" for n in AXES]
        value = ((F.col("least") + F.col("greatest")) / 2).alias("value")
        if level == top:
            last = open_.select(F.lit(level).alias("level"), *names, value)
            return last if done is None else done.unionByName(last)
        parent = [F.shiftright(n, 1).alias(f"p{n}") for n in names]
        both = open_.withColumns({f"p{n}": F.shiftright(n, 1) for n in names})
        up = open_.groupBy(*parent).agg(F.min("least").alias("lo"), F.max("greatest").alias("hi"), F.count("*").alias("n"))
        even = (F.col("n") == 8) & _even(F.col("lo"), F.col("hi"), grid)
        joined = both.join(up.withColumn("even", even), [f"p{n}" for n in names])
        stay = joined.where(~F.col("even")).select(F.lit(level).alias("level"), *names, value)
        done = stay if done is None else done.unionByName(stay)
        open_ = up.where(even).select(*(F.col(f"p{n}").alias(n) for n in names), F.col("lo").alias("least"), F.col("hi").alias("greatest"))
    return done
