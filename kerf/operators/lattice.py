"""Which cells primitives remove, when, and what is left.

The stock is implicit: only removed cells are rows. A primitive is cut into the tiles
its box touches, a few small rows; these are dealt by tile, and each task lists the
cells of its tiles and tests them. A tile that very many primitives hit is dealt in
slices of ``seq``, so no task gets more of a tile than a slice; each finds its minima by
cell, and only those are exchanged and combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerf.functions import geometry as g
from kerf.grid import AXES, Grid

#: Cells along the edge of a tile.
TILE = 16
#: Primitives of a tile are dealt in slices of 2^16 numbers of ``seq``.
SLICE_BITS = 16
KEY = ["job_id", "x", "y", "z"]


def lattice(spark: SparkSession, grid: Grid) -> DataFrame:
    """All cells x, y, z, by column of cells along x. Made from a range, with no cross join."""
    nx, ny, nz = grid.dims
    columns = spark.range(ny * nz)
    return columns.select(
        F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("x"), (F.col("id") % ny).cast("int").alias("y"), F.floor(F.col("id") / ny).cast("int").alias("z")
    )


def index_box(primitives: DataFrame, grid: Grid, about_centre: bool = False) -> DataFrame:
    """Adds lo_x .. hi_z, cells that a primitive's box touches within the lattice, and its axis.

    The axis is ux, uy, uz and its length, and ``point`` says that there is none; so what
    is tested for each cell is short. ``about_centre``: a sphere's box is its centre's
    cell and ceil(r / res) to each side.
    """
    length = g.distance(g.point("a"), g.point("b"))
    primitives = primitives.withColumn("axis", length)
    cols = {f"u{n}": F.try_divide(F.col(f"b{n}") - F.col(f"a{n}"), F.col("axis")) for n in AXES}
    cols["point"] = (F.col("shape") == "sphere") | (F.col("axis") < g.SHORTEST_AXIS)
    for k, n in enumerate(AXES):
        a, b, r = F.col(f"a{n}"), F.col(f"b{n}"), F.col("r")
        lo, hi = grid.index(F.least(a, b) - r, k), grid.index(F.greatest(a, b) + r, k)
        if about_centre:
            reach, mid = F.ceil(r / F.lit(float(grid.res))).cast("int"), grid.index(a, k)
            sphere = F.col("shape") == "sphere"
            lo, hi = F.when(sphere, mid - reach).otherwise(lo), F.when(sphere, mid + reach).otherwise(hi)
        cols[f"lo_{n}"], cols[f"hi_{n}"] = F.greatest(F.lit(0), lo), F.least(F.lit(grid.dims[k] - 1), hi)
    some = (F.col("lo_x") <= F.col("hi_x")) & (F.col("lo_y") <= F.col("hi_y")) & (F.col("lo_z") <= F.col("hi_z"))
    return primitives.withColumns(cols).where(some)


def cells_in_boxes(boxed: DataFrame, salt: int = 1, tile: int = TILE) -> DataFrame:
    """Every cell of every box: the columns of ``boxed``, tx .. tz and x, y, z.

    ``salt`` deals each slice of a tile to further tasks.
    """
    n = int(boxed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = boxed
    for a in AXES:
        span = F.sequence(F.floor(F.col(f"lo_{a}") / tile).cast("int"), F.floor(F.col(f"hi_{a}") / tile).cast("int"))
        tiles = tiles.withColumn(f"t{a}", F.explode(span))
    tiles = tiles.withColumn("_slice", F.shiftright("seq", SLICE_BITS))
    keys = ["job_id", "tx", "ty", "tz", "_slice"]
    if salt > 1:
        tiles = tiles.withColumn("_salt", F.pmod(F.xxhash64("seq", "part"), F.lit(salt)).cast("int"))
        keys.append("_salt")
    cells = tiles.repartition(n, *keys)
    for a in ("z", "y", "x"):
        first, last = F.greatest(F.col(f"lo_{a}"), F.col(f"t{a}") * tile), F.least(F.col(f"hi_{a}"), F.col(f"t{a}") * tile + tile - 1)
        cells = cells.withColumn(a, F.explode(F.sequence(first, last)))
    return cells.drop("_slice", "_salt")


def centre(grid: Grid) -> g.Point:
    return tuple(grid.world(F.col(n), k) for k, n in enumerate(AXES))


def inside(grid: Grid, x: Column | None = None) -> Column:
    """Whether the cell's centre lies in the primitive of its row, prepared by :func:`index_box`; with ``x``, of that cell of the line."""
    p, a, b, r = centre(grid), g.point("a"), g.point("b"), F.col("r")
    if x is not None:
        p = (grid.world(x, 0), *p[1:])
    u, n = g.point("u"), F.col("axis")
    t = g.dot(g.subtract(p, a), u)
    off = tuple(c - (d + e * t) for c, d, e in zip(p, a, u))
    beside = (t >= -g.END_TOLERANCE) & (t <= n + g.END_TOLERANCE)
    ends = (F.col("shape") == "capsule") & (g.in_sphere(p, a, r) | g.in_sphere(p, b, r))
    return F.when(F.col("point"), g.in_sphere(p, a, r)).when(beside, g.dot(off, off) <= r * r).otherwise(ends)


def hits(primitives: DataFrame, grid: Grid, salt: int = 1) -> DataFrame:
    """job_id, seq, part, x, y, z (and the tile) for each cell in each primitive."""
    inner = cells_in_boxes(index_box(primitives, grid), salt).where(inside(grid))
    return inner.select("job_id", "tx", "ty", "tz", "x", "y", "z", "seq", "part")


def removed(primitives: DataFrame, grid: Grid, salt: int = 1) -> DataFrame:
    """job_id, x, y, z, first_cut: each removed cell and the command that first cut it."""
    cut = hits(primitives, grid, salt).groupBy("job_id", "tx", "ty", "tz", "x", "y", "z").agg(F.min("seq").alias("first_cut"))
    return cut.select(*KEY, "first_cut")


def after(cut: DataFrame, seq: int) -> DataFrame:
    """Cells removed once the command ``seq`` is done."""
    return cut.where(F.col("first_cut") <= seq)


def material_count(cut: DataFrame, grid: Grid) -> DataFrame:
    """Per job: cells removed and left. Only removed cells are counted, no lattice is made."""
    gone = F.count("*").alias("removed")
    return cut.groupBy("job_id").agg(gone).select("job_id", "removed", (F.lit(grid.cells).cast("long") - F.col("removed")).alias("remaining"))


def count_one(cut: DataFrame, grid: Grid) -> int:
    """Cells left of a single job's stock; all of them where nothing was cut."""
    return grid.cells - cut.count()


def changed_region(cut: DataFrame) -> DataFrame:
    """Per job and command: the exact index box of cells that it was the first to remove."""
    return cut.groupBy("job_id", F.col("first_cut").alias("seq")).agg(*g.bounds(g.point()), F.count("*").alias("cells"))


def occupied(spark: SparkSession, cut: DataFrame, grid: Grid) -> DataFrame:
    """x, y, z of cells left of a single job's stock."""
    return lattice(spark, grid).join(cut.select(*AXES), list(AXES), "left_anti")


def dense(spark: SparkSession, cut: DataFrame, grid: Grid) -> DataFrame:
    """All cells with ``material``; for small lattices."""
    gone = cut.select(*AXES, F.lit(False).alias("_left"))
    return lattice(spark, grid).join(gone, list(AXES), "left").select(*AXES, F.coalesce("_left", F.lit(True)).alias("material"))


def look_up(points: DataFrame, cut: DataFrame, grid: Grid) -> DataFrame:
    """``points`` (x, y, z cell numbers) with ``material``: false outside the lattice."""
    gone = cut.select(*AXES, F.lit(True).alias("_gone")).distinct()
    inside_ = grid.contains(F.col("x"), F.col("y"), F.col("z"))
    return points.join(gone, list(AXES), "left").withColumn("material", inside_ & F.col("_gone").isNull()).drop("_gone")


def look_up_world(points: DataFrame, cut: DataFrame, grid: Grid) -> DataFrame:
    """``points`` (wx, wy, wz coordinates) with cell numbers and ``material``."""
    cells = points.withColumns({n: grid.index(F.col(f"w{n}"), k) for k, n in enumerate(AXES)})
    return look_up(cells, cut, grid)


def edited(cut: DataFrame, edits: DataFrame, grid: Grid) -> DataFrame:
    """Removed cells after single edits (job_id, seq, x, y, z, material), by the last event of each cell.

    Setting a cell adds material again, so a minimum won't do: events are ordered.
    Edits outside the lattice are ignored.
    """
    events = cut.select(*KEY, F.col("first_cut").alias("seq"), F.lit(False).alias("material"))
    events = events.unionByName(edits.where(grid.contains(F.col("x"), F.col("y"), F.col("z"))).select(*KEY, "seq", "material"))
    last = events.groupBy(*KEY).agg(F.max_by("material", "seq").alias("material"), F.max_by("seq", "seq").alias("first_cut"))
    return last.where(~F.col("material")).select(*KEY, "first_cut")


def edits_at(points: DataFrame, grid: Grid) -> DataFrame:
    """Edits for :func:`edited` from rows of job_id, seq, wx, wy, wz (coordinates) and material."""
    return points.select("job_id", "seq", *(grid.index(F.col(f"w{n}"), k).alias(n) for k, n in enumerate(AXES)), "material")


def octree_counts(cut: DataFrame, bits: int) -> DataFrame:
    """Removed cells by node of the octree, from the root (level 0) down to single cells.

    A node's number is a prefix of the path, by shifts. Nodes of the finest level are
    counted first, so that coarser levels add up counts and not cells.
    """
    path = g.morton(F.col("x"), F.col("y"), F.col("z"), bits)
    finest = cut.groupBy("job_id", path.alias("path")).agg(F.count("*").alias("n"))
    levels = F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright("path", 3 * (bits - k)).alias("node")) for k in range(bits + 1)))
    return finest.select("job_id", "n", F.inline(levels)).groupBy("job_id", "level", "node").agg(F.sum("n").alias("empty"))


def coloured(cells: DataFrame, grid: Grid) -> DataFrame:
    """x, y, z of cells to draw with their centre and colour by height."""
    at = [grid.world(F.col(n), k) for k, n in enumerate(AXES)]
    red, green, blue = g.height_colour(at[2], F.lit(float(grid.lo[2])), F.lit(float(grid.hi[2])))
    return cells.select(*AXES, *(c.alias(f"w{n}") for c, n in zip(at, AXES)), red.alias("red"), green.alias("green"), blue.alias("blue"))


def listed(cells: DataFrame, grid: Grid, by_octree: bool = False) -> DataFrame:
    """Cells in the order in which they are listed: by z, y, x, or by octree path."""
    if not by_octree:
        return cells.orderBy("z", "y", "x")
    bits = max(1, max(grid.dims) - 1).bit_length()
    return cells.orderBy(g.morton(F.col("x"), F.col("y"), F.col("z"), bits))
